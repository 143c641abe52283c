"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checksums as C
from ..functions import geometry as G
from ..functions import text as T
from ..schema import accessible_name, role, visibility
from .base import BOXES, CONTROLS, TASKS, derived, plain, query, six

DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
HANDLE_RE = r"(?:SECRET|OTP|EMAIL|PHONE|PERSON|ADDR|CARD|AADHAAR|PAN|IFSC|UPI|DOB|FACE|IDDOC|DOC|SCREEN|SIGN|PII)_[0-9]+"


def sql_luhn(d: str) -> str:
    """DuckDB: does a string of 16 or fewer digits pass Luhn?"""
    digit = f"CAST(substr({d}, length({d}) - i, 1) AS INT)"
    return f"(list_sum([CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END FOR i IN range(0, length({d}))]) % 10 = 0)"


def sql_verhoeff(d: str) -> str:
    """DuckDB: a twelve-digit string's Verhoeff check, by the group's own arithmetic."""
    turn = "[0,1,2,3,4,5,6,7,8,9, 1,5,7,6,2,8,3,0,9,4, 5,8,0,3,7,9,6,1,4,2, 8,9,1,6,0,4,3,5,2,7, 9,4,5,3,1,2,6,8,7,0, 4,2,8,6,5,7,3,9,0,1, 2,7,9,3,8,0,6,4,1,5, 7,0,4,6,9,1,3,2,5,8]"
    steps = f"list_prepend(0, [{turn}[(i % 8) * 10 + CAST(substr({d}, 12 - i, 1) AS INT) + 1] FOR i IN range(0, 12)])"
    times = "CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN 5 + (a + b - 5) % 5 WHEN b < 5 THEN 5 + (a - b) % 5 ELSE (a - b + 5) % 5 END"
    return f"(list_reduce({steps}, lambda a, b: {times}) = 0)"


ACCOUNTS = "SELECT o_orderkey AS k, CAST(223456780000 + o_orderkey AS STRING) AS aad, CAST(4000000000000000 + o_orderkey AS STRING) AS card, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 9100000000 WHEN o_orderkey % 3 = 1 THEN 919000000000 ELSE 5000000000 END + o_orderkey AS STRING) AS mobile FROM {orders}"


@query("f01_luhn", f"SELECT k, {sql_luhn('card')} AS ok FROM {plain(ACCOUNTS)}")
def _(spark, d):
    return derived(spark, d, ACCOUNTS).select("k", C.luhn(F.col("card")).alias("ok"))


@query("f02_verhoeff", f"SELECT k, {sql_verhoeff('aad')} AS ok FROM {plain(ACCOUNTS)}")
def _(spark, d):
    return derived(spark, d, ACCOUNTS).select("k", C.verhoeff(F.col("aad")).alias("ok"))


CODES = """SELECT c_custkey AS k, chr(CAST(65 + c_custkey % 26 AS INT)) || 'BC' || chr(CAST(65 + c_custkey % 17 AS INT)) || 'E' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || 'Z' AS pan,
  'HDF' || chr(CAST(65 + c_custkey % 26 AS INT)) || CAST(c_custkey % 2 AS STRING) || lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0') AS ifsc, md5(CAST(c_custkey AS STRING)) AS h, c_name AS name, c_mktsegment AS segment FROM {customer}"""


@query("f03_pan_valid", f"SELECT k, regexp_matches(pan, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') AND substr(pan, 4, 1) IN ('A','B','C','F','G','H','L','J','P','T','K') AS ok FROM {plain(CODES)}")
def _(spark, d):
    return derived(spark, d, CODES).select("k", C.pan_valid(F.col("pan")).alias("ok"))


@query("f04_ifsc_valid", f"SELECT k, regexp_matches(ifsc, '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') AS ok FROM {plain(CODES)}")
def _(spark, d):
    return derived(spark, d, CODES).select("k", C.ifsc_valid(F.col("ifsc")).alias("ok"))


@query("f05_indian_mobile", f"SELECT k, regexp_matches(CASE WHEN length(mobile) > 10 AND starts_with(mobile, '91') THEN substr(mobile, 3) ELSE mobile END, '^[6-9][0-9]{{9}}$') AS ok FROM {plain(ACCOUNTS)}")
def _(spark, d):
    return derived(spark, d, ACCOUNTS).select("k", C.indian_mobile(F.col("mobile")).alias("ok"))


@query("f06_entropy", f"SELECT k, round(sum(-n / 32.0 * log2(n / 32.0)), 6) AS h FROM (SELECT k, c, CAST(count(*) AS DOUBLE) AS n FROM (SELECT k, unnest(string_split(h, '')) AS c FROM {plain(CODES)}) WHERE c <> '' GROUP BY k, c) GROUP BY k")
def _(spark, d):
    return derived(spark, d, CODES).select("k", six(T.entropy(F.col("h"))).alias("h"))


@query(
    "f07_fnv1a",
    f"SELECT k, lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(name, '') IF c <> '']), lambda a, b: (xor(a, b) * 16777619) & 4294967295))), 8, '0') AS fnv FROM {plain(CODES)}",
)
def _(spark, d):
    return derived(spark, d, CODES).select("k", T.fnv1a(F.col("name")).alias("fnv"))


@query("f08_snap", f"SELECT scope, ord, CAST(floor(x / 8.0 + 0.5) * 8 AS INT) AS x8, CAST(floor(w / 8.0 + 0.5) * 8 AS INT) AS w8 FROM {plain(BOXES)}")
def _(spark, d):
    return derived(spark, d, BOXES).select("scope", "ord", T.snap8(F.col("x")).alias("x8"), T.snap8(F.col("w")).alias("w8"))


@query(
    "f09_url_class",
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '(?i)/[0-9a-f-]{6,}/', '/:id/', 'g'), '(?i)/[0-9a-f-]{6,}$', '/:id') AS cls FROM pages",
)
def _(spark, d):
    return derived(spark, d, "SELECT page_id, url FROM {pages}").select("page_id", T.url_class(F.col("url")).alias("cls"))


def sql_tokens(text: str, stop: tuple[str, ...]) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"[w FOR w IN string_split_regex(regexp_replace(lower({text}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') IF length(w) > 1 AND w NOT IN ({words})]"


@query("f10_tokens", f"SELECT p_partkey AS k, array_to_string({sql_tokens('p_name || p_type', T.ROUTER_STOP)}, ' ') AS t FROM part")
def _(spark, d):
    return derived(spark, d, "SELECT p_partkey AS k, p_name || p_type AS n FROM {part}").select("k", F.array_join(T.tokens(F.col("n")), " ").alias("t"))


def sql_cover(stop) -> str:
    n, t = sql_tokens("name", stop), sql_tokens("task", stop)
    return f"CASE WHEN len({n}) > 0 THEN CAST(len([w FOR w IN {n} IF list_contains({t}, w)]) AS DOUBLE) / len({n}) ELSE 0.0 END"


PAIRS = "SELECT c.scope AS scope, c.ord AS ord, c.name AS name, t.task AS task FROM (" + CONTROLS + ") c JOIN (" + TASKS + ") t ON c.scope = t.scope"


@query(
    "f11_name_score",
    f"SELECT scope, ord, round(CASE WHEN length(trim(name)) <= 24 AND contains(lower(task), lower(trim(name))) AND len({sql_tokens('name', T.ROUTER_STOP)}) > 0 THEN greatest({sql_cover(T.ROUTER_STOP)}, 0.95) ELSE {sql_cover(T.ROUTER_STOP)} END, 6) AS s FROM {plain(PAIRS)}",
)
def _(spark, d):
    return derived(spark, d, PAIRS).select("scope", "ord", six(T.name_score(F.col("task"), F.col("name"))).alias("s"))


@query("f12_planner_score", f"SELECT scope, ord, round(CASE WHEN length(trim(name)) >= 3 AND contains(task, lower(trim(name))) THEN 1.0 ELSE {sql_cover(T.PLANNER_STOP)} END, 6) AS s FROM (SELECT scope, ord, name, lower(task) AS task FROM {plain(PAIRS)})")
def _(spark, d):
    return derived(spark, d, PAIRS).select("scope", "ord", six(T.planner_score(F.lower("task"), F.col("name"))).alias("s"))


HANDLES = "SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN ' EMAIL_' || CAST(n_nationkey AS STRING) WHEN 1 THEN 'see PHONE_2 and CARD_1 of ' || n_name WHEN 2 THEN 'mail a.b@' || lower(n_name) || '.org' ELSE '98765 43210 11' END AS s FROM {nation}"


@query("f13_is_handle", f"SELECT k, regexp_matches(trim(s), '^{HANDLE_RE}$') AS ok FROM {plain(HANDLES)}")
def _(spark, d):
    return derived(spark, d, HANDLES).select("k", T.is_handle(F.col("s")).alias("ok"))


@query("f14_strip_handles", rf"SELECT k, regexp_replace(s, '\b{HANDLE_RE}\b', ' ', 'g') AS s FROM {plain(HANDLES)}")
def _(spark, d):
    return derived(spark, d, HANDLES).select("k", T.strip_handles(F.col("s")).alias("s"))


@query("f15_looks_like_pii", rf"SELECT k, regexp_matches(s, '@[\w.-]+\.\w{{2,}}') OR regexp_matches(regexp_replace(s, '[\s-]', '', 'g'), '\b[0-9]{{10,}}\b') AS ok FROM {plain(HANDLES)}")
def _(spark, d):
    return derived(spark, d, HANDLES).select("k", T.looks_like_pii(F.col("s")).alias("ok"))


_GUARDS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b", r"\b(?:[0-9][ -]?){13,19}\b", r"\b[6-9][0-9]{9}\b")


@query("f16_output_guard", f"SELECT k, {' OR '.join(f'regexp_matches(b, {chr(39)}{g}{chr(39)})' for g in _GUARDS)} AS blocked FROM (SELECT k, regexp_replace(s, '{HANDLE_RE}', ' ', 'g') AS b FROM {plain(HANDLES)})")
def _(spark, d):
    return derived(spark, d, HANDLES).select("k", T.guarded(F.col("s")).alias("blocked"))


INGEST = "SELECT o_orderkey AS k, CAST(o_orderkey * 1000003 AS STRING) AS expected, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey * 1000003 AS STRING) WHEN 1 THEN '' WHEN 2 THEN substr(CAST(o_orderkey * 1000003 AS STRING), 1, 3) || '-' || substr(CAST(o_orderkey * 1000003 AS STRING), 4) WHEN 3 THEN substr(CAST(o_orderkey * 1000003 AS STRING), 1, 4) ELSE 'x' END AS actual FROM {orders}"


@query(
    "f17_ingestion",
    f"""SELECT k, reason IN ('exact match', 'match after formatting') AS verified, CAST(length(expected) AS INT) AS expected_len, CAST(length(actual) AS INT) AS actual_len, reason FROM (SELECT *, CASE WHEN actual = expected THEN 'exact match' WHEN actual = '' THEN 'field is empty'
    WHEN lower(regexp_replace(actual, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(expected, '[^A-Za-z0-9]', '', 'g')) THEN 'match after formatting' WHEN starts_with(expected, actual) THEN 'truncated to ' || length(actual) || ' of ' || length(expected) ELSE 'different' END AS reason FROM {plain(INGEST)})""",
)
def _(spark, d):
    return derived(spark, d, INGEST).select("k", T.compare_ingestion(F.col("actual"), F.col("expected")).alias("r")).select("k", "r.*")


NEIGHBOURS = "SELECT a.scope AS scope, a.ord AS ord, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS b_y, b.w AS bw, b.h AS bh FROM (" + BOXES + ") a JOIN (" + BOXES + ") b ON a.scope = b.scope AND b.ord = a.ord + 1"
_INTER = "(greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, b_y + bh) - greatest(ay, b_y), 0))"


@query("f18_iou", f"SELECT scope, ord, round(CAST({_INTER} AS DOUBLE) / (aw * ah + bw * bh - {_INTER}), 6) AS iou, round(CAST({_INTER} AS DOUBLE) / (aw * ah), 6) AS inside, ax < bx + bw AND bx < ax + aw AND ay < b_y + bh AND b_y < ay + ah AS f19_overlaps FROM {plain(NEIGHBOURS)}")
def _(spark, d):
    a, b = tuple(F.col(f"a{c}") for c in "xywh"), (F.col("bx"), F.col("b_y"), F.col("bw"), F.col("bh"))
    return derived(spark, d, NEIGHBOURS).select("scope", "ord", six(G.iou(a, b)).alias("iou"), six(G.containment(a, b)).alias("inside"), G.overlaps(a, b).alias("f19_overlaps"))


@query("f20_clean", "SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 120) AS clean, lower(regexp_replace(left(text, 200), '\\s+', '', 'g')) AS norm, floor(n_chars * 100.0 + 0.5) / 100.0 AS r2 FROM documents")
def _(spark, d):
    docs = derived(spark, d, "SELECT doc_id, text, n_chars FROM {documents}")
    return docs.select("doc_id", T.clean(F.col("text")).alias("clean"), T.norm(F.left("text", F.lit(200))).alias("norm"), T.round2(F.col("n_chars")).alias("r2"))


@query("f21_format", "SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' ELSE format('{:.1f} KB', floor(n / 1024.0 * 10 + 0.5) / 10) END AS size, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), url) AS host FROM (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n FROM pages) WHERE n < 1048576")
def _(spark, d):
    pages = derived(spark, d, "SELECT page_id, url, octet_length(html) AS n FROM {pages}").filter("n < 1048576")
    return pages.select("page_id", T.format_bytes(F.col("n")).alias("size"), T.short_url(F.col("url")).alias("host"))


@query(
    "f22_passphrase",
    f"""SELECT k, CAST(CASE WHEN length(p) < 8 OR bits < 40 THEN 0 WHEN bits < 60 THEN 1 WHEN bits < 80 THEN 2 ELSE 3 END AS INT) AS band FROM (SELECT k, p, length(p) * log2(greatest(CASE WHEN regexp_matches(p, '[a-z]') THEN 26 ELSE 0 END + CASE WHEN regexp_matches(p, '[A-Z]') THEN 26 ELSE 0 END
    + CASE WHEN regexp_matches(p, '[0-9]') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(p, '[^a-zA-Z0-9]') THEN 32 ELSE 0 END, 2)) AS bits FROM (SELECT k, substr(h || upper(segment) || '#', CAST(k % 30 + 1 AS BIGINT), CAST(4 + k % 13 AS BIGINT)) AS p FROM {plain(CODES)}))""",
)
def _(spark, d):
    rows = derived(spark, d, CODES).select("k", F.expr("substr(h || upper(segment) || '#', CAST(k % 30 + 1 AS INT), CAST(4 + k % 13 AS INT))").alias("p"))
    return rows.select("k", T.passphrase_strength(F.col("p")).cast("int").alias("band"))


@query("f25_base64", f"SELECT k, to_base64(encode(name)) AS b64, decode(from_base64(to_base64(encode(name)))) AS back FROM {plain(CODES)}")
def _(spark, d):
    return derived(spark, d, CODES).select("k", F.base64(F.encode("name", "UTF-8")).alias("b64"), F.decode(F.unbase64(F.base64(F.encode("name", "UTF-8"))), "UTF-8").alias("back"))


@query("f32_confirm_text", "SELECT page_id, 'Navigate to ' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '?' AS confirm FROM pages")
def _(spark, d):
    return derived(spark, d, "SELECT page_id, url FROM {pages}").select("page_id", T.confirm_text(F.col("url")).alias("confirm"))


ROLES = "SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN 'a' WHEN 1 THEN 'button' WHEN 2 THEN 'select' WHEN 3 THEN 'textarea' WHEN 4 THEN 'img' WHEN 5 THEN 'h3' WHEN 6 THEN 'div' ELSE 'input' END AS tag, CASE c_custkey % 5 WHEN 0 THEN 'password' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'submit' ELSE 'text' END AS type, CASE WHEN c_custkey % 21 = 0 THEN 'tab' END AS explicit, c_custkey % 12 = 6 AS editable, c_name AS name FROM {customer}"


@query(
    "s03_role",
    f"""SELECT k, CASE WHEN coalesce(explicit, '') <> '' THEN explicit WHEN tag = 'a' THEN 'link' WHEN tag IN ('button', 'select') THEN tag WHEN tag = 'textarea' THEN 'textbox' WHEN tag = 'img' THEN 'image' WHEN tag = 'input' THEN CASE type WHEN 'password' THEN 'password' WHEN 'checkbox' THEN 'checkbox' WHEN 'submit' THEN 'button' ELSE 'textbox' END
    WHEN tag LIKE 'h_' THEN 'heading' WHEN editable THEN 'textbox' ELSE 'text' END AS role FROM {plain(ROLES)}""",
)
def _(spark, d):
    return derived(spark, d, ROLES).select("k", role(F.col("tag"), F.col("type"), F.col("explicit"), F.col("editable")).alias("role"))


@query("s04_accessible_name", f"SELECT k, left(coalesce(nullif(trim(CASE WHEN k % 2 = 0 THEN '  ' ELSE explicit END), ''), CASE WHEN k % 3 = 0 THEN 'Label ' || name END, name), 120) AS n FROM {plain(ROLES)}")
def _(spark, d):
    none = F.lit(None).cast("string")
    aria, label = F.when(F.col("k") % 2 == 0, "  ").otherwise(F.col("explicit")), F.when(F.col("k") % 3 == 0, F.concat(F.lit("Label  "), "name"))
    return derived(spark, d, ROLES).select("k", accessible_name(aria, none, label, none, none, F.col("name"), none, none).alias("n"))


@query("s07_offscreen", f"SELECT scope, ord, x + w < 100 OR y + h < 60 OR x > 500 OR y > 300 AS off FROM {plain(BOXES)}")
def _(spark, d):
    inside = visibility(F.col("x") - 100, F.col("y") - 60, F.col("w"), F.col("h"), F.lit(400), F.lit(240))
    return derived(spark, d, BOXES).select("scope", "ord", inside.alias("off"))
