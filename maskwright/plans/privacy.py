"""Queries of detectors, fusion, redaction and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm
from ..operators import fusion, labels, metrics, patterns, redact, verify
from ..sources import profile as profiles
from ..schema import CLASSES, fate, prefix
from ..session import cut
from ..sources import tables as sources
from .base import BOXES, FORMS, ORACLE_SQL, derived, plain, query, six
from .scalars import ACCOUNTS, CODES, sql_luhn, sql_verhoeff

_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_CARD = r"\b(?:[0-9][ -]?){12,19}\b"
DOCS = "SELECT doc_id AS k, text FROM {documents}"


def _hits(source: str, pattern: str) -> str:
    """DuckDB: k, hit, start of every match; starts are sums of the lengths of gaps and matches before."""
    return (
        f"SELECT k, hits[i] AS hit, CAST(list_sum([length(gaps[j]) FOR j IN range(1, i + 1)]) + coalesce(list_sum([length(hits[j]) FOR j IN range(1, i)]), 0) AS INT) AS start "
        f"FROM (SELECT k, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT k, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM {source}))"
    )


def _rule(name: str, rule: str, source: str, oracle: str) -> None:
    @query(name, oracle)
    def _(spark, d):
        hits = patterns.rule_hits(derived(spark, d, source), patterns.BY_NAME[rule], "k")
        return hits.select("k", "hit", "start", six(F.col("p")).alias("p"))


_D = "regexp_replace(hit, '[^0-9]', '', 'g')"
AADHAAR = f"SELECT k, 'id ' || substr(aad, 1, 4) || ' ' || substr(aad, 5, 4) || '-' || substr(aad, 9) || ' ends' AS text FROM ({ACCOUNTS})"
CARDS = f"SELECT k, 'card ' || card || ' or ' || substr(card, 1, 4) || ' ' || substr(card, 5) || '.' AS text FROM ({ACCOUNTS})"
PANS = f"SELECT k, 'pan ' || pan || ', bank ' || ifsc || '!' AS text FROM ({CODES})"
PHONES = "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'Phone: ' WHEN c_custkey % 3 = 1 THEN 'Order number: +91 ' ELSE '+44 20' END || CAST(9000000000 + c_custkey AS STRING) || ' and ' || CAST(c_custkey * 37 AS STRING) AS text FROM {customer}"
SECRETS = "SELECT c_custkey AS k, 'use token_' || md5(CAST(c_custkey AS STRING)) || ' or eyJ' || substr(md5(c_name), 1, 12) || '.' || substr(md5(c_name), 3, 14) || '.' || substr(md5(c_name), 5, 8) || ' or ' || md5(c_mktsegment || CAST(c_custkey AS STRING)) || upper(substr(md5(c_name), 1, 9)) || ' now ' || lower(replace(c_name, '#', '.')) || '@okaxis' AS text FROM {customer}"
DATES_SPARK = "SELECT o_orderkey AS k, 'born ' || date_format(o_orderdate, 'dd/MM/yyyy') || ' at ' || CAST(o_orderkey % 32 AS STRING) || '.' || CAST(o_orderkey % 14 AS STRING) || '.2001' AS text FROM {orders}"
DATES_DUCK = "(SELECT o_orderkey AS k, 'born ' || strftime(o_orderdate, '%d/%m/%Y') || ' at ' || CAST(o_orderkey % 32 AS STRING) || '.' || CAST(o_orderkey % 14 AS STRING) || '.2001' AS text FROM orders)"

_rule("d01_email_hits", "email", DOCS, f"SELECT *, 0.97 AS p FROM ({_hits(plain(DOCS), _EMAIL)})")
_rule("d02_upi_hits", "upi", SECRETS, f"SELECT *, 0.95 AS p FROM ({_hits(plain(SECRETS), r'\b[a-zA-Z0-9._-]{3,}@(?:okhdfcbank|okicici|oksbi|okaxis|paytm|ybl|ibl|axl|upi|apl)\b')})")
_rule("d03_aadhaar_hits", "aadhaar", AADHAAR, f"SELECT *, 0.96 AS p FROM ({_hits(plain(AADHAAR), r'\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b')}) WHERE {sql_verhoeff(_D)}")
_rule("d04_pan_hits", "pan", PANS, f"SELECT *, 0.95 AS p FROM ({_hits(plain(PANS), r'\b[A-Z]{5}[0-9]{4}[A-Z]\b')}) WHERE substr(hit, 4, 1) IN ('A','B','C','F','G','H','L','J','P','T','K')")
_rule("d05_ifsc_hits", "ifsc", PANS, f"SELECT *, 0.9 AS p FROM ({_hits(plain(PANS), r'\b[A-Z]{4}0[A-Z0-9]{6}\b')})")
_rule("d06_card_hits", "card", DOCS, f"SELECT *, 0.94 AS p FROM ({_hits(plain(DOCS), _CARD)}) WHERE length({_D}) BETWEEN 13 AND 19 AND {sql_luhn(_D)}")
_rule("d06_card_hits_derived", "card", CARDS, f"SELECT *, 0.94 AS p FROM ({_hits(plain(CARDS), _CARD)}) WHERE length({_D}) BETWEEN 13 AND 19 AND {sql_luhn(_D)}")
_rule(
    "d07_phone_hits", "phone", PHONES,
    f"SELECT *, CASE WHEN regexp_matches(CASE WHEN length({_D}) > 10 AND starts_with({_D}, '91') THEN substr({_D}, 3) ELSE {_D} END, '^[6-9][0-9]{{9}}$') THEN 0.72 ELSE 0.55 END AS p FROM ({_hits(plain(PHONES), r'(?:\+?91[\s-]?)?\b[6-9][0-9]{9}\b|\+[0-9]{1,3}[\s-]?[0-9]{6,12}\b')})",
)
_rule("d08_dob_hits", "dob", DATES_SPARK, f"SELECT *, 0.6 AS p FROM ({_hits(DATES_DUCK, r'\b(?:0?[1-9]|[12][0-9]|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)[0-9]{2}\b')})")
_rule("d09_prefixed_secret_hits", "prefixed_secret", SECRETS, f"SELECT *, 0.93 AS p FROM ({_hits(plain(SECRETS), r'(?i)\b(?:sk|pk|api|key|token|bearer)[-_][A-Za-z0-9_-]{16,}\b')})")
_rule("d10_jwt_hits", "jwt", SECRETS, f"SELECT *, 0.97 AS p FROM ({_hits(plain(SECRETS), r'\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\b')})")
_rule("d11_otp_hits", "otp", DOCS, f"SELECT *, 0.18 AS p FROM ({_hits(plain(DOCS), r'\b[0-9]{4,8}\b')})")
_ENT = "-list_sum([len([d FOR d IN string_split(hit, '') IF d = c]) / CAST(length(hit) AS DOUBLE) * log2(len([d FOR d IN string_split(hit, '') IF d = c]) / CAST(length(hit) AS DOUBLE)) FOR c IN list_distinct(string_split(hit, ''))])"
_rule("d12_entropy_hits", "entropy", SECRETS, f"SELECT *, 0.6 AS p FROM ({_hits(plain(SECRETS), r'\b[A-Za-z0-9_\-+/=]{24,}\b')}) WHERE {_ENT} >= 3.9")


@query("p01_candidates", "SELECT doc_id, regexp_matches(text, '[0-9]{4,}|@') AS candidate FROM documents")
def _(spark, d):
    return derived(spark, d, "SELECT doc_id, text FROM {documents}").select("doc_id", patterns.candidate(F.col("text")).alias("candidate"))


_HITS = " UNION ALL ".join(f"SELECT k, start, CAST(start + length(hit) AS INT) AS \"end\", CAST(p AS DOUBLE) AS p, '{cls}' AS cls FROM ({ORACLE_SQL[name]})" for name, cls in (("d02_upi_hits", "upi"), ("d09_prefixed_secret_hits", "apikey"), ("d10_jwt_hits", "apikey"), ("d12_entropy_hits", "apikey")))


@query("d13_overlap_resolution", f'WITH h AS ({_HITS}) SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.k = h.k AND o.start < h."end" AND h.start < o."end" AND o.p > h.p)')
def _(spark, d):
    """Native hits of three rules folded per document, beside the joint Arrow scan."""
    rows = derived(spark, d, SECRETS)
    hits = None
    for rule in ("upi", "prefixed_secret", "jwt", "entropy"):
        some = patterns.rule_hits(rows, patterns.BY_NAME[rule], "k")
        hits = some if hits is None else hits.unionByName(some)
    lists = hits.groupBy("k").agg(F.collect_list(F.struct("start", "end", "p", "cls")).alias("h"))
    return lists.select("k", F.explode(patterns.resolve_overlaps(F.col("h"))).alias("h")).select("k", "h.*")


_FORM = plain(FORMS)
_DOM = f"""SELECT scope, id, CASE WHEN tag = 'img' THEN 'element' WHEN tag IN ('input', 'textarea') THEN 'value' ELSE 'text' END AS field,
  CASE WHEN tag = 'img' THEN 'id_document' WHEN role = 'password' THEN 'password' WHEN autocomplete = 'name' THEN 'person' WHEN autocomplete IS NOT NULL THEN 'card' WHEN type = 'email' THEN 'email' WHEN type = 'tel' THEN 'phone'
    WHEN name = 'Email address' THEN 'email' WHEN name IN ('Mobile number', 'Contact phone') THEN 'phone' WHEN name = 'Full name' THEN 'person' WHEN name = 'Street address' THEN 'address' WHEN name = 'Card number' THEN 'card' WHEN name = 'Aadhaar number' THEN 'aadhaar' END AS cls,
  CASE WHEN tag = 'img' THEN 0.86 WHEN role = 'password' THEN 1.0 WHEN autocomplete IS NOT NULL THEN 0.95 WHEN type IN ('email', 'tel') THEN 0.93
    WHEN name = 'Email address' THEN 0.9 WHEN name = 'Mobile number' THEN 0.88 WHEN name = 'Contact phone' THEN 0.63 WHEN name = 'Full name' THEN 0.85 WHEN name = 'Street address' THEN 0.8 WHEN name = 'Card number' THEN 0.93 WHEN name = 'Aadhaar number' THEN 0.94 END AS p FROM {_FORM}"""
_REGEX = f"""SELECT scope, id, field, CAST(start AS INT) AS start, CAST(start + length(hit) AS INT) AS "end", cls, CAST(p AS DOUBLE) AS p, 'regex' AS source FROM (
  SELECT scope, id, 'value' AS field, 0 AS start, value AS hit, CASE name WHEN 'Email address' THEN 'email' WHEN 'Mobile number' THEN 'phone' WHEN 'Card number' THEN 'card' ELSE 'aadhaar' END AS cls,
    CASE name WHEN 'Email address' THEN 0.97 WHEN 'Mobile number' THEN 0.72 WHEN 'Card number' THEN 0.94 ELSE 0.96 END AS p
  FROM {_FORM} WHERE name IN ('Email address', 'Mobile number') OR name = 'Card number' AND {sql_luhn("value")} OR name = 'Aadhaar number' AND {sql_verhoeff("value")}
  UNION ALL SELECT scope, id, 'text', strpos(text, ': ') + 1, substr(text, strpos(text, ': ') + 2, 10), 'phone', 0.72 FROM {_FORM} WHERE text LIKE '%: %'
  UNION ALL SELECT scope, id, 'text', strpos(text, 'mail ') + 4, substr(text, strpos(text, 'mail ') + 5), 'email', 0.97 FROM {_FORM} WHERE text LIKE '%@%')"""


@query("d14_detect_elements", _REGEX)
def _(spark, d):
    return patterns.detect(derived(spark, d, FORMS), ["scope", "id"])


@query("d15_label_detector", f"SELECT scope, id, field, cls, round(CAST(p AS DOUBLE), 6) AS p FROM ({_DOM}) WHERE cls IS NOT NULL")
def _(spark, d):
    return labels.detect(derived(spark, d, FORMS)).select("scope", "id", "field", "cls", six(F.col("p")).alias("p"))


@query("j08_first_class", f"SELECT scope, min_by(cls, ord) AS cls FROM (SELECT d.scope AS scope, d.cls AS cls, f.ord AS ord FROM ({_DOM}) d JOIN {_FORM} f ON d.scope = f.scope AND d.id = f.id WHERE d.cls IS NOT NULL) GROUP BY scope")
def _(spark, d):
    return labels.detect(derived(spark, d, FORMS)).groupBy("scope").agg(F.min_by("cls", "ord").alias("cls"))


@query(
    "k01_allowed_sink",
    f"""SELECT id, c AS cls, CASE WHEN tag NOT IN ('input', 'textarea') THEN false WHEN role = 'password' THEN c = 'password' WHEN autocomplete = 'name' AND c = 'person' THEN true WHEN tag = 'textarea' AND h > 120 THEN false
    ELSE regexp_matches(lower(concat_ws(' ', name, label, autocomplete, type)), CASE c WHEN 'email' THEN 'e[\\s-]?mail' WHEN 'phone' THEN 'phone|mobile|contact|tel|whatsapp' WHEN 'person' THEN 'name' WHEN 'password' THEN 'pass|pwd' ELSE 'address|street|city|pin|postal|zip' END) END AS ok
    FROM {_FORM}, (SELECT unnest(['email', 'phone', 'person', 'password', 'address']) AS c)""",
)
def _(spark, d):
    rows = derived(spark, d, FORMS).withColumn("cls", F.explode(F.array(*map(F.lit, ("email", "phone", "person", "password", "address")))))
    return rows.select("id", "cls", labels.allowed_sink(*[F.col(c) for c in ("cls", "role", "tag", "type", "name", "label", "placeholder", "autocomplete", "h")]).alias("ok"))


OPINIONS = f"SELECT scope, CAST(ord AS STRING) AS id, 'value' AS field, cls, p, 'dom' AS source FROM ({BOXES}) UNION ALL SELECT scope, CAST(ord AS STRING), 'value', cls, q, 'regex' FROM ({BOXES})"


@query("a02_noisy_or", f"SELECT scope, round(1 - product(1 - p) + 1e-9, 6) AS p, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n FROM {plain(OPINIONS)} GROUP BY scope, id, cls")
def _(spark, d):
    rows = derived(spark, d, OPINIONS).withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int"))
    return fusion.grouped(rows).select("scope", six(F.col("p") + 1e-9).alias("p"), F.array_join("sources", ",").alias("sources"), F.col("n_detections").alias("n"))


@query("a03_sources", f"SELECT source, count(*) AS n FROM (SELECT DISTINCT scope, id, cls, source FROM {plain(OPINIONS)}) GROUP BY source")
def _(spark, d):
    rows = derived(spark, d, OPINIONS).withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int"))
    return metrics.by_source(fusion.grouped(rows))


@query("a04_repeats", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, lower(regexp_replace(text, '\\s+', '', 'g'))) AS n FROM conversations")
def _(spark, d):
    from pyspark.sql import Window

    rows = derived(spark, d, "SELECT conv_id, turn, text FROM {conversations}")
    return rows.select("conv_id", "turn", F.count("*").over(Window.partitionBy("conv_id", norm(F.col("text")))).alias("n"))


@query("w03_left_context", f"SELECT k, hit, substr(text, CAST(greatest(start - 40, 0) + 1 AS BIGINT), CAST(start - greatest(start - 40, 0) AS BIGINT)) AS ctx FROM (SELECT h.*, d.text AS text FROM ({_hits(plain(DOCS), _EMAIL)}) h JOIN {plain(DOCS)} d ON h.k = d.k)")
def _(spark, d):
    docs = derived(spark, d, DOCS)
    return patterns.rule_hits(docs, patterns.BY_NAME["email"], "k").join(docs, "k").select("k", "hit", fusion.left_context(F.col("text"), F.col("start")).alias("ctx"))


def _detections(elements):
    dom = labels.detect(elements).select("scope", "id", "field", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "cls", "p", "source")
    return dom.unionByName(patterns.detect(elements, ["scope", "id"]).select(*dom.columns))


@query(
    "u01_all_detections",
    f"""SELECT scope, id, field, CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS "end", cls, CAST(p AS DOUBLE) AS p, 'dom' AS source FROM ({_DOM}) WHERE cls IS NOT NULL UNION ALL {_REGEX}""",
)
def _(spark, d):
    return _detections(derived(spark, d, FORMS))


@query(
    "d16_fusion",
    f"""WITH f AS {_FORM}, d AS ({_DOM}),
    phones AS (SELECT scope, id, CAST(strpos(text, ':') + 1 AS INT) AS start, starts_with(text, 'Order') AS bad FROM f WHERE tag = 'p' AND text IS NOT NULL)
    SELECT scope, id, field, cls, round(p, 6) AS p FROM (
      SELECT scope, id, field, cls, CAST(p AS DOUBLE) AS p FROM d WHERE p >= 0.8
      UNION ALL SELECT scope, id, field, cls, p + CASE WHEN tag IN ('input', 'textarea') THEN 0.12 ELSE -0.15 END + 0.30 FROM (SELECT d.*, f.tag AS tag FROM d JOIN f ON d.scope = f.scope AND d.id = f.id WHERE d.p < 0.8 AND d.cls = 'phone') WHERE p + 0.30 - 0.15 >= 0.8
      UNION ALL SELECT scope, id, 'text', 'phone', 0.72 + 0.30 FROM phones WHERE NOT bad
      UNION ALL SELECT scope, id, 'text', 'email', 0.97 FROM phones WHERE NOT bad
      UNION ALL SELECT scope, id, 'value', 'email', 0.97 FROM f WHERE name = 'Email address'
      UNION ALL SELECT scope, id, 'value', 'phone', 0.72 + (0.30 + 0.12) FROM f WHERE name = 'Mobile number'
      UNION ALL SELECT scope, id, 'value', 'card', 0.94 FROM f WHERE name = 'Card number' AND {sql_luhn("value")}
      UNION ALL SELECT scope, id, 'value', 'aadhaar', 0.96 FROM f WHERE name = 'Aadhaar number' AND {sql_verhoeff("value")})""",
)
def _(spark, d):
    e = derived(spark, d, FORMS)
    return fusion.fuse(e, _detections(e)).select("scope", "id", "field", "cls", six(F.col("p")).alias("p"))


TIES = "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'card' ELSE 'dob' END AS cls, CASE o_orderkey % 4 WHEN 0 THEN 'order mobile' WHEN 1 THEN 'invoice' WHEN 2 THEN 'birth' ELSE '' END AS context, CAST(4000000000000000 + o_orderkey AS STRING) AS span, CASE WHEN o_orderkey % 5 = 0 THEN 'input' WHEN o_orderkey % 5 = 1 THEN 'h1' ELSE 'p' END AS tag, CASE WHEN o_orderkey % 5 = 1 THEN 'heading' ELSE 'text' END AS role, o_orderkey % 6 AS repeats, CAST(o_orderkey % 3 AS INT) AS sources FROM {orders}"


@query(
    "d17_tie_break",
    f"""SELECT k, round(CASE WHEN cls = 'phone' AND context LIKE '%mobile%' OR cls = 'dob' AND context LIKE '%birth%' THEN 0.3 WHEN cls IN ('phone', 'card') AND context IN ('invoice', 'order mobile') THEN -0.4 ELSE 0 END + CASE WHEN cls = 'card' THEN CASE WHEN {sql_luhn("span")} THEN 0.2 ELSE -0.5 END ELSE 0 END
    + CASE WHEN tag = 'input' THEN 0.12 WHEN role = 'heading' THEN -0.15 ELSE 0 END + CASE WHEN repeats >= 4 THEN -0.25 ELSE 0 END + CASE WHEN sources >= 2 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS delta FROM {plain(TIES)}""",
)
def _(spark, d):
    return derived(spark, d, TIES).select("k", six(fusion.delta(*[F.col(c) for c in ("cls", "context", "span", "tag", "role", "repeats", "sources")])).alias("delta"))


_CLASSES = "(VALUES ('password','drop','SECRET'),('otp','drop','OTP'),('apikey','drop','SECRET'),('email','substitute','EMAIL'),('phone','substitute','PHONE'),('person','substitute','PERSON'),('address','substitute','ADDR'),('card','substitute','CARD'),('aadhaar','substitute','AADHAAR'),('pan','substitute','PAN'),('ifsc','substitute','IFSC'),('upi','substitute','UPI'),('dob','substitute','DOB'),('face','mask','FACE'),('id_document','mask','IDDOC'),('document','mask','DOC'),('screenshot','mask','SCREEN'),('signature','mask','SIGN')) t(cls, fate, prefix)"
#: A class for each order, all of them in turn, and one that is not known.
CLASSED = "SELECT o_orderkey AS k, CASE o_orderkey % 19 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _, _) in enumerate(CLASSES)) + " ELSE 'licence' END AS cls FROM {orders}"


@query("d18_fates", f"SELECT k, c.cls AS cls, coalesce(fate, 'substitute') AS fate, coalesce(prefix, 'PII') AS prefix FROM {plain(CLASSED)} c LEFT JOIN {_CLASSES} ON c.cls = t.cls")
def _(spark, d):
    return derived(spark, d, CLASSED).select("k", "cls", fate(F.col("cls")).alias("fate"), prefix(F.col("cls")).alias("prefix"))


MINTED = "SELECT conv_id AS scope, CAST(turn AS INT) AS ord, CASE WHEN turn % 2 = 0 THEN 'email' ELSE 'phone' END AS cls, CASE WHEN turn % 2 = 0 THEN 'u' || CAST(turn % 3 AS STRING) || '@example.com' ELSE CAST(9000000000 + turn % 4 AS STRING) END AS value FROM {conversations}"


@query(
    "w01_handles",
    f"""SELECT m.scope AS scope, m.ord AS ord, m.value AS value, h.handle AS handle FROM {plain(MINTED)} m JOIN (SELECT scope, cls, value, upper(cls) || '_' || row_number() OVER (PARTITION BY scope, cls ORDER BY first) AS handle FROM (SELECT scope, cls, value, min(ord) AS first FROM {plain(MINTED)} GROUP BY scope, cls, value)) h
    ON m.scope = h.scope AND m.cls = h.cls AND m.value = h.value""",
)
def _(spark, d):
    return redact.mint(derived(spark, d, MINTED).withColumn("place", F.col("ord"))).select("scope", "ord", "value", "handle")


def _spans(docs):
    hits = None
    for rule in ("email", "card"):
        some = patterns.rule_hits(docs.withColumnRenamed("scope", "k"), patterns.BY_NAME[rule], "k")
        hits = some if hits is None else hits.unionByName(some)
    return hits.select(F.col("k").alias("scope"), F.lit(0).alias("ord"), "start", "end", "cls", F.lit("substitute").alias("fate"))


_FLAG = f"""WITH e AS ({_hits(plain(DOCS), _EMAIL)}), c AS (SELECT * FROM ({_hits(plain(DOCS), _CARD)}) WHERE length({_D}) BETWEEN 13 AND 19 AND {sql_luhn(_D)}),
  ne AS (SELECT k, count(*) AS n, sum(length(hit)) AS l, sum(length('EMAIL_' || r)) AS h, count(DISTINCT hit) AS u FROM (SELECT e.*, dense_rank() OVER (PARTITION BY k ORDER BY f DESC) AS r FROM (SELECT *, max(start) OVER (PARTITION BY k, hit) AS f FROM e) e) GROUP BY k),
  nc AS (SELECT k, count(*) AS n, sum(length(hit)) AS l, sum(length('CARD_' || r)) AS h, count(DISTINCT hit) AS u FROM (SELECT c.*, dense_rank() OVER (PARTITION BY k ORDER BY f DESC) AS r FROM (SELECT *, max(start) OVER (PARTITION BY k, hit) AS f FROM c) c) GROUP BY k)
  SELECT d.k AS doc_id, CAST(coalesce(ne.n, 0) + coalesce(nc.n, 0) AS BIGINT) AS n_spans, CAST(length(d.text) - coalesce(ne.l, 0) - coalesce(nc.l, 0) + coalesce(ne.h, 0) + coalesce(nc.h, 0) AS BIGINT) AS n_chars, CAST(coalesce(ne.u, 0) + coalesce(nc.u, 0) AS BIGINT) AS n_handles
  FROM {plain(DOCS)} d LEFT JOIN ne ON d.k = ne.k LEFT JOIN nc ON d.k = nc.k"""


@query("flagship_redaction", _FLAG)
def _(spark, d):
    """Documents with emails and cards replaced by typed handles: spans, length of what is left, and handles minted."""
    docs = sources.document_texts(derived(spark, d, "SELECT doc_id, text FROM {documents}"))
    out, vault = redact.redact_texts(docs, _spans(docs))
    handles = vault.groupBy("scope").agg(F.count("*").alias("n_handles"))
    done = out.join(handles, "scope", "left")
    return done.select(F.col("scope").alias("doc_id"), F.col("n_spans").cast("long").alias("n_spans"), F.length("text").cast("long").alias("n_chars"), F.coalesce("n_handles", F.lit(0)).alias("n_handles"))


_REDACTED = f"""WITH e AS ({_hits(plain(DOCS), _EMAIL)}), c AS (SELECT * FROM ({_hits(plain(DOCS), _CARD)}) WHERE length({_D}) BETWEEN 13 AND 19 AND {sql_luhn(_D)}),
  h AS (SELECT *, 'EMAIL_' AS prefix FROM e UNION ALL SELECT *, 'CARD_' FROM c),
  named AS (SELECT k, start, start + length(hit) AS stop, prefix || dense_rank() OVER (PARTITION BY k, prefix ORDER BY f DESC) AS rep FROM (SELECT *, max(start) OVER (PARTITION BY k, prefix, hit) AS f FROM h)),
  gaps AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY k ORDER BY start), 0) AS behind FROM named),
  parts AS (SELECT k, string_agg(substr(text, CAST(behind + 1 AS BIGINT), CAST(start - behind AS BIGINT)) || rep, '' ORDER BY start) AS done, max(stop) AS stop, count(*) AS n FROM gaps JOIN {plain(DOCS)} USING (k) GROUP BY k)
  SELECT d.k AS scope, CAST(0 AS INT) AS ord, coalesce(done, '') || substr(d.text, CAST(coalesce(stop, 0) + 1 AS BIGINT)) AS text, CAST(coalesce(n, 0) AS INT) AS n_spans FROM {plain(DOCS)} d LEFT JOIN parts ON d.k = parts.k"""


@query("r01_redacted_documents", _REDACTED)
def _(spark, d):
    docs = sources.document_texts(derived(spark, d, "SELECT doc_id, text FROM {documents}"))
    return redact.redact_texts(docs, _spans(docs))[0]


SPANS = "SELECT c_custkey AS k, 'mail ' || lower(c_name) || ' or call ' || CAST(c_custkey AS STRING) AS text, CAST(5 AS INT) AS s1, CAST(5 + length(c_name) AS INT) AS e1, CAST(14 + length(c_name) AS INT) AS s2, CAST(14 + length(c_name) + length(CAST(c_custkey AS STRING)) AS INT) AS e2 FROM {customer}"


@query("r01_apply_spans", f"SELECT k, left('mail EMAIL_1 or call [REMOVED]', 27) AS t FROM {plain(SPANS)}")
def _(spark, d):
    s = lambda a, b, r: F.struct(F.col(a).alias("start"), F.col(b).alias("end"), F.lit(r).alias("rep"))
    rows = derived(spark, d, SPANS)
    return rows.select("k", redact.apply_spans(F.col("text"), F.array(s("s1", "e1", "EMAIL_1"), s("s2", "e2", redact.REMOVED)), 27).alias("t"))


#: An address in a field, and two in the text beside it.
THREE = "SELECT c_custkey AS scope, 0 AS ord, 'el_1' AS id, 'textbox' AS role, 'input' AS tag, 'text' AS type, 'Mail' AS name, 'v' || CAST(c_custkey AS STRING) || '@example.com' AS value, 'first a' || CAST(c_custkey AS STRING) || '@example.com, then b' || CAST(c_custkey AS STRING) || '@example.com or v' || CAST(c_custkey AS STRING) || '@example.com' AS text, 0 AS x, 0 AS y, 9 AS w, 9 AS h, true AS visible, false AS offscreen, true AS enabled, CAST(NULL AS STRING) AS parent, CAST(NULL AS STRING) AS autocomplete, CAST(NULL AS STRING) AS placeholder, CAST(NULL AS STRING) AS label FROM {customer}"


@query("w02_mint_order", "SELECT c_custkey AS scope, 'EMAIL_1' AS holds, 'first EMAIL_3, then EMAIL_2 or EMAIL_1' AS text FROM customer")
def _(spark, d):
    """Handles are numbered value before text, and within a string from the right; a value met again keeps its own."""
    e = derived(spark, d, THREE)
    hits = patterns.detect(e, ["scope", "id"]).select("scope", "id", "field", "start", "end", "cls", "p", F.lit("substitute").alias("fate"), F.lit(True).alias("anchored"))
    return redact.redact(e, hits)[0].select("scope", "holds", "text")


@query("p06_safe_to_echo", f"SELECT id, coalesce(role <> 'password' AND (tag = 'select' OR type IN ('checkbox', 'radio', 'search')), false) AS echo, role <> 'password' AND type NOT IN ('search', 'submit') AND length(name) > 0 AS ask FROM {_FORM}")
def _(spark, d):
    c = F.col
    return derived(spark, d, FORMS).select("id", redact.safe_to_echo(c("role"), c("tag"), c("type")).alias("echo"), redact.worth_asking(c("role"), c("type"), c("label"), c("name"), c("placeholder")).alias("ask"))


def _redacted(spark, d):
    e = derived(spark, d, FORMS)
    found = cut(fusion.fuse(e, _detections(e)))
    slots = profiles.profile(spark, {"fullName": "A B", "address": "1 Main street", "email": "a@b.org"})
    safe, vault = redact.redact(e, found, slots)
    return e, found, safe, vault


@query("r02_safe_elements", f"SELECT scope, count(*) AS n, sum(CASE WHEN role = 'password' THEN 1 ELSE 0 END)::BIGINT AS sensitive, sum(CASE WHEN tag = 'textarea' AND value IS NULL THEN 1 ELSE 0 END)::BIGINT AS wants FROM {_FORM} GROUP BY scope")
def _(spark, d):
    safe = _redacted(spark, d)[2]
    return safe.groupBy("scope").agg(F.count("*").alias("n"), F.count_if("sensitive").alias("sensitive"), F.count_if(F.col("wants").isNotNull()).alias("wants"))


#: What each element of a form becomes.
_SAFE = f"""SELECT scope, ord, id, role, tag, type, name, x, y, w, h, visible, offscreen, enabled, CASE WHEN starts_with(text, 'Phone') THEN 'Phone: PHONE_2 or mail EMAIL_2' ELSE text END AS text,
  CASE name WHEN 'Full name' THEN 'PERSON_1' WHEN 'Email address' THEN 'EMAIL_1' WHEN 'Mobile number' THEN 'PHONE_1' WHEN 'Card number' THEN 'CARD_1' WHEN 'Aadhaar number' THEN 'AADHAAR_1' WHEN 'Street address' THEN CASE WHEN value IS NOT NULL THEN 'ADDR_1' END END AS holds,
  CASE WHEN tag = 'textarea' AND value IS NULL THEN 'ADDR_1' END AS wants, role = 'password' AS sensitive, false AS empty,
  CASE WHEN role = 'password' THEN 'drop' WHEN starts_with(text, 'Phone') OR tag = 'input' OR tag = 'textarea' AND value IS NOT NULL THEN 'substitute' ELSE 'keep' END AS fate FROM {_FORM}"""
_SAFE_COLUMNS = ("scope", "ord", "id", "role", "tag", "name", "text", "holds", "wants", "sensitive", "empty", "fate")


@query("r02_safe_values", f"SELECT {', '.join(_SAFE_COLUMNS)} FROM ({_SAFE})")
def _(spark, d):
    return _redacted(spark, d)[2].select(*_SAFE_COLUMNS)


def _json(*fields: str) -> str:
    """DuckDB: a JSON object of (name, expression) pairs as `name=expression`; strings are quoted with `'`, null ones left out."""
    parts = []
    for f in fields:
        name, _, e = f.partition("=")
        parts.append(f"""coalesce('"{name}":"' || ({e[1:]}) || '",', '')""" if e[0] == "'" else f"""coalesce('"{name}":' || CAST(({e}) AS VARCHAR) || ',', '')""")
    return "'{' || rtrim(" + " || ".join(parts) + ", ',') || '}'"


_PAYLOADS = f"""SELECT scope, '{{"schema":"sanitized/1","elements":[' || string_agg({_json("id='id", "role='role", "name='name", "text='text", "holds='holds", "wants='wants", "sensitive=sensitive", "empty=empty")}, ',' ORDER BY ord) || ']}}' AS payload FROM ({_SAFE}) GROUP BY scope"""
_HASH = "lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(payload, '') IF c <> '']), lambda a, b: (xor(a, b) * 16777619) & 4294967295))), 8, '0')"


@query("r06_regions", f"SELECT scope, x, y, w, h, 'id_document' AS cls, false AS unanchored FROM {_FORM} WHERE tag = 'img'")
def _(spark, d):
    e, found, _, _ = _redacted(spark, d)
    return redact.regions(e, found)


@query("r08_payloads", _PAYLOADS)
def _(spark, d):
    return redact.serialise(_redacted(spark, d)[2])


#: The last steps of a form's run.
PAST = "SELECT user_id AS scope, event_id AS step, CASE WHEN event_id % 5 = 0 THEN 'ask_user' ELSE 'click' END AS action, 'el_' || CAST(event_id % 4 AS STRING) AS target, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS result, CASE WHEN event_id % 3 = 0 THEN event_type END AS note FROM {events}"
#: A page for each form, with a task that names its email address.
TASKED = "SELECT scope, 'mail to ' || coalesce(max(CASE WHEN name = 'Email address' THEN value END), 'nobody') AS task, 'shop.example.com/form/:id' AS url_class, 'Form ' || CAST(scope AS STRING) AS title, 1280 AS width, 720 AS height, 0 AS scroll_y, 2000 AS doc_height FROM (" + FORMS + ") GROUP BY scope"


@query(
    "r08_contexts",
    f"""WITH e AS (SELECT scope, string_agg({_json("id='id", "role='role", "tag='tag", "type='type", "name='name", "bbox=concat('[', x, ',', y, ',', w, ',', h, ']')", "visible=visible", "offscreen=CASE WHEN offscreen THEN true END", "enabled=enabled", "conf=0.98", "src=''dom'", "holds='holds", "wants='wants", "sensitive=CASE WHEN sensitive THEN true END", "text='text")}, ',' ORDER BY ord) AS elements,
      string_agg('"' || id || '"', ',' ORDER BY ord) AS children, '{{"x":' || min(x) || ',"y":' || min(y) || ',"w":' || (max(x + w) - min(x)) || ',"h":' || (max(y + h) - min(y)) || '}}' AS box,
      coalesce(string_agg('{{"bbox":[' || x || ',' || y || ',' || w || ',' || h || '],"cls":"id_document","state":"masked"}}', ',') FILTER (tag = 'img'), '') AS regions, bool_or(name = 'Email address') AS mailed FROM ({_SAFE}) GROUP BY scope),
    h AS (SELECT scope, string_agg({_json("action='action", "target='target", "result='result", "note='note")}, ',' ORDER BY step) AS history FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY step DESC) AS r FROM {plain(PAST)}) WHERE r <= 6 GROUP BY scope)
    SELECT scope, '{{"schema":"sanitized/1","task":"mail to ' || CASE WHEN mailed THEN 'EMAIL_1' ELSE 'nobody' END || '","mode":"balanced","urlClass":"shop.example.com/form/:id","title":"Form ' || scope || '","viewport":{{"w":1280,"h":720,"scrollY":0,"docH":2000}},"elements":[' || elements || '],"groups":[{{"id":"g_1","kind":"form","name":"Form ' || scope || '","children":[' || children || '],"bbox":' || box || '}}],"regions":[' || regions || '],"history":[' || coalesce(history, '') || ']}}' AS payload
    FROM e LEFT JOIN h USING (scope)""",
)
def _(spark, d):
    """The whole context of each form: task without known values, viewport, elements, its group, masked regions and last steps."""
    e, found, safe, vault = _redacted(spark, d)
    edge = lambda c, n: F.max(F.col(c) + F.col(n)) - F.min(c)
    group = e.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("c"), F.min("x").alias("x"), F.min("y").alias("y"), edge("x", "w").alias("w"), edge("y", "h").alias("h"))
    group = group.select("scope", F.lit("g_1").alias("id"), F.lit("form").alias("kind"), F.concat(F.lit("Form "), F.col("scope").cast("string")).alias("name"), F.transform("c", lambda x: x["id"]).alias("children"), *"xywh")
    return redact.contexts(safe, derived(spark, d, TASKED), groups=group, regions=redact.regions(e, found), history=derived(spark, d, PAST), vault=vault)


#: Contexts that pass at once, pass once hardened, and never do: a value in a field can be dropped, one in a text stays.
ESCALATED = "SELECT c_custkey AS scope, 0 AS ord, 'el_1' AS id, 'textbox' AS role, 'Mail' AS name, CASE WHEN c_custkey % 3 = 2 THEN 'write to u' || CAST(c_custkey AS STRING) || '@example.com' ELSE 'hello' END AS text, CASE WHEN c_custkey % 3 = 1 THEN 'v' || CAST(c_custkey AS STRING) || '@example.com' ELSE 'EMAIL_1' END AS holds, CAST(NULL AS STRING) AS wants, false AS sensitive, false AS empty FROM {customer}"


@query(
    "v06_escalations",
    f"""SELECT scope, scope % 3 <> 2 AS passed, CAST(scope % 3 AS INT) AS retries, CASE scope % 3 WHEN 0 THEN '{{"schema":"sanitized/1","elements":[{{"id":"el_1","role":"textbox","name":"Mail","text":"hello","holds":"EMAIL_1","sensitive":false,"empty":false}}]}}' WHEN 1 THEN '{{"schema":"sanitized/1","elements":[{{"id":"el_1","role":"textbox","name":"Mail","text":"hello","sensitive":true,"empty":false}}]}}' END AS payload FROM {plain(ESCALATED)}""",
)
def _(spark, d):
    safe = derived(spark, d, ESCALATED)
    vault = safe.select("scope", F.lit("EMAIL_1").alias("handle"), F.concat(F.lit("value "), F.col("scope").cast("string")).alias("value"))
    return verify.escalate(safe, vault).select("scope", "passed", "retries", "payload")


@query("a05_fate_counts", f"SELECT scope, sum(CASE WHEN role = 'password' THEN 1 ELSE 0 END)::BIGINT AS dropped, sum(CASE WHEN tag = 'img' THEN 1 ELSE 0 END)::BIGINT AS masked FROM {_FORM} GROUP BY scope")
def _(spark, d):
    return metrics.fate_counts(_redacted(spark, d)[1]).select("scope", "dropped", "masked")


@query("v06_verdicts", f"SELECT scope, true AS passed, 0 AS retries FROM {_FORM} GROUP BY scope")
def _(spark, d):
    _, _, safe, vault = _redacted(spark, d)
    return verify.escalate(safe, vault).select("scope", "passed", "retries")


@query(
    "v07_receipts",
    f"""SELECT scope, dropped, substituted, kept, masked, CAST(strlen(payload) AS INT) AS payload_bytes, {_HASH} AS payload_hash, true AS passed FROM ({_PAYLOADS}) JOIN
    (SELECT scope, count(*) FILTER (fate = 'drop') AS dropped, count(*) FILTER (fate = 'substitute') AS substituted, count(*) FILTER (fate = 'keep') AS kept, count(*) FILTER (tag = 'img') AS masked FROM ({_SAFE}) GROUP BY scope) USING (scope)""",
)
def _(spark, d):
    _, found, safe, vault = _redacted(spark, d)
    return verify.receipts(safe, found, verify.escalate(safe, vault))


LEAKY = "SELECT conv_id AS scope, 'x ' || CASE WHEN turn % 3 = 0 THEN 'write to u' || CAST(conv_id AS STRING) || '@example.com' WHEN turn % 3 = 1 THEN 'see EMAIL_1' ELSE 'call ' || CAST(9000000000 + conv_id AS STRING) END AS payload FROM {conversations}"


@query("v01_leaks", f"SELECT scope, CASE WHEN payload LIKE '%@%' THEN 'email' ELSE 'phone' END AS cls FROM {plain(LEAKY)} WHERE payload NOT LIKE '%EMAIL_1%'")
def _(spark, d):
    return verify.leaks(derived(spark, d, LEAKY)).select("scope", "cls")


@query("v02_vault_leaks", f"SELECT DISTINCT scope, 'EMAIL_1' AS handle FROM {plain(LEAKY)} WHERE payload LIKE '%@%'")
def _(spark, d):
    rows = derived(spark, d, LEAKY)
    vault = rows.select("scope").distinct().select("scope", F.lit("EMAIL_1").alias("handle"), F.concat(F.lit("u"), F.col("scope").cast("string"), F.lit("@example.com")).alias("value"))
    return verify.vault_leaks(rows, vault)


QUOTED = "SELECT c_custkey AS scope, '{{\"a\":\"' || md5(c_name) || upper(md5(c_mktsegment)) || '\",\"b\":\"EMAIL_1\",\"c\":\"' || md5(c_name) || '\",\"d\":\"el_' || md5(c_mktsegment) || upper(md5(c_name)) || '\",\"e\":\"el_12345678901234567890\"}}' AS payload FROM {customer}"


@query("v04_secret_like", f"SELECT scope, token FROM (SELECT scope, unnest(regexp_extract_all(payload, '\"([A-Za-z0-9_\\-+/=.]{{20,}})\"', 1)) AS token FROM {plain(QUOTED)}) WHERE {_ENT.replace('hit', 'token')} >= 4.2")
def _(spark, d):
    return verify.secret_like(derived(spark, d, QUOTED))


@query("v05_unknown_keys", "SELECT k, CASE WHEN k % 3 = 0 THEN 'secret' WHEN k % 3 = 1 THEN '' ELSE '(not JSON)' END AS bad FROM (SELECT o_orderkey AS k FROM orders)")
def _(spark, d):
    rows = derived(spark, d, "SELECT o_orderkey AS k FROM {orders}")
    payload = F.when(F.col("k") % 3 == 0, '{"elements":[{"id":"a","secret":1}]}').when(F.col("k") % 3 == 1, '{"task":"x"}').otherwise("{")
    return rows.select("k", F.array_join(verify.unknown_keys(payload), ",").alias("bad"))


@query("r07_scrub_task", "SELECT c_custkey AS scope, 'send EMAIL_1 to ' || c_name AS task FROM customer")
def _(spark, d):
    rows = derived(spark, d, "SELECT c_custkey AS scope, c_name FROM {customer}")
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@x.org"))
    vault = rows.select("scope", F.lit("EMAIL_1").alias("handle"), mail.alias("value"))
    return redact.scrub_task(rows.select("scope", F.concat(F.lit("send "), mail, F.lit(" to "), "c_name").alias("task")), vault)


@query("p10_preview", f"SELECT id, CASE WHEN c IN ('password') THEN NULL ELSE value END AS shown FROM (SELECT id, value, CASE WHEN role = 'password' THEN 'password' ELSE 'email' END AS c FROM {_FORM})")
def _(spark, d):
    return derived(spark, d, FORMS).select("id", redact.preview(F.when(F.col("role") == "password", "password").otherwise("email"), F.col("value")).alias("shown"))


#: A profile for each customer: eight slots, some of them blank.
PROFILES = """
SELECT c_custkey AS scope, ord, key, cls, CASE WHEN c_custkey % (ord + 2) = 1 THEN '' WHEN key = 'fullName' THEN c_name WHEN key = 'email' THEN lower(c_name) || '@example.com' ELSE key || ' of ' || CAST(c_custkey AS STRING) END AS value FROM {customer}
CROSS JOIN (SELECT 0 AS ord, 'fullName' AS key, 'person' AS cls UNION ALL SELECT 1, 'email', 'email' UNION ALL SELECT 2, 'phone', 'phone' UNION ALL SELECT 3, 'dob', 'dob' UNION ALL SELECT 4, 'address', 'address' UNION ALL SELECT 5, 'pan', 'pan' UNION ALL SELECT 6, 'aadhaar', 'aadhaar' UNION ALL SELECT 7, 'upi', 'email') slots
"""


@query("j07_profile_slot", f"SELECT o_orderkey AS k, cls, p.key AS key, p.value AS value FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'person' ELSE 'card' END AS cls FROM orders) o LEFT JOIN (SELECT scope, cls, arg_min(key, ord) AS key, arg_min(value, ord) AS value FROM {plain(PROFILES)} WHERE value <> '' GROUP BY scope, cls) p USING (cls) WHERE p.scope = o_custkey OR p.scope IS NULL UNION ALL SELECT o_orderkey, cls, NULL, NULL FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'person' END AS cls FROM orders) o WHERE cls IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {plain(PROFILES)} p WHERE p.scope = o_custkey AND p.cls = o.cls AND value <> '')")
def _(spark, d):
    """The class of each order with its customer's first filled slot of that class."""
    classes = derived(spark, d, "SELECT o_orderkey AS k, o_custkey AS scope, CASE o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'person' ELSE 'card' END AS cls FROM {orders}")
    return profiles.slot_of(classes, derived(spark, d, PROFILES)).select("k", "cls", "key", "value")


@query("a20_filled_slots", f"SELECT scope, count(*) FILTER (value <> '') AS filled, count(*) AS slots FROM {plain(PROFILES)} GROUP BY scope")
def _(spark, d):
    return profiles.filled(derived(spark, d, PROFILES))


@query("f23_seal_round_trip", "SELECT c_custkey AS k, c_name AS opened, CAST(NULL AS VARCHAR) AS wrong FROM customer")
def _(spark, d):
    rows = derived(spark, d, "SELECT c_custkey AS k, c_name FROM {customer}")
    key, other = bytes(range(32)), bytes(32)
    sealed = rows.select("k", profiles.seal(F.col("c_name"), key).alias("s"))
    return sealed.select("k", profiles.unseal(F.col("s"), key).alias("opened"), profiles.unseal(F.col("s"), other).alias("wrong"))
