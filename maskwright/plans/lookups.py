"""Queries of lookups, visual findings, field states and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agent, fusion, lookup, redact, spatial, verify
from ..schema import described
from ..session import cut
from ..sources import html as pages_
from .base import BOXES, CONTROLS, FORMS, STEPS, derived, plain, query, six
from .engine import PIXELS, SAFE
from .privacy import OPINIONS, _detections

_F, _C, _S, _P = plain(FORMS), plain(CONTROLS), plain(STEPS), plain(PIXELS)

STYLED = """SELECT scope, ord, CASE WHEN ord % 7 = 1 THEN 'none' ELSE 'block' END AS display, CASE WHEN ord % 7 = 2 THEN 'hidden' END AS visibility, CASE WHEN ord % 7 = 3 THEN 0.01D WHEN ord % 7 = 4 THEN 0.5D END AS opacity,
  w * CASE WHEN w % 5 = 0 THEN 100 ELSE 1 END AS w, CASE WHEN h % 6 = 0 THEN 1 ELSE h END AS h FROM (""" + BOXES + ")"


@query("s02_described", f"SELECT scope, ord, w, h FROM {plain(STYLED.replace('0.01D', '0.01').replace('0.5D', '0.5'))} WHERE display <> 'none' AND visibility IS NULL AND coalesce(opacity, 1) >= 0.05 AND w BETWEEN 2 AND 4000 AND h BETWEEN 2 AND 4000")
def _(spark, d):
    return described(derived(spark, d, STYLED)).select("scope", "ord", "w", "h")


@query("s05_labels", "SELECT c_custkey AS scope, CASE c_custkey % 4 WHEN 0 THEN 'For ' || c_name WHEN 1 THEN 'Around ' || c_name WHEN 2 THEN 'Before' END AS label FROM customer")
def _(spark, d):
    """Inputs labelled by id, by an element around them, by a short sibling before them, and not at all."""
    rows = derived(spark, d, "SELECT c_custkey AS page_id, c_name FROM {customer}")
    kind = F.col("page_id") % 4
    html = (
        F.when(kind == 0, F.concat(F.lit("<form><input id=q><p>x</p><label for=q> For "), "c_name", F.lit("</label></form>")))
        .when(kind == 1, F.concat(F.lit("<label>Around "), "c_name", F.lit("<input></label>"))).when(kind == 2, F.lit("<div><span>Before</span><input></div>"))
        .otherwise(F.concat(F.lit("<div><span>"), F.repeat(F.lit("too long "), F.lit(9)), F.lit("</span><input></div>")))
    )
    kept = pages_.elements(pages_.nodes(rows.select("page_id", html.alias("html"))))
    return kept.filter("tag = 'input'").select("scope", "label")


@query("s08_frame_size", f"SELECT scope, ord, greatest(1, CAST(floor(w * 31 * least(1.0, 768.0::DOUBLE / greatest(w * 31, h * 9)) + 0.5) AS INT)) AS w, greatest(1, CAST(floor(h * 9 * least(1.0, 768.0::DOUBLE / greatest(w * 31, h * 9)) + 0.5) AS INT)) AS h FROM {plain(BOXES)}")
def _(spark, d):
    w, h = spatial.frame_size(F.col("w") * 31, F.col("h") * 9)
    return derived(spark, d, BOXES).select("scope", "ord", w.alias("w"), h.alias("h"))


@query("p03_actionable", f"SELECT scope, id FROM {_C} WHERE enabled AND (visible OR offscreen)")
def _(spark, d):
    return agent.actionable(derived(spark, d, CONTROLS)).select("scope", "id")


LINES = r"""SELECT c_custkey AS k, c_name || CASE c_custkey % 8 WHEN 0 THEN ' /[^@s]+/' WHEN 1 THEN ' .split(/s+/)' WHEN 2 THEN ' .replace(/D/g, x)' WHEN 3 THEN ' /^d{{4}}/' WHEN 4 THEN ' .replace(/s+/g) /[^@s]/' WHEN 5 THEN chr(8) || 'x' ELSE ' fine' END AS line FROM {customer}"""


@query("p11_escape_lint", "SELECT k, unnest(CASE k % 8 WHEN 0 THEN [0] WHEN 1 THEN [4] WHEN 2 THEN [2] WHEN 3 THEN [1] WHEN 4 THEN [0, 3] WHEN 5 THEN [5] ELSE [] END)::INT AS kind FROM (SELECT c_custkey AS k FROM customer)")
def _(spark, d):
    return lookup.suspicious_escapes(derived(spark, d, LINES)).select("k", "kind")


SEEN = "SELECT scope, CASE WHEN ord % 4 = 0 THEN 'v_' || CAST(x AS STRING) ELSE id END AS id, ord % 3 AS n, 0.3D + ord * 0.07D AS p FROM (" + FORMS + ")"
_SEEN = plain(SEEN.replace("0.3D", "0.3::DOUBLE").replace("0.07D", "0.07::DOUBLE"))


@query("j01_detection_elements", f"SELECT s.scope AS scope, s.id AS id, f.name AS name, f.id IS NOT NULL AS anchored FROM {_SEEN} s LEFT JOIN {_F} f ON s.scope = f.scope AND s.id = f.id")
def _(spark, d):
    return lookup.with_elements(derived(spark, d, SEEN), derived(spark, d, FORMS).select("scope", "id", "name")).select("scope", "id", "name", "anchored")


@query("j02_element_findings", f"SELECT f.scope AS scope, f.id AS id, g.cls AS classes FROM {_F} f LEFT JOIN (SELECT scope, id, string_agg(cls, ',' ORDER BY cls) AS cls FROM (SELECT scope, id, unnest(CASE WHEN n = 0 THEN ['otp'] ELSE ['phone', 'email'] END) AS cls FROM {_SEEN}) GROUP BY scope, id) g ON f.scope = g.scope AND f.id = g.id")
def _(spark, d):
    found = derived(spark, d, SEEN).select("scope", "id", F.explode(F.when(F.col("n") == 0, F.array(F.lit("otp"))).otherwise(F.array(F.lit("phone"), F.lit("email")))).alias("cls"), F.lit("substitute").alias("fate"))
    return lookup.with_findings(derived(spark, d, FORMS), found).select("scope", "id", F.array_join(F.transform("found", lambda f: f["cls"]), ",").alias("classes"))


NESTED = "SELECT scope, id, role, tag, name, label, placeholder, CASE WHEN ord = 6 THEN 'el_' || CAST(scope * 10 + 1 + scope % 3 AS STRING) END AS parent FROM (" + FORMS + ")"


@query("j03_image_context", f"SELECT scope, id, 'Passport photo ' || CASE scope % 3 WHEN 0 THEN 'Email address' WHEN 1 THEN 'Mobile number' ELSE 'Password' END AS context FROM {_F} WHERE tag = 'img'")
def _(spark, d):
    return lookup.image_context(derived(spark, d, NESTED))


HELD = "SELECT o_custkey AS scope, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN ' EMAIL_1' WHEN 1 THEN 'CARD_1 ' ELSE 'PHONE_9' END AS value FROM {orders}"


@query("j09_resolved_handles", f"SELECT scope, k, CASE trim(value) WHEN 'EMAIL_1' THEN 'u' || CAST(scope AS VARCHAR) WHEN 'CARD_1' THEN '4' || CAST(scope AS VARCHAR) END AS plain FROM {plain(HELD)}")
def _(spark, d):
    vault = derived(spark, d, "SELECT c_custkey AS scope, 'EMAIL_1' AS handle, 'u' || CAST(c_custkey AS STRING) AS value FROM {customer} UNION ALL SELECT c_custkey, 'CARD_1', '4' || CAST(c_custkey AS STRING) FROM {customer}")
    return lookup.resolved_handles(derived(spark, d, HELD), vault).select("scope", "k", "plain")


MIXED = "SELECT scope, id, CASE WHEN ord % 3 = 2 THEN 'text' ELSE 'value' END AS field, CASE WHEN scope % 2 = 0 AND ord % 3 = 0 THEN 'drop' ELSE 'substitute' END AS fate FROM (" + FORMS + ") UNION ALL SELECT scope, id, 'value', 'substitute' FROM (" + FORMS + ")"


@query("j10_unsubsumed", f"WITH m AS (SELECT * FROM {plain(MIXED)}) SELECT scope, id, field, fate FROM m WHERE NOT (field = 'value' AND fate <> 'drop' AND EXISTS (SELECT 1 FROM m n WHERE n.scope = m.scope AND n.id = m.id AND n.field = 'value' AND n.fate = 'drop'))")
def _(spark, d):
    return fusion.unsubsumed(derived(spark, d, MIXED)).select("scope", "id", "field", "fate")


@query("j12_not_asked", f"SELECT DISTINCT run, target FROM {_S} s WHERE NOT EXISTS (SELECT 1 FROM {_S} h WHERE h.run = s.run AND h.target = s.target AND h.kind = 'ask_user' AND h.result = 'failed')")
def _(spark, d):
    steps = derived(spark, d, STEPS)
    fields = steps.select(F.col("run").alias("scope"), F.col("target").alias("id")).distinct()
    rest = lookup.not_asked(fields, steps.filter("result = 'failed'").select(F.col("run").alias("scope"), F.col("kind").alias("action"), "target"))
    return rest.select(F.col("scope").alias("run"), F.col("id").alias("target"))


SHIFTED = "SELECT p_partkey AS k, repeat(p_brand || '  ', 2) || lower(p_name) || ' aaaa ' || p_brand AS raw, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'aa' WHEN 2 THEN 'e' ELSE 'absent' END AS wanted, CAST(p_partkey % 40 AS INT) AS start FROM {part}"


@query("j15_realigned", f"SELECT k, coalesce(list_sort([{{'d': abs(i - start), 'i': i}} FOR i IN range(0, length(raw)) IF substr(raw, i + 1, length(wanted)) = wanted])[1].i, start)::INT AS place FROM {plain(SHIFTED)}")
def _(spark, d):
    return derived(spark, d, SHIFTED).select("k", lookup.realigned(F.col("raw"), F.col("wanted"), F.col("start")).alias("place"))


@query("a01_grouped", f"SELECT scope, id, cls, count(*) AS n FROM {plain(OPINIONS)} GROUP BY scope, id, field, cls")
def _(spark, d):
    rows = derived(spark, d, OPINIONS).withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int"))
    return fusion.grouped(rows).select("scope", "id", "cls", F.col("n_detections").alias("n"))


@query("a07_verdict", "SELECT o_orderkey AS scope, o_orderkey % 2 = 0 AS passed FROM orders")
def _(spark, d):
    leak = F.when(F.col("scope") % 2 == 0, "EMAIL_1").otherwise("a@b.org")
    safe = derived(spark, d, "SELECT o_orderkey AS scope FROM {orders}").select("scope", F.lit(0).alias("ord"), F.lit("el_1").alias("id"), F.lit("textbox").alias("role"), F.lit("Mail").alias("name"), leak.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("holds", "wants")], F.lit(False).alias("sensitive"), F.lit(False).alias("empty"))
    vault = safe.select("scope", F.lit("EMAIL_1").alias("handle"), F.lit("c@d.org").alias("value"))
    return verify.verify(redact.serialise(safe), vault).select("scope", "passed")


@query("o03_budget", f"SELECT scope, node FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pass, node) AS r FROM (SELECT l_suppkey AS scope, l_orderkey * 10 + l_linenumber AS node, l_partkey % 3 + 1 AS pass FROM lineitem)) WHERE r <= 400")
def _(spark, d):
    rows = derived(spark, d, "SELECT l_suppkey AS scope, l_orderkey * 10 + l_linenumber AS node, l_partkey % 3 + 1 AS pass FROM {lineitem}")
    return lookup.within_budget(rows).select("scope", "node")


@query("o08_offered", f"SELECT scope, array_to_string(list(name ORDER BY r), '|') AS options FROM (SELECT scope, name, row_number() OVER (PARTITION BY scope ORDER BY length(name) % 5 DESC, ord) AS r FROM {_C} WHERE length(name) % 5 > 0) WHERE r <= 3 GROUP BY scope")
def _(spark, d):
    scores = derived(spark, d, CONTROLS).select("scope", "ord", "name", (F.length("name") % 5).cast("double").alias("score"))
    return lookup.offered(scores).select("scope", F.array_join("options", "|").alias("options"))


PASSES = "SELECT l_orderkey AS scope, l_partkey % 4 AS node, CAST(l_linenumber AS INT) AS pass FROM {lineitem}"


@query("u02_first_pass", f"SELECT scope, node, min(pass) AS pass FROM {plain(PASSES)} GROUP BY scope, node")
def _(spark, d):
    return lookup.first_pass(derived(spark, d, PASSES))


@query("u03_distinct_unknown_keys", "SELECT o_orderkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 'secret,token' ELSE '' END AS bad FROM orders")
def _(spark, d):
    rows = derived(spark, d, "SELECT o_orderkey AS k FROM {orders}")
    body = F.when(F.col("k") % 2 == 0, '{"schema":"sanitized/1","token":1,"elements":[{"id":"a","secret":1},{"id":"b","secret":2,"token":3}]}').otherwise('{"schema":"sanitized/1","elements":[]}')
    return rows.select("k", F.array_join(F.array_sort(F.array_distinct(verify.unknown_keys(body))), ",").alias("bad"))


@query("f31_preprocessed", f"SELECT scope, ox, oy, (luma - 127) / 128.0::DOUBLE AS v FROM {_P} p JOIN (SELECT unnest(range(0, 32))::INT AS ox) a ON least(127, floor(ox * 128 / 32.0)) = p.x JOIN (SELECT unnest(range(0, 24))::INT AS oy) b ON least(95, floor(oy * 96 / 24.0)) = p.y")
def _(spark, d):
    return spatial.preprocessed(derived(spark, d, PIXELS), 128, 96, 32, 24)


def _fused(spark, d, cls):
    e = derived(spark, d, FORMS)
    none = F.lit(None).cast("int")
    seen = derived(spark, d, SEEN).select("scope", "id", F.lit("element").alias("field"), none.alias("start"), none.alias("end"), F.lit(cls).alias("cls"), "p", F.lit("vision").alias("source"))
    return fusion.fuse(e, seen)


_NOISY = f"(SELECT s.scope AS scope, s.id AS id, f.id IS NOT NULL AS anchored, 1 - product(1 - s.p) AS p FROM {_SEEN} s LEFT JOIN {_F} f ON s.scope = f.scope AND s.id = f.id GROUP BY s.scope, s.id, f.id)"


@query("d19_visual_findings", f"SELECT scope, id, round(p, 6) AS p, 'mask' AS fate, anchored FROM {_NOISY} WHERE p >= 0.35")
def _(spark, d):
    return _fused(spark, d, "face").select("scope", "id", six(F.col("p")).alias("p"), "fate", "anchored")


@query("d20_unanchored", f"SELECT scope, id, round(p, 6) AS p FROM {_NOISY} WHERE NOT anchored AND p >= 0.8")
def _(spark, d):
    return _fused(spark, d, "email").filter("not anchored").select("scope", "id", six(F.col("p")).alias("p"))


def _blank(spark, d):
    e = derived(spark, d, FORMS)
    return e, cut(fusion.fuse(e, _detections(e)))


_BLANK = f"(SELECT * FROM {_F} WHERE tag = 'textarea' AND value IS NULL)"


@query("r03_wants", f"SELECT scope, id, 'ADDR_' || CAST(1 + (SELECT count(*) FROM {_F} o WHERE o.scope = b.scope AND o.tag = 'textarea' AND o.ord < b.ord) AS VARCHAR) AS wants FROM {_BLANK} b")
def _(spark, d):
    from ..sources import profile as profiles

    safe, _ = redact.redact(*_blank(spark, d), profiles.profile(spark, {"address": "1 Main street"}))
    return safe.filter("wants is not null").select("scope", "id", "wants")


@query("r04_vault_locked", f"SELECT scope, bool_or(tag = 'textarea' AND value IS NULL) AS locked FROM {_F} GROUP BY scope")
def _(spark, d):
    return lookup.vault_locked(*_blank(spark, d))


@query("r05_empty", f"SELECT scope, id FROM {_BLANK}")
def _(spark, d):
    return redact.redact(*_blank(spark, d))[0].filter("empty").select("scope", "id")


@query("r09_hardened", f"SELECT scope, id, CAST(NULL AS VARCHAR) AS holds, sensitive OR holds IS NOT NULL AS sensitive FROM {plain(SAFE)}")
def _(spark, d):
    return verify.harden(derived(spark, d, SAFE)).select("scope", "id", "holds", "sensitive")


@query("r10_masked_pixels", f"SELECT scope, x, y, CASE WHEN x >= 6 AND x < 34 AND y >= 6 AND y < 34 THEN 0 ELSE luma END AS luma FROM {_P}")
def _(spark, d):
    px = derived(spark, d, PIXELS)
    boxes = px.select("scope", *[F.lit(v).alias(c) for c, v in (("x", 10), ("y", 10), ("w", 20), ("h", 20))]).distinct()
    return spatial.mask(px, boxes)
