"""Queries of spatial, agent, metric, source and stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ROUTER_STOP
from ..operators import agent, metrics, spatial
from ..schema import opaque
from ..sources import html as pages_
from ..sources import tables as sources
from ..streaming import guards, vault
from .base import ORACLE_SQL, BOXES, CONTROLS, FORMS, STEPS, TASKS, derived, plain, query, six
from .scalars import sql_cover, sql_tokens

_B, _F, _S, _C, _T = plain(BOXES), plain(FORMS), plain(STEPS), plain(CONTROLS), plain(TASKS)

ELEMENT_BOXES = "SELECT scope, ord, 'el_' || CAST(ord AS STRING) AS id, x, y, w, h, ord % 4 <> 0 AS visible, CASE WHEN ord = 3 THEN 'img' ELSE 'p' END AS tag, CASE WHEN ord = 5 THEN 'other' ELSE 'text' END AS role FROM (" + BOXES + ")"
_E = plain(ELEMENT_BOXES)


@query(
    "g01_covered_cells",
    f"""SELECT DISTINCT scope, cx, cy FROM (SELECT scope, unnest(range(x0, x1 + 1)) AS cx, y0, y1 FROM (SELECT scope, CAST(greatest(floor(x / 32.0), 0) AS BIGINT) AS x0, CAST(least(floor((x + w) / 32.0), 19) AS BIGINT) AS x1, CAST(greatest(floor(y / 32.0), 0) AS BIGINT) AS y0, CAST(least(floor((y + h) / 32.0), 14) AS BIGINT) AS y1
    FROM {_E} WHERE visible AND tag <> 'img' AND role <> 'other' AND w * h <= 184320) WHERE x0 <= x1 AND y0 <= y1), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS cy)""",
)
def _(spark, d):
    return spatial.covered_cells(derived(spark, d, ELEMENT_BOXES), 640, 480)


@query("a10_coverage", f"SELECT scope, count(*) AS covered, CAST(floor(count(*) * 100.0 / 300 + 0.5) AS BIGINT) AS pct FROM (SELECT DISTINCT scope, x // 32 AS cx, y // 32 AS cy FROM {_E}) GROUP BY scope")
def _(spark, d):
    cells = derived(spark, d, ELEMENT_BOXES).select("scope", F.floor(F.col("x") / 32).alias("cx"), F.floor(F.col("y") / 32).alias("cy"))
    return metrics.coverage_share(cells, 20, 15)


PIXELS = "SELECT CAST(user_id AS BIGINT) AS scope, CAST((event_id * 2) % 128 AS INT) AS x, CAST(floor(event_id / 64) AS INT) % 96 AS y, CAST(floor(value * 7) AS BIGINT) % 256 AS luma FROM {events}"


@query("a09_cell_variance", f"SELECT scope, CAST(x // 32 AS BIGINT) AS cx, CAST(y // 32 AS BIGINT) AS cy, round(CASE WHEN count(*) > 1 THEN greatest(0.0, var_pop(luma)) ELSE 0.0 END + 1e-7, 3) AS variance FROM {plain(PIXELS)} WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY scope, cx, cy")
def _(spark, d):
    return spatial.cell_variance(derived(spark, d, PIXELS)).select("scope", "cx", "cy", F.round(F.col("variance") + 1e-7, 3).alias("variance"))


@query("g02_candidate_cells", f"SELECT scope, cx, cy FROM (SELECT scope, CAST(x // 32 AS BIGINT) AS cx, CAST(y // 32 AS BIGINT) AS cy, var_pop(luma) AS v, count(*) AS n FROM {plain(PIXELS)} WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY scope, cx, cy) WHERE v >= 120 AND n > 1 AND NOT (cx = 1 AND cy = 1)")
def _(spark, d):
    v = spatial.cell_variance(derived(spark, d, PIXELS))
    covered = v.select("scope", F.lit(1).cast("long").alias("cx"), F.lit(1).cast("long").alias("cy")).distinct()
    return spatial.candidate_cells(v, covered).select("scope", "cx", "cy")


CELLS = "SELECT l_orderkey AS scope, CAST(l_partkey % 6 AS BIGINT) AS cx, CAST(l_suppkey % 5 AS BIGINT) AS cy FROM {lineitem}"


@query(
    "g03_connected_regions",
    f"""WITH RECURSIVE c AS (SELECT DISTINCT scope, cx, cy FROM {plain(CELLS)}), r AS (SELECT scope, cx AS sx, cy AS sy, cx, cy FROM c UNION SELECT r.scope, r.sx, r.sy, c.cx, c.cy FROM r JOIN c ON r.scope = c.scope AND abs(r.cx - c.cx) + abs(r.cy - c.cy) = 1)
    SELECT DISTINCT scope, x, y, w, h, n_cells FROM (SELECT scope, sx, sy, min(cx) * 32 AS x, min(cy) * 32 AS y, (max(cx) - min(cx) + 1) * 32 AS w, (max(cy) - min(cy) + 1) * 32 AS h, count(*) AS n_cells, min(cx * 100 + cy) AS id FROM r GROUP BY scope, sx, sy) WHERE n_cells > 1""",
)
def _(spark, d):
    return spatial.connected_regions(derived(spark, d, CELLS)).distinct()


VISION = "SELECT scope, ord AS box_id, x + 3 AS x, y + 2 AS y, w, h, 0.5 + p * 4 AS score, CASE WHEN ord % 2 = 0 THEN 'face' ELSE 'document' END AS cls FROM (" + BOXES + ")"
_V = plain(VISION)
_I = "(greatest(least(v.x + v.w, e.x + e.w) - greatest(v.x, e.x), 0) * greatest(least(v.y + v.h, e.y + e.h) - greatest(v.y, e.y), 0))"


@query(
    "j05_anchor",
    f"""SELECT scope, box_id, round(max(score), 6) AS score FROM (SELECT v.scope AS scope, v.box_id AS box_id, greatest(CAST({_I} AS DOUBLE) / (v.w * v.h + e.w * e.h - {_I}), CAST({_I} AS DOUBLE) / (v.w * v.h)) AS score, CAST({_I} AS DOUBLE) / (v.w * v.h + e.w * e.h - {_I}) AS iou, CAST({_I} AS DOUBLE) / (v.w * v.h) AS inside
    FROM {_V} v JOIN {_E} e ON v.scope = e.scope WHERE {_I} > 0) WHERE iou > 0.5 OR inside > 0.8 GROUP BY scope, box_id""",
)
def _(spark, d):
    return spatial.anchor(derived(spark, d, VISION), derived(spark, d, ELEMENT_BOXES)).select("scope", "box_id", six(F.col("score")).alias("score"))


def _greedy(source: str, keys: str, order: str, drop: str, out: str) -> str:
    """Box by box in order: one that `drop` says nothing against, given a box e kept before, is kept."""
    on = " AND ".join(f"r.{k} = w.{k}" for k in keys.split(", "))
    own = "struct_pack(x := {0}x, y := {0}y, w := {0}w, h := {0}h)"
    return f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM {source}),
    walk AS (SELECT *, [{own.format("")}] AS kept, true AS stays FROM s WHERE k = 1
      UNION ALL SELECT r.*, CASE WHEN ok THEN list_append(old, {own.format("r.")}) ELSE old END, ok FROM (
        SELECT r, w.kept AS old, len([e FOR e IN w.kept IF {drop}]) = 0 AS ok FROM walk w JOIN s r ON {on} AND r.k = w.k + 1))
    SELECT {out} FROM walk WHERE stays"""


_X = "(greatest(least(r.x + r.w, e.x + e.w) - greatest(r.x, e.x), 0) * greatest(least(r.y + r.h, e.y + e.h) - greatest(r.y, e.y), 0))"
_KEPT = "scope, box_id, x, y, w, h, cls, round(score, 6) AS score"


@query("j06_add_unless_overlapping", _greedy(f"(SELECT scope, CASE WHEN ord = 1 THEN -1 ELSE ord END AS ord, x, y, w, h FROM {_B} WHERE ord >= 1)", "scope", "ord, x, y, w, h", f"r.ord >= 0 AND {_X} > 0", "scope, ord, x, y, w, h"))
def _(spark, d):
    return spatial.add_unless_overlapping(derived(spark, d, BOXES).filter("ord = 1"), derived(spark, d, BOXES).filter("ord > 1")).select("scope", "ord", *"xywh")


@query("g04_nms", _greedy(f"(SELECT * FROM {_V} WHERE score >= CAST(0.7 AS DOUBLE))", "scope", "score DESC, box_id, x, y, w, h, cls", f"CAST({_X} AS DOUBLE) / (r.w * r.h + e.w * e.h - {_X}) > CAST(0.4 AS DOUBLE)", _KEPT))
def _(spark, d):
    return spatial.nms(derived(spark, d, VISION)).select("scope", "box_id", *"xywh", "cls", six(F.col("score")).alias("score"))


@query("g05_dedupe_regions", _greedy(_V, "scope, cls", "score DESC, box_id, x, y, w, h, cls", f"{_X} > CAST(0.35 AS DOUBLE) * least(r.w * r.h, e.w * e.h)", _KEPT))
def _(spark, d):
    return spatial.dedupe_regions(derived(spark, d, VISION)).select("scope", "box_id", *"xywh", "cls", six(F.col("score")).alias("score"))


@query("g06_rescale", f"SELECT scope, ord, round(x * 1280.0 / 768, 6) AS css FROM {_B}")
def _(spark, d):
    return derived(spark, d, BOXES).select("scope", "ord", six(spatial.scaled(F.col("x"), 768, 1280)).alias("css"))


@query("a11_union_box", f"SELECT scope, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM {_B} GROUP BY scope")
def _(spark, d):
    return spatial.union_box(derived(spark, d, BOXES), "scope")


@query("a17_frame_saved", f"SELECT scope, round(1 - CAST(sum(w * h) AS DOUBLE) / 307200, 6) AS saved FROM {_B} GROUP BY scope")
def _(spark, d):
    return metrics.frame_saved(derived(spark, d, BOXES), 640, 480).select("scope", six(F.col("saved")).alias("saved"))


@query("p04_opaque_regions", f"SELECT scope, id, x, y, w, h FROM {_E} WHERE visible AND tag = 'img' AND w >= 24 AND h >= 24")
def _(spark, d):
    return spatial.opaque_regions(derived(spark, d, ELEMENT_BOXES))


@query("o02_largest", f"SELECT scope, w * h AS area FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY w * h DESC, x, y) AS r FROM {_B}) WHERE r <= 3")
def _(spark, d):
    return spatial.largest(derived(spark, d, BOXES), 3).select("scope", (F.col("w") * F.col("h")).alias("area"))


@query("o04_crops", f"SELECT scope, w * h AS area FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY w * h DESC, x, y) AS r FROM {_B}) WHERE r <= 6 AND w >= 24 AND h >= 24")
def _(spark, d):
    return spatial.crops(derived(spark, d, BOXES)).select("scope", (F.col("w") * F.col("h")).alias("area"))


@query("v03_mask_audit", f"SELECT DISTINCT scope, true AS clean FROM {plain(PIXELS)} WHERE x >= 10 AND x < 30 AND y >= 10 AND y < 30")
def _(spark, d):
    px = derived(spark, d, PIXELS)
    boxes = px.select("scope", *[F.lit(v).alias(c) for c, v in (("x", 10), ("y", 10), ("w", 20), ("h", 20))]).distinct()
    return spatial.mask_audit(spatial.mask(px, boxes), boxes)


LABELLED = "SELECT scope, ord AS box_id, CASE WHEN ord % 3 = 0 THEN 'menu' WHEN ord % 3 = 1 THEN 'monitor' ELSE 'cat' END AS label, p + 0.05 AS score FROM (" + BOXES + ")"


@query("f29_classify", f"SELECT scope, box_id, round(max(score) * 0.5, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY scope, box_id ORDER BY score DESC, label) AS r FROM {plain(LABELLED)}) WHERE r <= 3 AND label <> 'cat' AND score > 0.1 GROUP BY scope, box_id")
def _(spark, d):
    return spatial.classify(derived(spark, d, LABELLED)).select("scope", "box_id", six(F.col("score")).alias("score"))


@query("w04_reading_order", f"SELECT scope, ord, x, y, row_number() OVER (PARTITION BY scope ORDER BY y, x, ord, w, h, p, q, shipped) AS reading FROM {_B}")
def _(spark, d):
    from pyspark.sql import Window

    rows = derived(spark, d, BOXES)
    return rows.select("scope", "ord", "x", "y", F.row_number().over(Window.partitionBy("scope").orderBy("y", "x", "ord", "w", "h", "p", "q", "shipped")).cast("long").alias("reading"))


@query("w07_top_margin", f"SELECT scope, top, round(top - second, 6) AS margin FROM (SELECT scope, w AS top, lead(w) OVER (PARTITION BY scope ORDER BY w DESC, ord) AS second, row_number() OVER (PARTITION BY scope ORDER BY w DESC, ord) AS r FROM {_B}) WHERE r = 1")
def _(spark, d):
    return metrics.top_margin(derived(spark, d, BOXES).select("scope", "ord", F.col("w").alias("score"))).select("scope", "top", six(F.col("margin")).alias("margin"))


@query("p02_clickable", f"SELECT scope, id FROM {_C} WHERE enabled AND (visible OR offscreen)")
def _(spark, d):
    return agent.clickable(derived(spark, d, CONTROLS)).select("scope", "id")


def _tasks(spark, d):
    return derived(spark, d, TASKS)




_NAME = f"CASE WHEN length(trim(name)) <= 24 AND contains(lower(task), lower(trim(name))) AND len({sql_tokens('name', ROUTER_STOP)}) > 0 THEN greatest({sql_cover(ROUTER_STOP)}, 0.95) ELSE {sql_cover(ROUTER_STOP)} END"
_VERB = r"regexp_matches(task, '(?i)\b(click|press|clear)\b')"


@query(
    "l01_router",
    f"""WITH m AS (SELECT t.scope AS scope, t.task AS task, t.step AS step, c.id AS id, c.ord AS ord, c.name AS name, lower(trim(regexp_extract(t.task, '"([^"]{{2,40}})"', 1))) AS q FROM {_T} t LEFT JOIN {_C} c ON t.scope = c.scope AND c.enabled AND (c.visible OR c.offscreen)),
    s AS (SELECT *, {_NAME} AS s, CASE WHEN {_VERB} THEN 0.6 ELSE 0.85 END AS need FROM m),
    a AS (SELECT scope, task, step, count(*) FILTER (q <> '' AND lower(trim(name)) = q) AS ne, min(id) FILTER (q <> '' AND lower(trim(name)) = q) AS ie, count(*) FILTER (q <> '' AND contains(lower(name), q)) AS np, min(id) FILTER (q <> '' AND contains(lower(name), q)) AS ip, list_reverse_sort(list(s) FILTER (s >= need)) AS l, arg_max(id, s) FILTER (s >= need) AS top FROM s GROUP BY scope, task, step)
    SELECT scope, CASE WHEN trim(task) = '' THEN 'done' WHEN task = 'scroll down' AND step = 0 THEN 'local' WHEN task = 'clear everything' THEN CASE WHEN step = 0 THEN 'local' ELSE 'done' END WHEN task = 'fill this form' THEN 'server' WHEN ne = 1 OR np = 1 OR len(l) = 1 OR len(l) > 1 AND l[1] - l[2] >= 0.25 THEN 'local' ELSE 'server' END AS route,
    CASE WHEN trim(task) = '' OR task IN ('scroll down', 'clear everything', 'fill this form') THEN NULL WHEN ne = 1 THEN ie WHEN np = 1 THEN ip WHEN len(l) = 1 OR len(l) > 1 AND l[1] - l[2] >= 0.25 THEN top END AS target FROM a""",
)
def _(spark, d):
    return agent.route(_tasks(spark, d), derived(spark, d, CONTROLS)).select("scope", "route", "target")


_EXPECTED = "CASE WHEN scope % 8 IN (0, 2, 3) THEN 'local' WHEN scope % 8 = 5 THEN 'done' ELSE 'server' END"


@query("a18_scorecard", f"SELECT count(*) FILTER (route = {_EXPECTED}) AS passed, count(*) FILTER (route = 'local') AS local, count(*) AS total FROM ({ORACLE_SQL['l01_router']})")
def _(spark, d):
    routed = agent.route(_tasks(spark, d), derived(spark, d, CONTROLS))
    return metrics.scorecard(routed.withColumn("expected", F.expr(_EXPECTED)))


SAFE = """SELECT scope, ord, id, CASE WHEN role = 'heading' THEN 'button' ELSE role END AS role, name, enabled, visible, offscreen, CASE WHEN c % 10 = 1 THEN 'EMAIL_' || CAST(ord AS STRING) END AS holds, CASE WHEN c % 40 = 0 THEN 'PERSON_1' END AS wants, role = 'password' AS sensitive, ord = 6 AS empty
FROM (SELECT *, ord + scope * 10 AS c FROM (""" + FORMS + "))"
PLANNED = "SELECT scope, CASE CAST(scope AS BIGINT) % 5 WHEN 0 THEN 'fill the form' WHEN 1 THEN 'contact phone' WHEN 2 THEN 'what is here' WHEN 3 THEN 'reset it' ELSE 'nothing of note' END AS task, scope % 2 = 0 AS more_below FROM (SELECT DISTINCT scope FROM (" + FORMS + "))"


@query(
    "l02_planner",
    f"""WITH u AS (SELECT * FROM {plain(SAFE)} WHERE enabled AND (visible OR offscreen)), t AS (SELECT * FROM {plain(PLANNED)}),
    f AS (SELECT scope, min(ord) FILTER (wants IS NOT NULL AND role IN ('textbox', 'password', 'select')) AS fill, min(ord) FILTER (sensitive) AS secret, min(ord) FILTER (empty AND role = 'textbox') AS blank, count(*) FILTER (role = 'button') AS b FROM u GROUP BY scope)
    SELECT t.scope AS scope, CASE WHEN task = 'what is here' THEN 'data' WHEN task = 'reset it' THEN 'action' WHEN task = 'fill the form' THEN CASE WHEN fill IS NOT NULL THEN 'action' WHEN secret IS NOT NULL OR blank IS NOT NULL THEN 'ask_user' WHEN more_below THEN 'action' ELSE 'data' END
      WHEN task = 'contact phone' AND b > 0 THEN 'action' WHEN more_below THEN 'action' ELSE 'data' END AS type,
    CASE WHEN task = 'what is here' THEN NULL WHEN task = 'reset it' THEN 'clear' WHEN task = 'fill the form' THEN CASE WHEN fill IS NOT NULL THEN 'fill' WHEN secret IS NOT NULL OR blank IS NOT NULL THEN NULL WHEN more_below THEN 'scroll' END WHEN task = 'contact phone' AND b > 0 THEN 'click' WHEN more_below THEN 'scroll' END AS kind
    FROM t LEFT JOIN f ON t.scope = f.scope""",
)
def _(spark, d):
    return agent.plan(derived(spark, d, PLANNED), derived(spark, d, SAFE)).select("scope", "type", "kind")


@query("a13_answer", f"SELECT scope, count(*) AS n_elements, count(holds) AS n_handles, CASE WHEN count(holds) > 0 THEN 'EMAIL' ELSE '' END AS kinds, count(*) FILTER (sensitive) AS n_secret FROM {plain(SAFE)} GROUP BY scope")
def _(spark, d):
    return agent.answer(derived(spark, d, SAFE)).select("scope", "n_elements", "n_handles", "kinds", "n_secret")


@query("p09_pruned", f"SELECT scope, id FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ord) AS r FROM {plain(SAFE)} WHERE role IN ('button', 'link', 'textbox', 'password', 'select', 'checkbox', 'radio')) WHERE r <= 5")
def _(spark, d):
    return agent.pruned(derived(spark, d, SAFE), 5).select("scope", "id")


ACTIONS = """SELECT id AS k, CASE CAST(scope * 10 + ord AS BIGINT) % 7 WHEN 0 THEN 'navigate' WHEN 1 THEN 'scroll' WHEN 2 THEN 'click' ELSE 'fill' END AS kind, CASE CAST(scope * 10 + ord AS BIGINT) % 7 WHEN 0 THEN CASE WHEN ord % 2 = 0 THEN 'https://a.example.org/x' ELSE 'ftp://x' END WHEN 3 THEN 'EMAIL_1' WHEN 4 THEN 'EMAIL_9' WHEN 5 THEN 'a@b.org' WHEN 6 THEN 'plain words' END AS value, id AS target,
 CAST(CASE WHEN scope % 20 = 0 THEN 25 ELSE 1 END AS INT) AS step, false AS autofill, CASE WHEN CAST(scope * 10 + ord AS BIGINT) % 7 = 3 THEN 'email' END AS v_cls, CASE WHEN CAST(scope * 10 + ord AS BIGINT) % 7 = 3 THEN 'v@x.org' END AS v_value,
 id AS e_id, role AS e_role, tag AS e_tag, type AS e_type, CASE WHEN ord = 8 THEN 'Submit now' ELSE name END AS e_name, label AS e_label, placeholder AS e_placeholder, autocomplete AS e_autocomplete, h AS e_h, visible AS e_visible, offscreen AS e_offscreen, enabled AS e_enabled, text AS e_text FROM (""" + FORMS + ")"


@query(
    "k02_policy",
    f"""SELECT k, reason IN ('navigation needs approval', 'non-mutating', 'irreversible', 'ok') AS allow, reason FROM (SELECT k, CASE WHEN step >= 25 THEN 'step cap' WHEN kind = 'navigate' AND value LIKE 'ftp%' THEN 'not http' WHEN kind = 'navigate' THEN 'navigation needs approval' WHEN kind = 'scroll' THEN 'non-mutating' WHEN NOT e_visible AND NOT e_offscreen THEN 'target covered' WHEN NOT e_enabled THEN 'target disabled'
    WHEN value = 'EMAIL_9' THEN 'unknown handle' WHEN value = 'EMAIL_1' AND NOT (e_tag IN ('input', 'textarea') AND e_role <> 'password' AND regexp_matches(lower(concat_ws(' ', e_name, e_label, e_autocomplete, e_type)), 'e[\\s-]?mail') AND NOT (e_tag = 'textarea' AND e_h > 120)) THEN 'sink not allowed' WHEN value = 'a@b.org' THEN 'literal looks personal' WHEN kind = 'click' AND (e_name = 'Submit now' OR e_text LIKE '%Order%' OR e_text LIKE '%sent%' AND false) THEN 'irreversible' ELSE 'ok' END AS reason FROM {plain(ACTIONS)})""",
)
def _(spark, d):
    return agent.check_policy(derived(spark, d, ACTIONS)).select("k", "allow", "reason")


@query("k03_irreversible", r"SELECT p_partkey AS k, regexp_matches(p_type || ' order', '(?i)\border\b') AS irreversible FROM part")
def _(spark, d):
    rows = derived(spark, d, "SELECT p_partkey AS k, p_type || ' order' AS label FROM {part}")
    return rows.select("k", agent.says(F.col("label"), agent.IRREVERSIBLE).alias("irreversible"))


REPLIES = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '{{\"type\":\"action\",\"action\":{{\"kind\":\"click\",\"target\":\"el_' || CAST(o_orderkey AS STRING) || '\"}}}}' WHEN 1 THEN '{{\"type\":\"plan\",\"steps\":[{{\"kind\":\"fill\"}},{{\"kind\":\"click\"}},{{\"kind\":\"wait\"}},{{\"kind\":\"done\"}}],\"confidence\":0.9}}' WHEN 2 THEN '{{\"type\":\"magic\"}}' ELSE '{{\"type\":\"data\",\"answer\":\"x\"}}' END AS reply FROM {orders}"


@query("f28_validated", "SELECT k, CASE k % 4 WHEN 0 THEN 'action' WHEN 1 THEN 'plan' WHEN 2 THEN 'error' ELSE 'data' END AS type, CASE k % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'fill' END AS kind, CASE k % 4 WHEN 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, CAST(CASE k % 4 WHEN 1 THEN 3 ELSE 0 END AS INT) AS n_steps, CASE k % 4 WHEN 0 THEN 'execute' WHEN 1 THEN 'execute' WHEN 2 THEN 'stop' ELSE 'answer' END AS next FROM (SELECT o_orderkey AS k FROM orders)")
def _(spark, d):
    r = derived(spark, d, REPLIES).select("k", agent.validated(F.col("reply")).alias("r"))
    return r.select("k", "r.type", "r.kind", "r.confidence", "r.n_steps", agent.next_state(F.col("r.type")).alias("next"))


@query("s12_reply_json", "SELECT o_orderkey AS k, '{\"type\":\"data\",\"answer\":\"a } b\"}' AS reply FROM orders")
def _(spark, d):
    body = '{"type":"data","answer":"a } b"}'
    rows = derived(spark, d, "SELECT o_orderkey AS k FROM {orders}")
    text = F.when(F.col("k") % 2 == 0, f"Sure:\n```json\n{body}\n```").otherwise(f"I think {body} is best {{")
    return rows.select("k", agent.reply_json(text).alias("reply"))


@query("l04_model_first", "SELECT o_orderkey AS scope, CASE o_orderkey % 3 WHEN 0 THEN '{\"type\":\"data\"}' WHEN 1 THEN '{\"type\":\"error\",\"message\":\"blocked by the output guard\"}' ELSE '{\"type\":\"rule\"}' END AS reply FROM orders")
def _(spark, d):
    rows = derived(spark, d, "SELECT o_orderkey AS scope FROM {orders}")
    prompts = rows.select("scope", F.when(F.col("scope") % 3 == 0, '{"type":"data"}').when(F.col("scope") % 3 == 1, '{"type":"data","answer":"a@b.org"}').otherwise("no idea").alias("prompt"))
    return agent.planned(rows.withColumn("reply", F.lit('{"type":"rule"}')), prompts, _echo)


def _echo(prompts):
    return prompts


_echo.__annotations__ = {"prompts": __import__("pandas").Series, "return": __import__("pandas").Series}


@query("l05_clear_counts", f"SELECT scope, count(*) FILTER (enabled AND value IS NOT NULL AND ord % 3 > 0) AS cleared, count(*) FILTER (enabled AND value IS NOT NULL AND ord % 3 = 0) AS failed, count(*) FILTER (NOT enabled OR value IS NULL) AS skipped FROM {_F} GROUP BY scope")
def _(spark, d):
    rows = derived(spark, d, FORMS)
    return agent.clear_counts(rows.select("scope", F.col("value").alias("before"), F.when(F.col("ord") % 3 == 0, F.col("value")).alias("after"), "enabled"))


@query("l06_grounded", f"SELECT id, ord % 2 = 0 AS ok FROM {_F}")
def _(spark, d):
    from ..functions.text import signature

    rows = derived(spark, d, FORMS)
    s = lambda x: signature(*[F.col(c) for c in ("tag", "role", "name")], x, F.col("y"), F.col("w"), F.col("h"))
    return rows.select("id", agent.grounded(s(F.col("x")), s(F.col("x") + F.when(F.col("ord") % 2 == 0, 0).otherwise(64))).alias("ok"))


@query("j16_option_match", "SELECT n_regionkey AS scope, min(n_nationkey) AS option_value FROM (SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_nationkey AS o FROM nation) WHERE o IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey) GROUP BY n_regionkey")
def _(spark, d):
    rows = derived(spark, d, "SELECT CAST(n_regionkey AS INT) AS scope, n_nationkey AS ord, CAST(n_nationkey AS STRING) AS option_value, n_name AS option_text FROM {nation}")
    wanted = rows.groupBy("scope").agg(F.concat(F.lit(" "), F.lower(F.min_by("option_text", "ord"))).alias("value"))
    return agent.select_option(wanted, rows)


@query("j13_repeat_guard", f"SELECT run, step, coalesce(max(CASE WHEN result = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY run, kind, target ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS repeated FROM {_S}")
def _(spark, d):
    return metrics.repeat_guard(derived(spark, d, STEPS)).select("run", "step", "repeated")


@query("t04_ask_once", f"SELECT run, target, min(step) AS step FROM {_S} WHERE kind = 'ask_user' GROUP BY run, target")
def _(spark, d):
    return metrics.ask_once(derived(spark, d, STEPS).filter("kind = 'ask_user'")).select("run", "target", "step")


@query("t05_image_flag", f"SELECT run, step, coalesce(lag(type) OVER (PARTITION BY run ORDER BY step) = 'need_image', false) AS with_image FROM {_S}")
def _(spark, d):
    return metrics.image_flag(derived(spark, d, STEPS)).select("run", "step", "with_image")


@query("w05_stalls", f"SELECT run, step, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS stalled FROM (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY step) AS island FROM (SELECT *, CASE WHEN fp <> lag(fp) OVER (PARTITION BY run ORDER BY step) THEN 1 ELSE 0 END AS new FROM {_S}))")
def _(spark, d):
    return metrics.stalls(derived(spark, d, STEPS)).select("run", "step", F.col("stalled").cast("long").alias("stalled"))


@query("w06_last_history", f"SELECT run, step FROM (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM {_S}) WHERE r <= 6")
def _(spark, d):
    return metrics.last_rows(derived(spark, d, STEPS).withColumnRenamed("run", "scope")).select(F.col("scope").alias("run"), "step")


@query("a12_confusion", "SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (NOT t AND NOT f) AS tn FROM (SELECT toxic = 1 AS t, regexp_matches(text, 'idiot|moron|clown') AS f FROM labels JOIN documents USING (doc_id)))")
def _(spark, d):
    rows = derived(spark, d, "SELECT l.toxic AS toxic, d.text AS text FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id")
    c = metrics.confusion(rows, F.col("toxic") == 1, F.col("text").rlike("idiot|moron|clown"))
    return c.select("tp", "fp", "fn", "tn", *[six(F.col(n)).alias(n) for n in ("precision", "recall", "f1")])


@query("a14_network_totals", f"SELECT run, count(*) FILTER (route = 'server') AS n, coalesce(sum(bytes_up) FILTER (route = 'server'), 0)::BIGINT AS up, coalesce(sum(length(reply)) FILTER (route = 'server'), 0)::BIGINT AS down FROM {_S} GROUP BY run")
def _(spark, d):
    return metrics.network_totals(derived(spark, d, STEPS))


@query("a15_route_split", f"SELECT run, count(*) FILTER (route <> 'server') AS local, count(*) FILTER (route = 'server') AS server FROM {_S} GROUP BY run")
def _(spark, d):
    return metrics.route_split(derived(spark, d, STEPS))


@query("a16_stage_shares", "SELECT o_orderkey AS run, stage, round(ms / total, 6) AS share FROM (SELECT o_orderkey, unnest(['detect', 'fuse']) AS stage, unnest([o_orderkey % 7 + 1.0, o_orderkey % 5 + 1.0])::DOUBLE AS ms, (o_orderkey % 7 + o_orderkey % 5 + 2)::DOUBLE AS total FROM orders)")
def _(spark, d):
    rows = derived(spark, d, "SELECT o_orderkey AS run, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS detect, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS fuse FROM {orders}")
    return metrics.stage_shares(rows, ("detect", "fuse")).select("run", "stage", six(F.col("share")).alias("share"))


@query("a19_fingerprints", "SELECT conv_id AS scope, lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(s, '') IF c <> '']), lambda a, b: (xor(a, b) * 16777619) & 4294967295))), 8, '0') AS fp FROM (SELECT conv_id, string_agg(role || turn, '|' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)")
def _(spark, d):
    rows = derived(spark, d, "SELECT conv_id AS scope, turn AS ord, role || CAST(turn AS STRING) AS state FROM {conversations}")
    return metrics.fingerprint(rows)


@query("a21_run_summary", f"SELECT run, count(*) AS steps, count(*) FILTER (route = 'local') AS local, count(*) FILTER (route = 'server') AS server, coalesce(sum(bytes_up), 0)::BIGINT AS bytes, floor(avg(total_ms) FILTER (route = 'local') + 0.5)::BIGINT AS local_ms, floor(avg(total_ms) FILTER (route = 'server') + 0.5)::BIGINT AS server_ms, bool_or(vision LIKE '%degraded%') AS degraded FROM {_S} GROUP BY run")
def _(spark, d):
    return metrics.run_summary(derived(spark, d, STEPS))


@query("x01_windowed_telemetry", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, floor(avg(value) * 100 + 0.5) / 100.0 AS mean FROM events GROUP BY 1, 2")
def _(spark, d):
    out = metrics.windowed_telemetry(derived(spark, d, "SELECT ts, event_type, value FROM {events}"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "t01_guarded_steps",
    f"""WITH s AS (SELECT *, row_number() OVER w AS n, CASE WHEN fp <> lag(fp) OVER w THEN 1 ELSE 0 END AS new FROM {_S} WINDOW w AS (PARTITION BY run ORDER BY step)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY step) AS island FROM s),
    g AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS stalled,
      coalesce(max(CASE WHEN result = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY run, kind, target ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS repeated,
      kind = 'ask_user' AND row_number() OVER (PARTITION BY run, kind, target ORDER BY step) = 1 AS first_ask FROM i)
    SELECT run, step, fp, CAST(stalled AS INT) AS stalled, repeated, first_ask, CASE WHEN n >= 25 THEN 'step cap' WHEN stalled >= 2 THEN 'no progress' END AS stop FROM g""",
)
def _(spark, d):
    return guards.guarded(derived(spark, d, STEPS).select("run", "step", F.lit("t").alias("task"), "fp", "kind", "target", "result"))


@query("s01_page_elements")
def _(spark, d):
    kept = pages_.elements(pages_.nodes(derived(spark, d, "SELECT page_id, html FROM {pages}")))
    return kept.select("scope", "ord", "id", "role", "tag", "name", "text")


#: Each form of ten elements as a page: fields with labels before them, an image, a notice and a heading, in a form in a navigation bar.
FORM_PAGES = """
SELECT scope AS page_id, '<!DOCTYPE html><html><body><div role=navigation title="Bar ' || CAST(scope AS STRING) || '"><form aria-label=" Form  ' || CAST(scope AS STRING) || '">' ||
  array_join(transform(array_sort(collect_list(struct(ord, CASE tag WHEN 'input' THEN '<label for=f' || CAST(ord AS STRING) || '>' || name || ' <b>*</b></label><input id=f' || CAST(ord AS STRING) || ' type="' || type || '" value="' || coalesce(value, '') || '">'
    WHEN 'img' THEN '<img src=x alt="' || name || '">' WHEN 'p' THEN '<p>  ' || text || ' <i>now</i></p>' WHEN 'h2' THEN '<h2>' || name || '</h2>' ELSE '<textarea placeholder="' || name || '"></textarea>' END AS part))), x -> x.part), '') || '</form></div></body></html>' AS html
FROM ({forms}) GROUP BY scope
"""


def _form_pages(spark, d):
    return pages_.nodes(derived(spark, d, FORM_PAGES.replace("{forms}", FORMS)))


#: Where the elements stand in such a page: html, body, bar and form are 0 to 3, a field has a label and a <b> before it and a notice an <i> inside.
PLACED = f"""
SELECT *, CAST(3 + sum(CASE tag WHEN 'input' THEN 3 WHEN 'p' THEN 2 ELSE 1 END) OVER (PARTITION BY scope ORDER BY ord) - CASE WHEN tag = 'p' THEN 1 ELSE 0 END AS BIGINT) AS node FROM ({FORMS})
"""
#: Of these, what is kept, with its place in the order: fields and the text area, images, texts that may hold personal data; the bar itself is first.
_KEPT = f"""SELECT *, 1 + row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN tag IN ('input', 'textarea') THEN 1 WHEN tag = 'img' THEN 2 ELSE 3 END, node) AS place FROM {plain(PLACED)} WHERE tag <> 'h2' AND (tag <> 'p' OR regexp_matches(text, '[0-9]{{4}}|@'))"""


@query(
    "s01_form_elements",
    f"""SELECT scope, place AS ord, 'el_' || node AS id, CASE WHEN tag = 'img' THEN 'image' WHEN tag = 'p' THEN 'text' WHEN tag = 'input' AND type = 'password' THEN 'password' ELSE 'textbox' END AS role, tag,
      CASE tag WHEN 'input' THEN name || ' *' WHEN 'p' THEN text ELSE name END AS name, CASE WHEN tag = 'input' THEN value END AS value, CASE WHEN tag = 'p' THEN text END AS text, CASE WHEN tag = 'p' THEN node + 1 ELSE node END AS leave FROM ({_KEPT})""",
)
def _(spark, d):
    """Fields, images and texts that may hold personal data, of pages that are made of the forms."""
    kept = pages_.elements(_form_pages(spark, d), suspicious=True).filter("role <> 'navigation'")
    return kept.select("scope", F.col("ord").cast("long").alias("ord"), "id", "role", "tag", "name", "value", "text", F.col("leave").cast("long").alias("leave"))


@query("j04_nearest_kept", "SELECT page_id AS scope, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS links FROM pages")
def _(spark, d):
    """Links whose nearest kept ancestor is a list item."""
    kept = pages_.elements(pages_.nodes(derived(spark, d, "SELECT page_id, html FROM {pages}")))
    up = pages_.nearest_kept(kept)
    a = kept.filter("tag = 'a'").select("scope", "id").join(up, ["scope", "id"]).join(kept.filter("tag = 'li'").select("scope", F.col("id").alias("parent")), ["scope", "parent"], "left_semi")
    return a.groupBy("scope").agg(F.count("*").alias("links"))


@query(
    "j11_groups",
    r"""SELECT page_id AS scope, 'g_1' AS id, 'nav' AS kind, CAST(NULL AS VARCHAR) AS name, array_to_string(['el_' || (10 + 2 * i) FOR i IN range(n)], ',') AS children, n FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a ')) AS BIGINT) AS n FROM pages) WHERE n >= 2""",
)
def _(spark, d):
    """Navigation bars with two links or more; a page's list items have no text of their own."""
    found = pages_.nodes(derived(spark, d, "SELECT page_id, html FROM {pages}"))
    return pages_.groups(found, pages_.elements(found, suspicious=True)).select("scope", "id", "kind", "name", F.array_join("children", ",").alias("children"), "n")


@query(
    "j11_form_groups",
    f"""SELECT scope, g.id AS id, g.kind AS kind, g.name || ' ' || scope AS name, children, n, x, y, w, h FROM (SELECT scope, string_agg('el_' || node, ',' ORDER BY place) AS children, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({_KEPT}) GROUP BY scope HAVING count(*) >= 2),
      (VALUES ('g_1', 'form', 'Form'), ('g_2', 'nav', 'Bar')) g(id, kind, name)""",
)
def _(spark, d):
    """A form in a navigation bar, with names, children and union boxes."""
    found = _form_pages(spark, d)
    boxes = derived(spark, d, PLACED).select("scope", F.concat(F.lit("el_"), F.col("node").cast("string")).alias("id"), *"xywh")
    out = pages_.groups(found, pages_.elements(found, suspicious=True), boxes)
    return out.withColumn("children", F.array_join("children", ","))


#: Boxes of an order's lines as a tree of up to seven elements - 1 holds 2 and 3, these 4 and 5, and 6 and 7 - painted in an order of their own.
TREES = "SELECT scope, ord, 'el_' || CAST(ord AS STRING) AS id, x, y, w * 3 AS w, h * 2 AS h, CASE ord WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE ord END AS node, CASE ord WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 7 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE ord END AS leave, CAST((x + y) % 3 AS INT) AS z FROM (SELECT scope, ord, min(x) AS x, min(y) AS y, max(w) AS w, max(h) AS h FROM (" + BOXES + ") GROUP BY scope, ord)"


@query(
    "s07_visibility",
    f"""WITH t AS (SELECT *, x + w < 0 OR y + h < 0 OR x > 500 OR y > 300 AS off FROM {plain(TREES)}), p AS (SELECT *, least(greatest(x + w / 2, 1), 499) AS px, least(greatest(y + h / 2, 1), 299) AS py FROM t WHERE NOT off),
    m AS (SELECT p.scope, p.id, max({{'z': b.z, 'node': b.node, 'leave': b.leave, 'top': b.id}}) AS t FROM p JOIN t b ON p.scope = b.scope AND NOT b.off AND px >= b.x AND px < b.x + b.w AND py >= b.y AND py < b.y + b.h GROUP BY p.scope, p.id)
    SELECT t.scope AS scope, t.id AS id, NOT off AND coalesce(m.t.node <= node AND node <= m.t.leave OR node <= m.t.node AND m.t.node <= leave, false) AS visible, off AS offscreen, m.t.top AS hit FROM t LEFT JOIN m ON t.scope = m.scope AND t.id = m.id""",
)
def _(spark, d):
    """Elements whose centre is covered by one that is neither theirs nor around them are not visible."""
    return spatial.sighted(derived(spark, d, TREES), 500, 300).select("scope", "id", "visible", "offscreen", "hit")


#: Values found by each user's steps: two a step, tasks of some ten steps each.
FOUND = """
SELECT user_id AS run, ts, event_id AS step, CAST(o AS INT) AS ord, 'task ' || CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING) AS task, CASE WHEN (event_id + o) % 2 = 0 THEN 'email' ELSE 'phone' END AS cls,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN (event_id + o) % 2 = 0 THEN 'u' || CAST(event_id % 5 AS STRING) || '@example.com' ELSE CAST(9000000000 + event_id % 7 AS STRING) END AS value
FROM {events} CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) two
"""


@query(
    "t06_task_vaults",
    f"""WITH p AS (SELECT *, sum(CASE WHEN task IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts, step, ord) AS part FROM (SELECT *, lag(task) OVER (PARTITION BY run ORDER BY ts, step, ord) AS before FROM {plain(FOUND)})),
    f AS (SELECT *, min((ts, step, ord)) OVER (PARTITION BY run, part, cls, value) AS first FROM p)
    SELECT run, step, ord, task, cls, value, CASE WHEN value IS NOT NULL THEN upper(cls) || '_' || dense_rank() OVER (PARTITION BY run, part, cls, value IS NULL ORDER BY first) END AS handle FROM f""",
)
def _(spark, d):
    """Handles of each run's tasks: the same value has one within a task, and numbers begin anew with the next."""
    return vault.task_vaults(derived(spark, d, FOUND))


BODIES = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{{\"schema\":\"sanitized/1\",\"task\":\"x\",\"elements\":[{{\"id\":\"a\"}},{{\"id\":\"b\"}}]}}' WHEN 1 THEN '{{\"schema\":\"other\"}}' WHEN 2 THEN 'oops' ELSE '{{\"task\":\"x\"}}' END AS body FROM {orders}"


@query("s11_requests", "SELECT id, CASE WHEN id % 4 = 0 THEN 'x' END AS task, CAST(CASE WHEN id % 4 = 0 THEN 2 END AS INT) AS n_elements, CASE id % 4 WHEN 1 THEN 'unknown schema' WHEN 2 THEN 'not a request' WHEN 3 THEN 'not a request' END AS error FROM (SELECT o_orderkey AS id FROM orders)")
def _(spark, d):
    return sources.requests(derived(spark, d, BODIES))


@query("u04_opaque", f"SELECT id, tag = 'img' OR role = 'image' AS opaque FROM {_F}")
def _(spark, d):
    return derived(spark, d, FORMS).select("id", opaque(F.col("tag"), F.col("role")).alias("opaque"))


