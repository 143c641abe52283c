"""Nested sets of pages, visibility by hit test, suppression by rounds, and the leak search, against plain Python."""

import random

from pyspark.sql import functions as F

from maskwright.operators import agent, spatial, verify
from maskwright.session import ship
from maskwright.sources import html

PAGE = """<body><form aria-label=" Ship  to "><label for=a>Name</label><input id=a disabled value=v><p>call 12345 now<dialog open><button>ok</button><a href=x>go
 on</a></dialog></form><div role=navigation title=Bar><a>1</a><b>x</b><a>2</a></div><dialog><a>shut</a><a>too</a></dialog><table role=dialog><tr><td>a@b<td>two 2222</table></section>"""


def test_nested_sets_and_texts_of_a_page():
    rows = html.parse(PAGE)
    by = {r["node"]: r for r in rows}
    for r in rows:  # node and leave against the chain of parents
        inside = [o["node"] for o in rows if r["node"] in chain(by, o["node"])]
        assert inside == list(range(r["node"] + 1, r["leave"] + 1))
        assert r["end"] >= r["begin"]
    table = next(r for r in rows if r["tag"] == "table")
    assert table["full_text"] == "a@btwo 2222" and table["own_text"] == "" and table["modal"]
    assert next(r for r in rows if r["tag"] == "input")["label"] == "Name" and not next(r for r in rows if r["tag"] == "input")["enabled"]
    assert [r["tag"] for r in rows if r["modal"]] == ["dialog", "table"]


def chain(by, node):
    out = []
    while (node := by[node]["up"]) is not None:
        out.append(node)
    return out


def test_texts_stay_linear_in_deep_pages():
    import time

    began = time.process_time()
    rows = html.parse("<div>" * 3000 + "word " * 20_000 + "</p>" * 3000)
    assert len(rows) == 3000 and all(len(r["full_text"]) <= html.OWN_TEXT for r in rows) and rows[-1]["own_text"].startswith("word word")
    assert time.process_time() - began < 3
    assert html.parse(None) == html.parse("") == []


def test_groups_and_nearest_kept(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x")], "page_id long, html string")
    found = html.nodes(pages)
    kept = html.elements(found).persist()
    rows = {r["id"]: r for r in kept.filter("scope = 1").collect()}
    parsed = {r["node"]: r for r in html.parse(PAGE)}
    ids = {r["node"]: i for i, r in rows.items()}
    up = {i: next((ids[n] for n in chain(parsed, r["node"]) if n in ids), None) for i, r in rows.items()}
    assert {r["id"]: r["parent"] for r in html.nearest_kept(kept).filter("scope = 1").collect()} == {i: p for i, p in up.items() if p}
    boxes = kept.select("scope", "id", F.col("node").alias("x"), F.lit(5).alias("y"), F.lit(3).alias("w"), F.col("node").alias("h"))
    got = [(r["id"], r["kind"], r["name"], set(r["children"]), (r["x"], r["y"], r["w"], r["h"])) for r in html.groups(found, kept, boxes).orderBy("id").collect()]
    inside = lambda tag, **a: {i for i, r in rows.items() for c in parsed.values() if c["tag"] == tag and all(c[k] == v for k, v in a.items()) and c["node"] < r["node"] <= c["leave"]}
    want = [("form", "Ship to", inside("form")), ("nav", "Bar", inside("div")), ("modal", None, inside("dialog", modal=True)), ("modal", None, inside("table")), ("table", None, inside("table"))]
    assert [(g[1], g[3]) for g in got] == [(k, c) for k, _, c in want] and [g[0] for g in got] == [f"g_{i}" for i in range(1, 6)]
    assert got[0][2] == "Ship to" and got[1][2] == "Bar"
    for _, _, _, children, (x, y, w, h) in got:
        nodes = [rows[c]["node"] for c in children]
        assert (x, y, w, h) == (min(nodes), 5, max(nodes) + 3 - min(nodes), max(nodes))


def test_visibility_equals_a_plain_hit_test(spark):
    dice = random.Random(4)
    rows = []
    for scope in range(6):
        node = 0
        while node < 60:  # small trees side by side
            leave = min(59, node + dice.randint(0, 3))
            for k in range(node, leave + 1):
                rows.append((scope, f"el_{k}", k, leave if k == node else k, dice.randint(-80, 900), dice.randint(-80, 700), dice.randint(2, 400), dice.randint(2, 400), dice.randint(0, 2)))
            node = leave + 1
    got = {(r["scope"], r["id"]): (r["visible"], r["offscreen"], r["hit"]) for r in spatial.sighted(spark.createDataFrame(rows, "scope long, id string, node int, leave int, x int, y int, w int, h int, z int"), 800, 600).collect()}
    for s, i, node, leave, x, y, w, h, _ in rows:
        off = x + w < 0 or y + h < 0 or x > 800 or y > 600
        px, py = min(max(x + w / 2, 1), 799), min(max(y + h / 2, 1), 599)
        over = [(o[8], o[2], o[3], o[1]) for o in rows if o[0] == s and not (o[4] + o[6] < 0 or o[5] + o[7] < 0 or o[4] > 800 or o[5] > 600) and o[4] <= px < o[4] + o[6] and o[5] <= py < o[5] + o[7]]
        top = max(over) if over and not off else None
        kin = top is not None and (top[1] <= node <= top[2] or node <= top[1] <= leave)
        assert got[s, i] == (kin and not off, off, top[3] if top else None)


def test_router_passes_over_what_is_covered(spark):
    """Of two buttons with the quoted name the one under a dialog is no candidate."""
    rows = [(1, 0, "el_1", "button", "Save", 10, 10, 80, 20, 1, 1), (1, 1, "el_2", "button", "Save", 10, 200, 80, 20, 2, 2), (1, 2, "el_3", "text", "Sure?", 0, 150, 400, 150, 3, 3)]
    e = spark.createDataFrame(rows, "scope long, ord int, id string, role string, name string, x int, y int, w int, h int, node int, leave int").withColumn("enabled", F.lit(True))
    tasks = spark.createDataFrame([(1, 'click "Save"', 0)], "scope long, task string, step int")
    [open_] = agent.route(tasks, e.withColumns({"visible": F.lit(True), "offscreen": F.lit(False)})).collect()
    [seen] = agent.route(tasks, spatial.sighted(e, 1000, 800)).collect()
    assert open_["route"] == "server" and (seen["route"], seen["target"]) == ("local", "el_1")


def test_rounds_equal_the_fold(spark, monkeypatch):
    dice = random.Random(9)
    rows = [(s, k, dice.randint(0, 900), dice.randint(0, 700), dice.randint(5, 160), dice.randint(5, 160), round(dice.random(), 2), "face" if k % 2 else "card") for s in (1, 2) for k in range(300 if s == 1 else 20)]
    boxes = spark.createDataFrame(rows, "scope long, box_id int, x int, y int, w int, h int, score double, cls string")
    fixed = boxes.filter("box_id < 5")
    loose = boxes.withColumnRenamed("box_id", "ord").filter("ord >= 5")
    results = lambda: [sorted(map(tuple, df.collect())) for df in (spatial.nms(boxes), spatial.nms(boxes, cap=1000), spatial.dedupe_regions(boxes), spatial.add_unless_overlapping(fixed, loose))]
    folded = results()
    monkeypatch.setattr(spatial, "FOLD_MOST", 100)
    assert results() == folded and len(folded[1]) > 50


def test_leak_search_equals_plain_search(spark, monkeypatch):
    ship(spark)
    vault = [(1, f"PHONE_{k}", f"{9_000_000_000 + 7 * k}") for k in range(100_000)] + [(1, "ADDR_1", 'a "quoted" street'), (2, "SECRET_1", "abc"), (2, "NAME_1", "Anna"), (2, "NAME_2", "Anna"), (3, "X_1", "never")]
    payloads = [(1, f"call {9_000_000_000 + 7 * k} or {9_000_000_000 + 7 * k + 1}") for k in range(0, 3000, 50)] + [(1, '{"t":"a \\"quoted\\" street"}'), (2, "abc Annabel"), (2, None), (2, ""), (9, "Anna")]
    v, p = spark.createDataFrame(vault, "scope long, handle string, value string"), spark.createDataFrame(payloads, "scope long, payload string")
    want = {(1, f"PHONE_{k}") for k in range(0, 3000, 50)} | {(1, "ADDR_1"), (2, "NAME_1"), (2, "NAME_2")}
    for most in ((20_000, 200), (1_000_000, 1_000_000), (7_000, 5)):
        monkeypatch.setattr(verify, "VALUE_BLOCK", most[0])
        monkeypatch.setattr(verify, "PAYLOAD_BLOCK", most[1])
        rows = verify.vault_leaks(p, v).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
