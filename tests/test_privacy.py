"""Goldens and properties of detection, fusion, redaction, verification, routing and streaming."""

import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import agent, fusion, labels, lookup, patterns, redact, spatial, verify
from maskwright.schema import ELEMENTS
from maskwright.sources import profile
from maskwright.streaming import guards


def test_scan_goldens():
    spans = lambda s: [(h[0], h[1], h[2]) for h in patterns.scan(s)]
    assert spans("pay a.b@okaxis.com now") == [("email", 4, 18)]
    assert spans("number 4111111111111111 now") == [("card", 7, 24)]
    assert spans("4111 1111 1111 1111") == [("card", 0, 19)]
    assert spans("24be64439e3e49cf46b2d7c90f3602a3d0b907ff") == []
    assert [h[0] for h in patterns.scan("+1 (743) 555-3824")] == ["otp"]
    assert patterns.scan("") == patterns.scan(None) == []


@given(st.integers(0, 15), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_changing_a_digit_breaks_luhn(place, step):
    d = list("4111111111111111")
    d[place] = str((int(d[place]) + step) % 10)
    assert not patterns._py_luhn("".join(d))


@given(st.integers(0, 11), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_changing_a_digit_breaks_verhoeff(place, step):
    d = list("223456789018")
    assert patterns._py_verhoeff("".join(d))
    d[place] = str((int(d[place]) + step) % 10)
    assert not patterns._py_verhoeff("".join(d))


def test_native_hits_equal_joint_scan(spark):
    texts = ["mail é.a@b.org and c@d.net.", "x", "4111 1111 1111 1111 or 4111111111111112", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for rule in ("email", "card"):
        ours = {(r["k"], r["start"], r["hit"]) for r in patterns.rule_hits(df, patterns.BY_NAME[rule], "k").collect()}
        theirs = {(k, h[1], h[3]) for k, t in enumerate(texts) for h in patterns.scan(t) if h[0] == rule}
        assert ours == theirs


def elements(spark, rows):
    base = dict.fromkeys((c.split()[0] for c in ELEMENTS.split(", ")))
    defaults = {"scope": 1, "role": "textbox", "tag": "input", "name": "", "x": 0, "y": 0, "w": 260, "h": 32, "visible": True, "offscreen": False, "enabled": True}
    return spark.createDataFrame([tuple((base | defaults | {"ord": i, "id": f"el_{i}"} | r).values()) for i, r in enumerate(rows)], ELEMENTS)


FIXTURE = [
    {"name": "Full name", "autocomplete": "name", "value": "Asha Rao"},
    {"name": "Email address", "type": "email", "value": "asha@example.com"},
    {"name": "Mobile number", "type": "tel", "value": "9876543210"},
    {"name": "Password", "role": "password", "type": "password", "value": "hunter22"},
    {"name": "Verification code", "autocomplete": "one-time-code", "value": "482913"},
    {"name": "Aadhaar number", "value": "223456789018"},
    {"name": "Card number", "autocomplete": "cc-number", "value": "4111111111111111"},
    {"name": "Payment", "role": "text", "tag": "p", "text": "Pay to asha@okaxis before Friday."},
    {"name": "Contact", "role": "text", "tag": "p", "text": "mail asha@example.com or call 9876543211"},
    {"name": "Checksum", "role": "text", "tag": "p", "text": "id 223456789019 and 4111 1111 1111 1112"},
    {"name": "Order number", "role": "text", "tag": "p", "text": "Order number: 9876500001"},
    {"name": "Years of experience", "role": "select", "tag": "select", "value": "2-4"},
    {"name": "Notice period", "value": None},
]


def pipeline(spark):
    e = elements(spark, FIXTURE)
    dom = labels.detect(e).select("scope", "id", "field", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "cls", "p", "source")
    found = fusion.fuse(e, dom.unionByName(patterns.detect(e, ["scope", "id"]).select(*dom.columns)))
    return e, found, *redact.redact(e, found, profile.profile(spark, {"fullName": "Asha Rao"}))


def test_fixture_end_to_end(spark):
    _, found, safe, vault = pipeline(spark)
    flagged = {r["id"] for r in found.select("id").distinct().collect()}
    assert flagged == {f"el_{i}" for i in range(9)}
    rows = {r["ord"]: r for r in safe.collect()}
    assert rows[0]["holds"] == "PERSON_1" and rows[1]["holds"] == "EMAIL_1" and rows[6]["holds"] == "CARD_1"
    assert rows[3]["sensitive"] and rows[3]["holds"] is None and rows[4]["sensitive"]
    assert rows[7]["text"] == "Pay to UPI_1 before Friday."
    assert rows[8]["text"] == "mail EMAIL_1 or call PHONE_2"
    assert rows[11]["holds"] == "2-4" and rows[12]["empty"]
    assert vault.filter("cls in ('password', 'otp', 'apikey')").count() == 0


@given(st.data())
@settings(max_examples=300, deadline=None)
def test_what_a_rule_matches_is_a_candidate(data):
    rule, pattern = data.draw(st.sampled_from(patterns._COMPILED))
    text = data.draw(st.from_regex(pattern, fullmatch=True))
    assert re.search(patterns.CANDIDATE, text), rule.name


def test_values_without_neighbouring_digits_are_found(spark):
    values = ["HDFC0CADARS", "eyJabcdefghijk.abcdefghijklm.abcdefg"]
    df = spark.createDataFrame([(f"s{k}", v) for k, v in enumerate(values)], "scope string, payload string")
    scanned = df.select("payload", patterns.scan_patterns(F.col("payload")).alias("h")).collect()
    assert [[h["text"] for h in r["h"]] for r in scanned] == [[v] for v in values]
    rows = df.selectExpr("scope", "'e' as id", "payload as value", "cast(null as string) as text")
    assert {(r["scope"], r["cls"]) for r in patterns.detect(rows, ["scope", "id"]).collect()} == {("s0", "ifsc"), ("s1", "apikey")}


def test_verifier_passes_and_refuses(spark):
    _, _, safe, vault = pipeline(spark)
    assert verify.escalate(safe, vault).first()["passed"]
    leak = safe.withColumn("holds", F.when(F.col("ord") == 1, "asha@example.com").otherwise(F.col("holds")))
    hardened = verify.escalate(leak, vault).first()
    assert hardened["passed"] and hardened["retries"] == 1
    stuck = safe.withColumn("text", F.when(F.col("ord") == 9, "asha@example.com").otherwise(F.col("text")))
    refused = verify.escalate(stuck, vault).first()
    assert not refused["passed"] and refused["payload"] is None


def test_same_value_same_handle(spark):
    rows = spark.createDataFrame([(1, "email", "a@b.c", 3), (1, "email", "x@y.z", 1), (1, "email", "a@b.c", 5), (2, "email", "a@b.c", 1)], "scope long, cls string, value string, place int")
    got = {(r["scope"], r["value"]): r["handle"] for r in redact.mint(rows).collect()}
    assert got == {(1, "a@b.c"): "EMAIL_2", (1, "x@y.z"): "EMAIL_1", (2, "a@b.c"): "EMAIL_1"}


def test_coverage_and_components(spark):
    cells = spark.createDataFrame([(1, x, y) for x in range(6, 12) for y in range(5, 9)] + [(1, 0, 0)], "scope long, cx long, cy long")
    assert [tuple(r) for r in spatial.connected_regions(cells).collect()] == [(1, 192, 160, 192, 128, 24)]


def test_nms_is_idempotent(spark):
    rows = [(1, i, 10 * i, 5, 40, 40, 0.7 + i / 100) for i in range(12)]
    df = spark.createDataFrame(rows, "scope long, box_id int, x int, y int, w int, h int, score double")
    once = spatial.nms(df)
    assert sorted(map(tuple, spatial.nms(once).collect())) == sorted(map(tuple, once.collect()))


ROUTES = [('Click "Save draft"', "local", "click"), ("save draft", "local", "click"), ("Submit application", "local", "click"), ("scroll down", "local", "scroll"), ("clear all the input elements from the form", "local", "clear"), ("sign in", "local", "click"), ("click download", "server", None), ("hidden action", "server", None), ("Fill this application from my profile", "server", None), ("What sensitive data is on this page?", "server", None)]


def test_router_cases(spark):
    names = [("Save draft", False, True), ("Submit application", False, True), ("Hidden action", False, False), ("Sign in", True, False), ("Sign in with SSO", True, False), ("Download", True, False), ("Download", True, False)]
    controls = spark.createDataFrame([(s, i, f"el_{i}", "button", n, True, v, o) for s in range(len(ROUTES)) for i, (n, v, o) in enumerate(names)], "scope long, ord int, id string, role string, name string, enabled boolean, visible boolean, offscreen boolean")
    tasks = spark.createDataFrame([(s, t, 0) for s, (t, _, _) in enumerate(ROUTES)], "scope long, task string, step int")
    got = {r["scope"]: (r["route"], r["kind"]) for r in agent.route(tasks, controls).collect()}
    assert [got[s] for s in range(len(ROUTES))] == [(r, k) for _, r, k in ROUTES]


def test_scalars(spark):
    row = spark.range(1).select(T.fnv1a(F.lit("abc")).alias("f"), T.is_handle(F.lit(" EMAIL_1 ")).alias("h"), T.passphrase_strength(F.lit("abc")).alias("p"), T.entropy(F.lit("")).alias("e")).first()
    assert (row["f"], row["h"], row["p"], row["e"]) == ("1a47e90b", True, 0, 0.0)


def test_wrong_key_reads_as_null(spark, tmp_path):
    key = profile.derive_key("correct horse", b"0123456789abcdef")
    profile.write(profile.profile(spark, {"email": "a@b.c"}), str(tmp_path / "p"), key)
    assert {r["value"] for r in profile.read(spark, str(tmp_path / "p"), key).collect()} == {"a@b.c", ""}
    assert {r["value"] for r in profile.read(spark, str(tmp_path / "p"), bytes(32)).collect()} == {None}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(r, s, "t", "same" if s % 4 else f"f{s}", "ask_user" if s % 3 == 0 else "click", f"el_{s % 2}", "ok" if s % 2 else "failed") for r in (1, 2) for s in range(12)]
    schema = "run long, step long, task string, fp string, kind string, target string, result string"
    table = spark.createDataFrame(rows, schema)
    for part in range(3):
        table.filter(f"step div 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = guards.guarded(stream).writeStream.format("memory").queryName("guards").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    order = lambda df: df.toPandas().sort_values(["run", "step"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(spark.table("guards")), order(guards.guarded(table)), check_dtype=False)


def test_nothing_imports_the_llm_subpackage():
    from pathlib import Path

    import maskwright

    top = Path(maskwright.__file__).parent
    for f in top.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b.*import|import.*\bllm\b", f.read_text()), f


def test_realigned_to_the_nearest_occurrence(spark):
    rows = [("aXaaaX", "aa", 0, 2), ("aaaa", "aa", 2, 2), (r"x \E y \E", r"\E", 9, 7), ("abc", "z", 1, 1), ("abc", "", 2, 2), ("", "a", 3, 3)]
    df = spark.createDataFrame(rows, "raw string, wanted string, start int, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", lookup.realigned(F.col("raw"), F.col("wanted"), F.col("start"))).collect())


def test_mask_keeps_repeated_pixels(spark):
    pixels = spark.createDataFrame([(1, 5, 5, 9), (1, 5, 5, 9), (1, 90, 90, 9), (2, 5, 5, 9)], "scope long, x int, y int, luma int")
    boxes = spark.createDataFrame([(1, 5, 5, 2, 2), (1, 4, 4, 9, 9)], "scope long, x int, y int, w int, h int")
    assert sorted(tuple(r) for r in spatial.mask(pixels, boxes).collect()) == [(1, 5, 5, 0), (1, 5, 5, 0), (1, 90, 90, 9), (2, 5, 5, 9)]


def test_secrets_behind_an_id_prefix_are_found(spark):
    """V4 skips element ids and the schema tag as they are, not what merely begins like them."""
    from maskwright.operators import verify

    secret = "9fKq2LmZ7xTbW4cR8vYp3hJd"
    payloads = spark.createDataFrame([(1, f'{{"a":"el_{secret}"}}'), (2, f'{{"a":"sanitized/{secret}"}}'), (3, '{"schema":"sanitized/1","id":"el_12345678901234567890","g":"g_1"}'), (4, None)], "scope long, payload string")
    assert {(r["scope"], r["token"]) for r in verify.secret_like(payloads).collect()} == {(1, f"el_{secret}"), (2, f"sanitized/{secret}")}
