"""Vector codes, toxicity and importance resampling: brute force on small fixtures, planted texts, odd inputs."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import codes, resample, toxicity

_dice = np.random.default_rng(11)
WORDS = ["".join(_dice.choice(list("abcdefghijklmnop"), 6)) for _ in range(900)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


# --- vector codes


def brute_codes(rows, rounds=2, entries=64):
    """(vec_id, code, error) of whole rows by plain loops, every part against every entry."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // 16
    part = lambda v, p: v[p * width : (p + 1) * width]
    firsts = []
    for i, _, v in sorted(kept, key=lambda r: (r[0], r[2])):
        if i not in [f[0] for f in firsts]:
            firsts.append((i, v))
    books = [[part(v, p) for _, v in firsts[:entries]] for p in range(16)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e])), e))
    for _ in range(rounds):
        for p in range(16):
            members = {}
            for _, _, v in kept:
                members.setdefault(near(part(v, p), books[p]), []).append(part(v, p))
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = {}
    for i, label, v in kept:
        at = [near(part(v, p), books[p]) for p in range(16)]
        far = sum(sum((a - b) ** 2 for a, b in zip(part(v, p), books[p][e])) for p, e in enumerate(at))
        out.setdefault(i, []).append(("".join(f"{e:02x}" for e in at), far, label))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def vectors(spark, rows):
    """Columns with the operator's own names besides."""
    return spark.createDataFrame([(i, v, label, "x", 1, "c") for i, label, v in rows], "vec_id long, embedding array<float>, label int, cells string, part int, code string")


def test_vector_codes_equal_brute_force(spark):
    dice = np.random.default_rng(3)
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), [float(np.float32(x)) for x in dice.normal(0, 0.2, 32)]) for i in range(150)]
    rows += [(500, 1, None), (501, 1, [0.1] * 31 + [None]), (502, 1, [0.1] * 31 + [float("nan")]), (503, 1, [float("inf")] * 32), (504, 2, [0.5] * 16), (505, 2, [])]
    rows += [rows[3], (7, 1, rows[9][2])]  # a repeated row, and an id that two vectors have
    want, sha = brute_codes([r for r in rows if r[2] is None or len(r[2]) == 32])
    got = codes.compress(vectors(spark, rows)).collect()
    assert len(got) == 152 and {r["codebooks_sha256"] for r in got} == {sha}
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((i, c, e) for i, many in want.items() for c, e, _ in many)
    sums = {}
    for many in want.values():
        for _, e, label in many:
            sums[label] = sums.get(label, 0) + e
    assert all(r["label_error"] == sums[None if r["label"] is None else int(r["label"])] for r in got)


def test_vector_codes_of_odd_tables(spark):
    assert codes.compress(vectors(spark, [(1, 1, [0.1] * 16)]).limit(0)).count() == 0
    assert codes.compress(vectors(spark, [(1, 1, None)])).count() == 0
    [one] = codes.compress(vectors(spark, [(None, None, [0.3] * 16)])).collect()
    assert one["code"] == "00" * 16 and one["error"] == one["label_error"] == 0
    ties = codes.compress(vectors(spark, [(i, 1, [float(i % 2)] * 16) for i in range(10)])).collect()
    assert {r["code"] for r in ties} == {"00" * 16, "01" * 16} and {r["error"] for r in ties} == {0}
    huge = codes.compress(vectors(spark, [(1, 1, [3e38] * 16), (2, 1, [-3e38] * 16)])).collect()
    assert all(r["error"] == 0 for r in huge)
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, []), entries=300)


def test_only_changed_parts_are_sent(spark):
    """A round's contributions are those of parts whose assignment changed, and add up to none where nothing did."""
    cells = [[i, i] * 16 for i in range(4)]
    state = lambda old, new: spark.createDataFrame([(i, "a", c, old and bytearray([old[i]] * 16), bytearray([new[i]] * 16)) for i, c in enumerate(cells)], codes.STATE)
    first = codes.contributions(state(None, [0, 0, 1, 1]), 2, 2).collect()
    assert sorted((r["part"], r["entry"], r["n"], tuple(r["sums"])) for r in first)[:2] == [(0, 0, 2, (1, 1)), (0, 1, 2, (5, 5))] and len(first) == 32
    assert codes.contributions(state([0, 0, 1, 1], [0, 0, 1, 1]), 2, 2).count() == 0
    moved = codes.contributions(state([0, 0, 1, 1], [0, 1, 1, 1]), 2, 2).collect()
    assert sorted((r["part"], r["entry"], r["n"], tuple(r["sums"])) for r in moved)[:2] == [(0, 0, -1, (-1, -1)), (0, 1, 1, (1, 1))]


# --- importance resampling

_RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = _RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def brute_resample(docs, target, percent=5):
    found = [brute_features(t) for _, t in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for some, _ in found:
        for b in some:
            s[b] += 1
    for text in target:
        for b in brute_features(text)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000.0) / ((s[b] + 1) * (sum(t) + 10_000.0)))) for b in range(10_000)]
    out = []
    for (i, _), (some, n) in zip(docs, found):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in some)
        out.append([i, len(some), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def pairs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, rank string, weight int, bucket int")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("aZ é9.\0_", max_size=200)), max_size=8))
def test_features_equal_brute_force(texts):
    at, bucket, words = resample.features(pa.array(texts, pa.string()))
    want = sorted((k, b) for k, t in enumerate(texts) for b in brute_features(t)[0])
    assert sorted(zip(at.tolist(), bucket.tolist())) == want and words.tolist() == [brute_features(t)[1] for t in texts]


def test_resampling_equals_brute_force(spark):
    target = [prose(40, 900), prose(30, 901), None, ""]
    rows = [(i, prose(10 + i % 60, i) + (" " + prose(40, 900) if i % 9 == 0 else "")) for i in range(230)]
    rows += [(300, None), (301, ""), (302, "x" * 90_000), (303, "ab " * 40_000), (304, "É " * 30), (305, prose(3000, 5))]
    rows += [rows[0], rows[0], (None, rows[9][1]), (None, rows[18][1]), (-5, rows[18][1])]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for percent in (5, 60, 100):
        got = resample.resample(pairs(spark, rows).repartition(5), bench, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute_resample(rows, target, percent), key=repr)
    assert resample.resample(pairs(spark, rows).limit(0), bench).count() == 0
    short = resample.resample(pairs(spark, [(1, "a b"), (2, None)]), bench.limit(0)).collect()
    assert len(short) == 2 and {r["rank"] for r in short} == {None}


@settings(max_examples=5, deadline=None)
@given(data=st.data())
def test_kth_key_is_exact(spark, data):
    values = data.draw(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-3, 3)), min_size=1, max_size=40))
    values += values[:5]
    k = data.draw(st.integers(1, len(values)))
    assert tuple(resample.kth(spark.createDataFrame(values, "a long, b long"), ["a", "b"], k)) == sorted(values)[k - 1]


# --- toxicity


def test_folding_makes_one_writing():
    plain_ = toxicity.fold("You idiot loser")
    for other in ("you 1d10t l0ser", "YOU ІDІОТ LОЅЕR", "ｙｏｕ ｉｄｉｏｔ 𝐥𝐨𝐬𝐞𝐫", "you​ id­iot, lo$er!!", "you IDIOT*** loser$$$"):
        assert toxicity.fold(other) == plain_, other
    assert toxicity.fold(None or "") == "  " and toxicity.fold("réeux") != toxicity.fold("reeux") and toxicity.fold("réeux") == toxicity.fold("réeux")


def test_matches_take_the_longest_entry_of_a_word_and_spare_exceptions():
    lexicon = toxicity.Lexicon({" scum ": 5.0, " lo": 1.0, " loweix": 3.0}, [" pond scum "])
    assert [(e, w) for _, e, w in lexicon.matches(" scum loweixen lot pond scum scum ")] == [(" scum ", 5.0), (" loweix", 3.0), (" lo", 1.0), (" scum ", 5.0)]
    assert toxicity.Lexicon({}).matches(" a ") == []
    import pickle

    assert pickle.loads(pickle.dumps(lexicon)).matches(" scum ") == lexicon.matches(" scum ")


def labelled(n=420):
    """Every sixth text has some of the insults, one in six of the others one of them in a harmless phrase; a third of the toxic ones are disguised."""
    docs, labels = [], []
    for i in range(n):
        words = prose(60 + i % 90, 7000 + i).split()
        toxic = i % 6 == 0
        if toxic:
            for k in range(3):
                insult = ("zorgon", "vexling", "snarpfish")[(i // 6 + k) % 3]
                words.insert((7 * k + i) % len(words), insult.replace("o", "0").replace("e", "3").replace("i", "1") if i % 18 == 0 else insult)
        elif i % 6 == 1:
            words.insert(i % len(words), "zorgon valley")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_planted_texts(spark):
    docs, labels = labelled()
    known = spark.createDataFrame([(i, t, 1, "x") for i, t in labels] + [(9999, None, 1, "x")], "doc_id long, toxic int, quality int, entry string")
    rows = docs + [(1000, None), (1001, ""), (1002, prose(20_000, 1)), (1003, prose(20_000, 1) + " zorgon"), (None, "you zorgon vexling snarpfish"), (1004, "zorgon valley"), docs[0]]
    model = toxicity.train(pairs(spark, rows), known)
    assert {e.strip() for e in model.lexicon.entries} <= {toxicity.fold(w).strip()[:k] for w in ("zorgon", "vexling", "snarpfish") for k in range(3, 10)} and len(model.lexicon.entries) == 3
    assert any("zorgon vaiiey" in p for p in model.lexicon.exceptions)
    got = {}
    for r in toxicity.score(pairs(spark, rows), model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    truth = dict(labels)
    assert all(got[i][0]["predicted"] == t for i, t in truth.items())
    assert {i for i in truth if got[i][0]["held_out"]} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert got[None][0]["predicted"] == 1 and not got[None][0]["held_out"] and got[1004][0]["predicted"] == 0
    assert got[1000][0]["score"] == got[1001][0]["score"] < 0.5 and got[1002][0]["score"] < 0.5 and got[1003][0]["score"] < got[None][0]["score"]
    assert len(got[0]) == 2 and got[0][0]["score"] == got[0][1]["score"]
    assert toxicity.score(pairs(spark, rows).limit(0), model).count() == 0


def test_toxicity_without_labels_of_both_classes(spark):
    docs = pairs(spark, [(1, "a b c"), (2, None)])
    none = toxicity.train(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    ones = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, ones).collect())


def test_exceptions_that_the_caller_gives(spark):
    docs, labels = labelled()
    model = toxicity.train(pairs(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"), exceptions=["Vexling Street"])
    assert model.judge("at vexling street, zorgon valley")[1] == [] and model.judge("vexling")[1]
