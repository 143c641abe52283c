"""The training-data operators: brute force on small fixtures, round trips, and odd inputs."""

import bisect
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import binary, chunks, decontaminate, jaccard, media, packing, quality, queries, sharding, suffix, template
from maskwright.llm.graph import components
from maskwright.llm.queries import QUERIES

rng = np.random.default_rng(11)
WORDS = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(900)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


PASSAGE = prose(80, 999)
TEXTS = [
    prose(60, 1), prose(60, 1), prose(60, 1) + " tail", None, "", "", "one", prose(200, 2) + " " + PASSAGE + " " + prose(50, 3), prose(90, 4) + " " + PASSAGE + "\n" + prose(70, 5),
    "é" * 900, "ab" * 1500, prose(12000, 6), prose(300, 7), prose(300, 8), "x\0y " + prose(20, 9),
]


def docs(spark, texts=TEXTS):
    """Rows with a repeated one, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "d", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, rep long")


def plain(t):
    return (t or "").encode()


def test_rows_without_ids_are_spread(spark):
    """Rows that share a doc_id or have none go to several tasks, and each has a place of its own."""
    nameless = docs(spark, [prose(20, i) for i in range(60)] + ["same"] * 60).selectExpr("cast(null as long) as doc_id", "text").repartition(3)
    shards = sharding.shard(nameless).collect()
    assert len({(r["shard"], r["slot"]) for r in shards}) == len(shards) == 120
    packed = packing.pack_documents(nameless).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) == 120


def empty(spark):
    return docs(spark).limit(0)


def test_media_round_trip(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        raw = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        payload, length = media.from_png(media.to_png(raw))
        assert payload[:length] == raw and length == n and len(payload) == max(1, -(-n // 64)) * 64 and not any(payload[n:])
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"abc")[:-9] + b"x" * 9)


def test_media_query_on_every_column(spark, tmp_path):
    """All contract columns from plain Python; null and empty texts, repeated rows, ties, a very long text, clashing columns."""
    texts = [None, "", "a", "x" * 64, "é" * 40, "x" * 64, prose(40_000, 3)]
    frame = docs(spark, texts).withColumnRenamed("rep", "media")
    frame.unionByName(frame.limit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = media.op1_media_columns(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        raw = plain(texts[r["doc_id"]])
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        png = media.to_png(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(png), hashlib.sha256(png).hexdigest(), media.feature(payload))
        assert r["position"] == 1 and r["caption"] == f"Text of document {r['doc_id']}"
    frame.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert media.op1_media_columns(spark, f"{tmp_path}/e").count() == 0


def test_sequences_keep_order_and_captions(spark):
    page = '<p>a &amp; b<br>c</p><figure><img src="media:d1" alt="no"><figcaption>first</figcaption></figure><img src=d2 alt="second">tail<script>var x="<img src=q>"</script>'
    items = media.parse(page)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "a & b", None, None), (1, "text", "c", None, None), (2, "media", None, "d1", "first"), (3, "media", None, "d2", "second"), (4, "text", "tail", None, None)]
    pages = spark.createDataFrame([(1, page), (2, None), (1, page)], "page_id long, html string")
    known = spark.createDataFrame([("d2", 7)], "digest string, size int")
    rows = media.resolve(media.sequences(pages, "page_id"), "page_id", known).collect()
    assert len(rows) == 3
    got = {r["page_id"]: [(i["position"], i["digest"], i["size"]) for i in r["resolved"]] for r in rows}
    assert got[1] == [(0, None, None), (1, None, None), (2, "d1", None), (3, "d2", 7), (4, None, None)] and got[2] == []


def test_cut_points_follow_content():
    a = prose(400, 1).encode()
    cut = lambda raw: {raw[s:e] for s, e in zip(*(x.tolist() for x in chunks.chunk_spans([raw])[0]))}
    before, after = cut(a), cut(a[:700] + b"inserted bytes " + a[700:])
    assert len(before & after) >= len(before) - 6
    for raw in (b"", b"a", "é".encode() * 500, bytes(1000)):
        c = chunks.cut_points([raw])[0].tolist()
        assert c[0] == 0 and c[-1] == len(raw) and max(np.diff(c)) <= chunks.GREATEST + 3
        for s_, e in zip(*(x.tolist() for x in chunks.chunk_spans([raw])[0])):
            assert e - s_ >= chunks.SMALLEST and raw[s_:e].decode()


def test_chunk_dedup(spark):
    got = {r["doc_id"]: r for r in chunks.dedup(docs(spark)).collect()}
    assert len(got) == len(TEXTS)
    assert got[0]["n_removed"] == 0 and got[1]["text"] == "" and got[7]["n_removed"] == 0
    assert got[8]["n_removed"] > len(PASSAGE) * 0.6 and PASSAGE[100:-150] not in got[8]["text"] and PASSAGE in got[7]["text"]
    for i in (3, 4, 5, 6, 11, 12, 13, 14):
        assert got[i]["text"] == (TEXTS[i] or "") and got[i]["n_repeated"] == 0
    kept = chunks.cut(docs(spark))
    assert kept.columns == docs(spark).columns
    assert {r["doc_id"]: r["n_chars"] for r in kept.collect()}[8] == len(got[8]["text"])
    assert chunks.dedup(empty(spark)).count() == 0
    nameless = docs(spark, [PASSAGE, PASSAGE]).selectExpr("cast(null as long) as doc_id", "text")
    assert sorted(r["n_removed"] for r in chunks.dedup(nameless).collect()) == [0, len(PASSAGE)]
    assert jaccard.near_classes(nameless).count() == quality.score(nameless, quality.Machine()).count() == sharding.shard(nameless).count() == 2
    assert packing.pack_documents(nameless).count() == binary.token_ids(nameless).count() == 2


def test_chunk_dedup_finds_short_passages_whole(spark):
    """Passages of 51 words at random places of two documents go whole from the second one, and nothing else does."""
    dice, texts, passages = np.random.default_rng(51), [], []
    for k in range(200):
        passages.append(prose(51, 5000 + k))
        texts.append(" ".join([prose(int(dice.integers(1, 200)), 6000 + 2 * k), "a", passages[-1], "b", prose(int(dice.integers(1, 200)), 9000 + 2 * k)]))
    for k in range(200):
        texts.append(" ".join([prose(int(dice.integers(1, 200)), 6001 + 2 * k), "c", passages[k], "d", prose(int(dice.integers(1, 200)), 9001 + 2 * k)]))
    got = {r["doc_id"]: r for r in chunks.dedup(docs(spark, texts)).collect()}
    for k, p in enumerate(passages):
        assert got[k]["text"] == texts[k] and got[k]["n_repeated"] == len(p) + 2
        assert got[200 + k]["text"] == texts[200 + k].replace(f" {p} ", "") and got[200 + k]["n_spans"] == 1


def brute_repeats(texts):
    """Bytes of each text in stretches that occur elsewhere too, by every pair of places."""
    raws = [plain(t) for t in texts]
    at = {}
    for k, r in enumerate(raws):
        for p in range(len(r) - chunks.LEAST + 1):
            at.setdefault(r[p : p + chunks.LEAST], []).append((k, p))
    marks = [bytearray(len(r)) for r in raws]
    for w in at.values():
        for k, p in w if len(w) > 1 else ():
            marks[k][p : p + chunks.LEAST] = b"\1" * chunks.LEAST
    return [sum(m) for m in marks]


def test_chunk_dedup_equals_brute_force(spark):
    """Passages of 45 to 120 words in up to four documents each: as every stretch of LEAST bytes that occurs twice, and nothing else."""
    dice, texts = np.random.default_rng(52), []
    for k in range(60):
        passage = prose(int(dice.integers(45, 120)), 700 + k)
        for j in range(int(dice.integers(2, 5))):
            texts.append(" ".join([prose(int(dice.integers(1, 90)), 20_000 + 10 * k + j), f"x{j}y{k}", passage, f"q{k}z{j}", prose(int(dice.integers(1, 90)), 40_000 + 10 * k + j)]))
    want = brute_repeats(texts)
    got = {r["doc_id"]: r for r in chunks.dedup(docs(spark, texts)).collect()}
    assert sum(abs(got[k]["n_repeated"] - n) for k, n in enumerate(want)) <= 0.002 * sum(want)
    assert sum(got[k]["n_removed"] for k in got) < sum(want)


def test_chunk_dedup_tells_rows_of_one_id_apart(spark):
    a, b = prose(90, 1) + PASSAGE + prose(40, 2), prose(300, 3)
    frame = spark.createDataFrame([(1, PASSAGE), (2, a), (2, b), (None, PASSAGE), (2, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["text"]) for r in chunks.dedup(frame).collect())
    assert got == sorted([(0, len(PASSAGE), ""), (1, 0, PASSAGE), (2, 0, b), (2, len(PASSAGE), prose(90, 1) + prose(40, 2)), (2, len(a), "")])
    assert sorted(r["text"] for r in chunks.cut(frame).collect()) == sorted(x[2] for x in got)


def test_decontamination(spark):
    items = [prose(30, 50), prose(8, 51), "", None, prose(30, 50)]
    words = items[0].split()
    changed = " ".join("zz" if i in (3, 14, 22) else w for i, w in enumerate(words))
    texts = [prose(100, 60) + " " + items[0].upper() + "! " + prose(9, 61), changed, prose(50, 62) + " " + items[1], None, "", prose(500, 63), changed]
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(0, 0), (0, 4), (1, 0), (1, 4), (2, 1), (6, 0), (6, 4)}
    for bound in (decontaminate.SEED_BOUND, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(docs(spark, texts), tests, bound=bound).collect()}
        assert set(got) == want
        assert got[0, 0]["start"] == 100 and got[0, 0]["overlap"] == 1.0 and got[1, 0]["n_agreeing"] == 27
    assert decontaminate.overlaps(empty(spark), tests).count() == decontaminate.overlaps(docs(spark, texts), tests.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), tests).collect()} == {3, 4, 5}


def test_decontamination_of_parts(spark):
    """A quoted part, an insertion, a cut whose head and tail remain, and ids that are null, on both paths."""
    item = prose(56, 70).split()
    inserted = [*item[:27], "new", "words", *item[27:]]
    cut_ = [*item[:8], *prose(20, 71).split(), *item[-8:]]
    texts = [" ".join([prose(90, 72), *part, prose(40, 73)]) for part in (item[20:45], inserted, cut_, item[:5])]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, prose(60, 74))]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(None, " ".join(item)), (7, prose(40, 75))], "item_id long, text string")
    for bound in (decontaminate.SEED_BOUND, 0):
        got = {(r["doc_id"], r["item_id"]): r["n_agreeing"] for r in decontaminate.overlaps(few, tests, bound=bound).collect()}
        assert got == {(0, None): 25, (1, None): 56, (2, None): 16, (None, None): 25}
    assert sorted(r["text"] for r in decontaminate.clean(few, tests).collect()) == sorted([texts[3], prose(60, 74)])
    shared = spark.createDataFrame([(1, texts[0]), (1, prose(60, 74))], "doc_id long, text string")
    assert [r["text"] for r in decontaminate.clean(shared, tests).collect()] == [prose(60, 74)]


def test_decontamination_meets_every_quarter_of_substitutions(spark):
    dice, rows = np.random.default_rng(76), []
    items = {n: prose(n, 300 + n).split() for n in (8, 15, 17, 27, 38, 59)}
    for n, w in items.items():
        fourths = [set(range(p, n, 4)) for p in range(4)]
        some = [set(dice.choice(n, n // 4, replace=False).tolist()) for _ in range(60)]
        rows += [(n * 1000 + k, " ".join("zz%d" % i if i in gone else x for i, x in enumerate(w))) for k, gone in enumerate([*fourths, *some])]
    tests = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect()}
    assert got == {(i, i // 1000) for i, _ in rows}


def shingles(t):
    w = "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_equals_brute_force(spark, monkeypatch):
    base = prose(150, 70).split()
    near = []
    for k in range(40):  # a group of near copies, some links within and some not
        w = list(base)
        for j in range(k % 4):
            w[20 + 31 * j + k % 7] = f"edit{k}x{j}"
        near.append(" ".join(w))
    texts = [*TEXTS[:11], *near, near[3], "two words", "Two  words!"]
    sets = [shingles(t) for t in texts]
    n, links, up = len(texts), Counter(), list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both / max(1, len(sets[i] | sets[j])) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    for block in (2048, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = {r["doc_id"]: r for r in jaccard.near_classes(docs(spark, texts)).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in range(n)}
        assert {i: r["class_id"] for i, r in got.items()} == {i: top(i) for i in range(n)}
    assert jaccard.near_classes(empty(spark)).count() == 0


def test_bayes_bounds_rise_and_keep_true_pairs():
    least = jaccard.least_agreements(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * 96


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array(symbols):
    s = [*symbols, 0]
    order = suffix.suffix_array(s)
    assert order == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = suffix.common_prefixes(s, order)
    for r in range(1, len(s)):
        a, b = s[order[r - 1] :], s[order[r] :]
        assert lcp[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def exact(texts):
    raws = [plain(t) for t in texts]
    seen = Counter(r[p : p + 400] for r in raws for p in range(len(r) - 399))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - 399):
            if seen[r[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        out.append((len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def test_exact_substrings_equal_brute_force(spark):
    texts = [*TEXTS[:11], TEXTS[12], prose(30, 80) + " " + PASSAGE[:420], PASSAGE[15:460] + prose(200, 81), TEXTS[12], "a" * 401, "b" * 400, "c" * 399]
    want = exact(texts)
    for most in (suffix.MOST, 1):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(docs(spark, texts), most).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert suffix.dedup(empty(spark)).count() == 0
    nameless = docs(spark, [PASSAGE, PASSAGE]).drop("doc_id").selectExpr("cast(null as long) as doc_id", "text")
    assert {(r["doc_id"], r["n_removed"]) for r in suffix.dedup(nameless).collect()} == {(None, len(PASSAGE))}
    twice = docs(spark, [prose(100, 1)])
    assert {r["n_removed"] for r in suffix.dedup(twice.unionAll(twice)).collect()} == {len(prose(100, 1))}


def reference_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


ODD = [*TEXTS, "don't 'LL we've ΑΣ İx x²½ 12ab <|endoftext|>a<|startoftext|> \x1c q　t ﬁ ǅ ẞ a​b é\r\n\t!?"]


def test_packing(spark):
    ids = reference_ids(ODD, 1)
    rows = packing.pack_documents(docs(spark, ODD)).toPandas()
    assert rows.length.sum() == sum(map(len, ids))
    for r in rows.itertuples():
        assert r.start == 4096 * r.piece
        part = np.asarray(ids[r.doc_id], dtype="<u4")[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert packing.pack_documents(empty(spark)).count() == 0


def first_fit_decreasing(histogram, capacity):
    rooms = []
    for n in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(capacity - n)
        else:
            rooms[k] -= n
    return len(rooms)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=20))
@settings(max_examples=25, deadline=None)
def test_plan_places_every_piece(histogram):
    entries, n = packing.plan(histogram, 64)
    assert n <= packing.plan(histogram, 64, 0)[1]
    ends = {}
    for length, first, _, _, _ in sorted(entries):
        assert first == ends.get(length, 0) or first > ends.get(length, -1)
        ends[length] = first


def best_fit_decreasing(histogram, capacity):
    """Piece by piece."""
    rooms = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            k = bisect.bisect_left(rooms, n)
            room = rooms.pop(k) if k < len(rooms) else capacity
            bisect.insort(rooms, room - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_never_needs_more_than_best_fit(seed):
    """Random histograms of sixty lengths, half of them with many pieces over half a sequence."""
    dice = np.random.default_rng(seed)
    histogram = dict(zip(dice.choice(np.arange(40, 4097 if seed % 2 else 2500), 60, replace=False).tolist(), dice.integers(1, 60, 60).tolist()))
    entries, n = packing.plan(histogram, 4096)
    assert n <= best_fit_decreasing(histogram, 4096)
    # Every piece has one place, and no sequence holds more than it can.
    filled = Counter()
    rows = sorted(entries)
    for k, (length, first, copies, sequence, _) in enumerate(rows):
        until = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else histogram[length]
        for rank in range(first, until):
            filled[sequence + (rank - first) // copies] += length
    assert max(filled.values()) <= 4096 and len(filled) == n and sum(filled.values()) == sum(a * b for a, b in histogram.items())


def test_program_packs_a_real_histogram_as_well_as_best_fit():
    sizes = np.minimum(4096, np.random.default_rng(6).lognormal(6, 1.2, 6000).astype(int) + 1)
    histogram = dict(Counter(sizes.tolist()))
    entries, programs = packing.plan(histogram, 4096)
    assert programs <= packing.plan(histogram, 4096, 0)[1]
    assert programs <= first_fit_decreasing(histogram, 4096)


def test_long_texts_are_encoded_in_steps():
    texts = ["Ab, " * 200_000, "x" * 600_001 + " yy " + "é" * 300_000, "", " ", "abc'd don't \0 a\0b"]
    from maskwright.llm import tokens

    assert [f.tolist() for f in tokens.encode(packing.default_tokenizer(), texts, 1)] == reference_ids(texts, 1)


def test_knapsack_prices_exactly():
    values = np.r_[0.0, np.random.default_rng(1).random(12)]
    best = [0.0] * 13
    for room in range(1, 13):
        best[room] = max(values[s] + best[room - s] for s in range(1, room + 1))
    take = packing.price(values, 12)
    assert (np.arange(13) * take).sum() <= 12 and abs((values * take).sum() - best[12]) < 1e-9


def test_quality_learns_and_is_linear(spark):
    good, bad = [prose(60, i) for i in range(100, 220)], [" ".join(w + "###" for w in prose(40, i).split()) for i in range(220, 340)]
    frame = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, 1 if i < 120 else 0, 0) for i in range(240)] + [(5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    machine = quality.train(frame, labels)
    rows = {r["doc_id"]: r for r in quality.score(frame, machine).collect()}
    assert len(rows) == 242
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["held_out"] for i in held) and sum(r["held_out"] for r in rows.values()) >= len(held)
    assert np.mean([rows[i]["predicted"] == (i < 120) for i in held]) > 0.97
    assert {r["doc_id"] for r in quality.keep_good(frame, machine).collect()} == {i for i, r in rows.items() if r["predicted"]}
    index, value = quality.features(good[0], 10)
    x = machine.scaled(value)
    pairs = sum((machine.v[index[i]] @ machine.v[index[j]]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert abs(machine.logit(index, value) - (machine.w0 + machine.w[index] @ x + pairs)) < 1e-6
    assert quality.train(frame, labels.limit(0)).score(index, value) == 0.5
    assert quality.score(empty(spark), machine).count() == 0


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)

    def runs(c):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if runs(mid) <= shards else (mid + 1, high)
    return low


def test_sharding_is_minimax(spark):
    texts = [*TEXTS, *[prose(10 + i % 23, i) for i in range(300)], *["same"] * 40]
    groups = Counter()
    for t in texts:
        groups[hashlib.sha256(plain(t)).hexdigest()] += len(plain(t)) + 1
    for shards in (16, 3):
        rows = sharding.shard(docs(spark, texts), shards).toPandas()
        assert rows.groupby("shard")["size"].sum().max() == brute_capacity([groups[k] for k in sorted(groups)], shards)
        for _, g in rows.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        assert rows.assign(t=[hashlib.sha256(plain(texts[i])).hexdigest() for i in rows.doc_id]).groupby("t").shard.nunique().max() == 1
        assert all(zlib.crc32(plain(texts[r.doc_id])) == r.text_crc32 for r in rows.itertuples())
    assert sharding.shard(empty(spark)).count() == 0
    assert {r["slot"] for r in sharding.shard(docs(spark, [None, ""])).collect()} == {0, 1}


@given(st.lists(st.integers(0, 300), min_size=1, max_size=700))
@settings(max_examples=40, deadline=None)
def test_huffman_round_trip(ids):
    ids = np.asarray(ids)
    lengths = binary.code_lengths(np.bincount(ids))
    assert sum(2.0 ** -float(n) for n in lengths if n) <= 1 + 1e-12
    bits, marks = binary.write_bits(ids, binary.canonical(lengths), lengths)
    assert (binary.read_bits(bits, marks, len(ids), binary.decoding_table(lengths)) == ids).all()


def test_code_lengths_are_limited():
    assert binary.code_lengths(np.array([2**k for k in range(40)])).max() <= binary.LONGEST


def test_token_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK", 500)
    ids = reference_ids(ODD, 2)
    binary.write_documents(docs(spark, ODD), str(tmp_path / "f"))
    at = 0
    for r in sorted(binary.read_documents(spark, str(tmp_path / "f")).collect(), key=lambda r: r["doc_id"]):
        want = np.asarray(ids[r["doc_id"]], dtype="<u4")
        assert r["start"] == at and bytes(r["ids"]) == want.tobytes()
        at += len(want)
    binary.write_documents(empty(spark), str(tmp_path / "e"))
    assert binary.read_documents(spark, str(tmp_path / "e")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="top">Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy!</div>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p><b>Bold one<br><p>Second&nbsp;para
 spaced<ul><li>a<li>b</ul><form><input name=q>Search</form><p>%s</p></article><aside>Side</aside><section class="comments"><p>Nice post</p></section><footer>&copy; x</footer>"""


def test_template_extraction(spark):
    want = "Head & more\nBold one\nSecond para spaced\na\nb\n"
    rows = [(i, f"http://h{i % 2}.example.org/{i}", PAGE % f"own text {i}", "x") for i in range(9)] + [(20, None, None, "x"), (21, "http://h1.example.org/e", "", "x"), (22, "notaurl", "<p>alone</p>", "x"), (0, "http://h0.example.org/0", PAGE % "own text 0", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, slots string")
    for bound in (template.TOKEN_BOUND, 0):
        got = template.main_text(pages, bound).collect()
        assert len(got) == len(rows)
        by = {r["page_id"]: r for r in got}
        for i in range(9):
            assert by[i]["text"] == f"{want}own text {i}" and by[i]["n_chars"] == len(by[i]["text"])
        assert by[20]["text"] == by[21]["text"] == "" and by[22]["text"] == "alone"
    assert template.main_text(pages.limit(0)).count() == 0


def test_template_without_article_tags(spark):
    page = '<html><body><div class="nav"><a href=x>Home</a></div><div id="c"><p>{0} first paragraph of some length</p><p>second {0}</p></div><div class="sidebar">links</div></body></html>'
    pages = spark.createDataFrame([(i, "http://a.example.org", page.format(i)) for i in range(4)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in template.main_text(pages).collect()} == {i: f"{i} first paragraph of some length\nsecond {i}" for i in range(4)}


OPAQUE = '<html><body><div class="c1"><a href=/>Home</a> <a href=/n>News desk</a></div><div class="c2">{offer}</div><div class="k9"><h2>Story</h2><p>{a}</p><p>{b}</p></div><div class="c3">All rights reserved</div></body></html>'


def opaque(spark, n=30):
    rows = [(i, f"http://o.example.org/{i}", OPAQUE.format(offer="Buy two, pay one", a=prose(20, 900 + i), b=prose(9, 950 + i))) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_decides_where_names_say_nothing(spark):
    """Menu, offer line and footer of a host with opaque names go, by the template alone."""
    pages = opaque(spark)
    for r in template.main_text(pages).collect():
        i = r["page_id"]
        assert r["text"] == f"Story\n{prose(20, 900 + i)}\n{prose(9, 950 + i)}"
        assert template.extract(OPAQUE.format(offer="Buy two, pay one", a="x", b="y"), frozenset()) == "Home News desk\nBuy two, pay one\nStory\nx\ny\nAll rights reserved"
    boxed = "<article><p>Same in all</p><p>{}</p><div class=z1><p>Subscribe now</p></div></article>"
    inside = spark.createDataFrame([(i, "http://i.example.org", boxed.format(prose(9, i))) for i in range(5)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in template.main_text(inside).collect()} == {i: f"Same in all\n{prose(9, i)}" for i in range(5)}
    few = template.main_text(opaque(spark, 2)).collect()
    assert all(r["text"].startswith("Home News desk") for r in few)  # under LEAST_PAGES
    copies = spark.createDataFrame([(i, "http://c.example.org/", "<p>Menu</p><p>alike</p>") for i in range(5)], "page_id long, url string, html string")
    assert {r["text"] for r in template.main_text(copies).collect()} == {"Menu\nalike"}


def test_template_classes_equal_brute_force(spark):
    html = [OPAQUE.format(offer="Only sometimes" if i % 3 else "", a=prose(5, i), b="and again" if i % 2 else "x") + "<hr>" * (i % 2) for i in range(12)]
    pages = spark.createDataFrame([(i, "http://b.example.org", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    seen = [template.tokens(h) for h in html]
    vectors = {t: tuple(s.get(t, [0])[0] for s in seen) for t in set().union(*seen)}
    parent = {t: x[1] for s in seen for t, x in s.items()}
    even = {t for t, v in vectors.items() if sum(n > 0 for n in v) * 2 >= 12 and len({n for n in v if n}) == 1}
    # A class is even if all its tokens are, as they share a vector; a token is valid if those around it are.
    ok = lambda t: t in even and (t == 0 or ok(parent[t]))
    want = {}
    for t in filter(ok, vectors):
        want.setdefault(vectors[t], set()).add(t)
    got = {}
    for r in template.deduce(pages).collect():
        got.setdefault(r["class"], set()).add(r["token"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


PART_NAMES = "main-menu main-nav page-footer page-header content-sidebar article-share page-notice body-ad post-newsletter post-comments article-comments entry-comments".split()


@pytest.mark.parametrize("name", PART_NAMES)
def test_names_of_two_words(name):
    for page in ('<div><div class="{}"><p>junk text</p></div><article><p>The story goes on</p></article></div>', '<article><p>The story goes on and on, longer than what stands beside it here</p><div class="{}"><p>junk text</p></div></article>'):
        assert "junk" not in template.main_part(page.format(name), frozenset())


def test_page_in_one_form():
    page = '<html><body><form id="f"><div class="top"><p>Hello there</p></div><p>More text</p><select><option>x</select><button>Go</button></form></body></html>'
    assert template.main_part(page, frozenset()) == "Hello there\nMore text"


def test_main_slot_decides_over_names(spark):
    """A host whose template holds varied menus and adverts under names that tell nothing: only the main slot is read, also where it has a header of its own."""
    page = '<html><body><div class="q1"><ul><li>{m}</li></ul></div><div class="q2">{ad}</div><main class="q3"><h1>{h}</h1><div class="q4"><p>{a}</p><p>{b}</p></div></main><div class="q5">{f}</div></body></html>'
    parts = lambda i: {"m": prose(4, i), "ad": prose(6, 100 + i), "h": prose(3, 200 + i), "a": prose(60, 300 + i), "b": prose(40, 400 + i), "f": prose(5, 500 + i)}
    pages = spark.createDataFrame([(i, "http://s.example.org", page.format(**parts(i))) for i in range(12)] + [(20, "http://s.example.org", "<html><body><p>Another layout</p></body></html>")], "page_id long, url string, html string")
    for bound in (template.TOKEN_BOUND, 0):
        for r in template.main_text(pages, bound).collect():
            p = parts(r["page_id"])
            assert r["text"] == ("Another layout" if r["page_id"] == 20 else f"{p['h']}\n{p['a']}\n{p['b']}")


def test_odd_markup_takes_linear_time():
    import time

    for page in ("<!" * 500_000, "<p>x" + "<![CDATA[ " * 100_000, "<div>" * 8000 + "</section>" * 50_000, "<center>" * 8000, "<i>" * 8000 + "<div></b>" * 8000, "<article>" + "<i>x" * 20_000):
        began = time.process_time()
        template.main_part(page, frozenset())
        media.parse(page)
        assert time.process_time() - began < 4


def test_extraction_of_odd_pages():
    read = lambda h: template.main_part(h, frozenset())
    assert read('<div class="content has-sidebar"><p>Hello text</p></div>') == "Hello text"
    assert read('<div class="search-enabled"><article><p>Hello</p></article></div>') == "Hello"
    assert read('<article><div class="content with-sidebar"><p>Hello</p></div></article>') == "Hello"
    assert read("<main><h1>T</h1><article><p>long text here</p></article></main>") == "T\nlong text here"
    assert read('<div><h1>T</h1><p>long</p><ul><li>a<li>b</ul></div><div class="site-footer">foot</div>') == "T\nlong\na\nb"
    assert read('<article><p>Text</p><div class="comments"><p>' + "nice " * 5 + "</p></div></article>") == "Text"
    assert read('<div class="ad">' + "buy " * 50 + "</div><article><p>short</p></article>") == "short"
    assert read("<article>" + "<div>" * 100_000 + "deep") == "deep"
    assert read("<p>a</p>" + "<script>" * 50_000) == "a" and read("<!-- never closed <p>x</p>") == ""
    assert len(media.parse("<p>a</p>" + "<script>" * 50_000)) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert set(names) == set(ours.columns)
    assert sorted(map(tuple, ours.select(*names).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    frame = docs(spark, [*TEXTS, *[prose(80, i) for i in range(400, 420)]])
    kept = pipeline.one_of_near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    assert {0, 3, 6, 7} <= {r["doc_id"] for r in kept.collect()} and not {1, 5} & {r["doc_id"] for r in kept.collect()}
    assert pipeline.without_repeated_passages(spark, frame, "").count() == frame.count()
    assert len(pipeline.STAGES) == 5


def test_keep_first_keeps_one_row_of_each_class(spark):
    a, b = prose(40, 800), prose(40, 801)
    rows = [(3, a), (3, a), (5, a + " more"), (6, b), (6, b), (6, b), (9, prose(40, 802)), (None, a), (None, b)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, first_rows int")
    kept = jaccard.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(3, a), (6, b), (9, prose(40, 802))])
    assert sorted(r["doc_id"] for r in jaccard.keep_first(frame.filter("doc_id in (5, 9)")).collect()) == [5, 9]
    assert [(r["doc_id"], r["text"]) for r in jaccard.keep_first(spark.createDataFrame([(None, a), (None, a + " more"), (None, a)], "doc_id long, text string")).collect()] in ([(None, a)], [(None, a + " more")])
    assert jaccard.keep_first(empty(spark)).count() == 0


def test_jaccard_links_rows_whatever_their_ids(spark):
    """Two texts that share an id keep their own links, and so do rows without an id."""
    a, c = prose(60, 810), prose(60, 811)
    for rows in ([(1, a), (1, c), (2, a + " more"), (3, c + " more")], [(None, a), (None, c), (None, a + " more"), (None, c + " more")]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert [r["n_links"] for r in jaccard.near_classes(frame).collect()] == [1] * 4
    mixed = jaccard.near_classes(spark.createDataFrame([(None, a), (7, a + " more"), (9, c)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in mixed) == [(0, 7, 1), (7, 7, 1), (9, 9, 0)]


def test_pipeline_runs(spark, tmp_path):
    """All stages over a small corpus, each decision by hand; then over empty tables."""
    pipeline = pytest.importorskip("corpus_pipeline")
    good = [prose(90, 1200 + i) for i in range(60)]
    bad = [" ".join(w + "###" for w in prose(40, 1300 + i).split()) for i in range(60)]
    item = prose(30, 1400)
    near = " ".join([*good[0].split()[:-1], "changed"])
    leak = prose(40, 1401) + " " + item + " " + prose(40, 1402)
    share = [prose(60, 1403) + " " + PASSAGE + " " + prose(60, 1404), prose(60, 1405) + " " + PASSAGE + " " + prose(60, 1406)]
    texts = [*good, *bad, near, leak, *share, good[5], None]
    d = str(tmp_path)
    frame = docs(spark, texts)
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = pipeline.good_quality(spark, frame, d)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} >= {*range(60), 120, 121, 122, 123}
    assert not {r["doc_id"] for r in kept.collect()} & set(range(60, 120))
    clean = pipeline.without_benchmark(spark, frame, d)
    assert clean.columns == frame.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {121}
    rows = pipeline.run(spark, d).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids - {125} == {*range(60), 122, 123}  # 120 and 124 are copies, 121 leaks; the empty text may stay
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    whole = packing.pack_documents(frame.filter("doc_id = 123")).collect()[0]["length"]
    assert next(r["length"] for r in rows if r["doc_id"] == 123) < whole - 80  # the passage was cut
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{d}/none/{name}.parquet")
    assert pipeline.run(spark, f"{d}/none").count() == 0
