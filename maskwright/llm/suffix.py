"""Exact substring deduplication with suffix arrays built by linear grouping.

A byte is removed if a WINDOW-byte string that also starts anywhere else covers it. Every window picks the least
hashed SEED-byte string in it (the leftmost of equals): equal windows pick equal seeds at equal places,
so windows meet by seed. The stretch of windows that picked one seed is a context. Contexts that occur
twice are repeated as a whole, whatever their number: they are only counted. Where different contexts share a
seed, one of each is fetched, and a suffix array tells which of their windows are equal: contexts are cut into phrases
at content-defined places, the suffixes of the phrase string are grouped by Lyndon prefix in descending order with
previous-smaller pointers and emitted in order, and two windows are equal if their phrases share a
suffix-array interval that deep and their ends, before the first and behind the last phrase, agree. A seed with more than
`most` different contexts is spread over tasks by hashes of its single windows instead, with the same result.

Defined results: null and empty texts, and those shorter than a window, lose nothing; repeated rows are documents of their
own, so a row as long as a window that occurs twice is removed as a whole; a null doc_id is an id like any other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunks import gear
from .shingles import _powers, mix

WINDOW, SEED = 400, 32
#: One position in 2 ** PHRASE ends a phrase; it is decided by the TAIL bytes before it.
PHRASE, TAIL = 5, 16
#: Bytes of contexts that one suffix array covers (a single seed's contexts stay together); most contexts of a seed in it.
ARRAY_BYTES, MOST = 500_000, 3_000
#: Windows that are looked at together.
SLICE = 1 << 17
_RANDOM = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffixes in order. The last symbol must be the only least one.

    First suffixes are grouped by first symbol. Groups are taken in descending order: each member's pointer goes to
    the nearest suffix before it in a lower group, and the suffixes so pointed at move behind the rest of their
    group, those pointed at more often further. Then every group's suffixes share their Lyndon prefix, and going over
    the array from its least suffix on, each suffix found puts its left neighbour, and what that points to, into place."""
    n = len(symbols)
    at = np.argsort(symbols, kind="stable").tolist()
    place, group, end = [0] * n, [0] * n + [-1], [0] * (n + 1)
    start = 0
    for p, i in enumerate(at):
        if symbols[i] != symbols[at[start]]:
            end[start], start = p, p
        place[i], group[i] = p, start
    end[start] = n
    pointer = [-1] * n
    high = n
    while high:
        low = group[at[high - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(at[low:high]):
            j = i - 1
            while group[j] >= low:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        often: dict[int, list[int]] = {}
        for j, k in pointed.items():
            often.setdefault(k, []).append(j)
        for k in sorted(often, reverse=True):
            parts: dict[int, list[int]] = {}
            for j in often[k]:
                parts.setdefault(group[j], []).append(j)
            for g, some in parts.items():
                p = end[g]
                if p - g == len(some):
                    continue
                for j in some:
                    p -= 1
                    other = at[p]
                    at[p], at[place[j]] = j, other
                    place[other], place[j] = place[j], p
                end[p], end[g] = end[g], p
                for j in some:
                    group[j] = p
        high = low
    out, done = [-1] * n, [False] * n
    free = list(range(n))
    out[0] = n - 1
    done[n - 1] = True
    for r in range(n):
        i = out[r] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = True
            i = pointer[i]
    return out


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """For each place of the suffix array: symbols shared with the suffix before it."""
    rank = [0] * len(order)
    for r, i in enumerate(order):
        rank[i] = r
    out, n = [0] * len(order), 0
    for i, r in enumerate(rank):
        if r:
            j = order[r - 1]
            while symbols[i + n] == symbols[j + n]:
                n += 1
            out[r] = n
            n -= n > 0
        else:
            n = 0
    return out


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for hashes of any stretch, and the powers that shift them."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=sums[1:])
    return sums, down


def repeated_windows(contexts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each context (different ones), which of its windows occur twice or more; counts: how often each context occurs."""
    size = np.array([len(c) for c in contexts])
    first = np.cumsum(np.r_[0, size[:-1]])
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    windows = size - WINDOW + 1
    before = np.cumsum(windows) - windows
    ends = np.flatnonzero((gear(data) >> np.uint16(16 - PHRASE)) == 0) + 1
    home = np.searchsorted(first, ends - 1, side="right") - 1
    inside = ends - first[home] >= TAIL
    ends, home = ends[inside], home[inside]
    # The phrase string: a separator of its own for each context, then its phrases; `suffix` is where an end's phrase begins in it.
    phrases: dict[bytes, int] = {}
    symbols, suffix, raw = [], np.zeros(len(ends), dtype=np.int64), data.tobytes()
    base, last = len(contexts) + 1, -1
    places, owners = ends.tolist(), home.tolist()
    for k, (e, c) in enumerate(zip(places, owners)):
        if c != last:
            symbols.append(c + 1)
            last = c
        suffix[k] = len(symbols)
        if k + 1 < len(places) and owners[k + 1] == c:
            symbols.append(base + phrases.setdefault(raw[e : places[k + 1]], len(phrases)))
    symbols += [len(contexts) + base + len(phrases), 0]
    order = suffix_array(symbols)
    shared, rank = np.asarray(common_prefixes(symbols, order)), np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    sums, down = _sums(data)
    keys, times = np.empty(int(windows.sum()), dtype=np.uint64), np.asarray(counts)
    ids: dict[int, np.ndarray] = {}
    for at in range(0, len(keys), SLICE):
        place = np.arange(at, min(at + SLICE, len(keys)))
        own = np.searchsorted(before, place, side="right") - 1
        start = place - before[own] + first[own]
        lo = np.searchsorted(ends, start + TAIL)
        hi = np.searchsorted(ends, start + WINDOW, side="right") - 1
        cut = hi >= lo
        left = np.where(cut, ends[np.minimum(lo, max(0, len(ends) - 1))] if len(ends) else 0, start + WINDOW)
        right = np.where(cut, ends[np.maximum(hi, 0)] if len(ends) else 0, start + WINDOW)
        depth = np.where(cut, hi - lo, 0)
        interval = np.zeros(len(start), dtype=np.int64)
        for d in np.unique(depth).tolist():
            if d:
                if d not in ids:
                    ids[d] = np.cumsum(shared < d, dtype=np.int32)
                some = np.flatnonzero(depth == d)
                interval[some] = ids[d][rank[suffix[lo[some]]]]
        key = mix((sums[left] - sums[start]) * down[start])
        key = mix(key + (sums[start + WINDOW] - sums[right]) * down[right])
        for part in (left - start, start + WINDOW - right, depth, interval):
            key = mix(key * np.uint64(31) + part.astype(np.uint64))
        keys[at : at + len(key)] = key
    _, same = np.unique(keys, return_inverse=True)
    found = np.bincount(same, weights=np.repeat(times, windows))[same] >= 2
    return np.split(found, np.cumsum(windows)[:-1])


def runs(found: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, found.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def picks(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a list of texts: text number, first window, number of windows, place of the seed (all within the text)."""
    size = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    n = len(data)
    first = np.cumsum(np.r_[0, size[:-1]])
    if n < WINDOW:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    h = _RANDOM[data].astype(np.uint32)
    span = 1
    while span < SEED:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    place = np.arange(n - SEED + 1, dtype=np.uint64)
    key = mix(h[SEED - 1 :].astype(np.uint64)) >> np.uint64(32) << np.uint64(32) | place
    width = WINDOW - SEED + 1
    rows = -(-len(key) // width) + 1
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WINDOW + 1
    pick = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(raws)), size)[:windows]
    valid = np.arange(windows) + WINDOW <= (first + size)[text]
    new = valid & np.r_[True, (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])]
    starts = np.flatnonzero(new)
    last = np.minimum(np.r_[starts[1:], windows], (first + size)[text[starts]] - WINDOW + 1)
    return text[starts], starts - first[text[starts]], last - starts, pick[starts] - first[text[starts]]


def _number(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def contexts(docs: DataFrame) -> DataFrame:
    """seed, digest, doc_id, version, at, n: every context of every text, by hash; version tells rows with equal doc_id apart."""

    def run(batches):
        for ids, versions, texts in common.steps(batches, "doc_id", "version", "text"):
            raws = [t.encode("utf-8", "replace") for t in texts]
            cols = [[], [], [], [], [], []]
            for t, at, n, pick in zip(*(x.tolist() for x in picks(raws))):
                raw = raws[t]
                row = (_number(raw[pick : pick + SEED]), hashlib.blake2b(raw[at : at + n - 1 + WINDOW], digest_size=16).digest(), ids[t], versions[t], at, n)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["seed", "digest", "doc_id", "version", "at", "n"])

    return docs.mapInArrow(run, "seed long, digest binary, doc_id long, version long, at int, n int")


def _flag(batches):
    """Sorted rows (seed, digest, times, context): the repeated windows of contexts that occur once."""
    held: list[tuple[bytes, int, bytes]] = []
    size, last = 0, None

    def settle():
        digests, starts, ends = [], [], []
        for (digest, times, _), found in zip(held, repeated_windows([h[2] for h in held], [h[1] for h in held])):
            if times == 1:
                for s, e in runs(found):
                    digests.append(digest)
                    starts.append(s)
                    ends.append(e)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["digest", "start", "end"])

    for batch in batches:
        for seed, digest, times, context in zip(*(c.to_pylist() for c in batch.columns)):
            if held and seed != last and size > ARRAY_BYTES:
                yield settle()
                held, size = [], 0
            if not (held and held[-1][0] == digest):  # rows with equal doc_id and text bring a context twice
                held.append((digest, times, context))
                size += len(context)
            last = seed
    if held:
        yield settle()


def _windows(batches):
    """(high, low, digest, times, at) for every single window, by 128-bit hash."""
    for digests, times, texts in common.steps(batches, "digest", "times", "context"):
        cols = [[], [], [], [], []]
        for digest, n, raw in zip(digests, times, texts):
            for at in range(len(raw) - WINDOW + 1):
                h = hashlib.blake2b(raw[at : at + WINDOW], digest_size=16).digest()
                for c, v in zip(cols, (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), digest, n, at)):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["high", "low", "digest", "times", "at"])


def repeated_runs(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, version, runs (start, end of runs of windows that occur elsewhere too)."""
    n = docs.count()
    every = common.hold(contexts(docs))
    kinds = every.groupBy("seed", "digest").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "version", "at", "n")).alias("one"))
    kinds = common.materialise(kinds.select("seed", "digest", "times", "one.*"), "kinds")
    common.drop_shuffles(docs.sparkSession)
    shared = kinds.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = kinds.join(shared, "seed")
    per_doc = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("seed", "digest", "times", "at", "n", "kinds")).alias("wanted"))

    def fetch(batches):
        for lists, texts in common.steps(batches, "wanted", "text"):
            rows = []
            for wanted_, text in zip(lists, texts):
                raw = text.encode("utf-8", "replace")
                rows += [(w["seed"], w["digest"], w["times"], w["kinds"], raw[w["at"] : w["at"] + w["n"] - 1 + WINDOW]) for w in wanted_]
            kinds_ = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds_)], names=["seed", "digest", "times", "kinds", "context"])

    fetched = docs.join(per_doc, ["doc_id", "version"]).select("wanted", "text")
    fetched = common.materialise(fetched.mapInArrow(fetch, "seed long, digest binary, times long, kinds long, context binary"), "fetched", n)
    common.drop_shuffles(docs.sparkSession)
    few = fetched.filter(F.col("kinds") <= most).select("seed", "digest", "times", "context").repartition("seed").sortWithinPartitions("seed", "digest")
    flagged = few.mapInArrow(_flag, "digest binary, start int, end int")
    many = fetched.filter(F.col("kinds") > most).dropDuplicates(["seed", "digest"]).select("digest", "times", "context")
    single = many.mapInArrow(_windows, "high long, low long, digest binary, times long, at int")
    twice = single.groupBy("high", "low").agg(F.sum("times").alias("all")).filter("all > 1").select("high", "low")
    spread = single.join(twice, ["high", "low"]).filter("times = 1").select("digest", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    whole = kinds.filter("times > 1").select("digest", F.lit(0).alias("start"), F.col("n").alias("end"))
    known = common.materialise(whole.unionByName(flagged).unionByName(spread), "repeated", n)
    common.drop_shuffles(docs.sparkSession)
    met = every.select("digest", "doc_id", "version", "at").join(known, "digest")
    return met.groupBy("doc_id", "version").agg(F.collect_list(F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))).alias("runs"))


def covered(found: list[dict] | None) -> list[tuple[int, int]]:
    """Byte spans that runs of windows cover, merged."""
    spans: list[tuple[int, int]] = []
    for s, e in sorted((r["start"], r["end"] - 1 + WINDOW) for r in found or ()):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans


def dedup(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    own = F.col("doc_id").alias("own_id")
    rows = common.doc_columns(docs).select(own, F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    found = common.materialise(repeated_runs(rows.drop("own_id"), most), "runs", rows.count())
    common.drop_shuffles(docs.sparkSession)
    met = rows.join(found, ["doc_id", "version"], "left").select(F.col("own_id").alias("doc_id"), "runs", "text")

    def run(batches):
        for ids, runs_, texts in common.steps(batches, "doc_id", "runs", "text"):
            raws, spans = [t.encode("utf-8", "replace") for t in texts], [covered(r) for r in runs_]
            kept = []
            for raw, some in zip(raws, spans):
                h, at = hashlib.sha256(), 0
                for s, e in some:
                    h.update(raw[at:s])
                    at = e
                h.update(raw[at:])
                kept.append(h.hexdigest())
            cols = [pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(kept), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("spans")
