"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash over the last WINDOW bytes marks cut points by content alone, so an insertion moves only the chunks that it
touches. From every cut point a variable chunk runs to the first one at least SMALLEST bytes on; chunks overlap, and
which ones a passage has depends on the passage alone, wherever it stands. Chunks meet by digest. Neighbouring repeated chunks
are a run; at a run's ends the chunk's bytes and those beside it are compared with another occurrence, so that a
passage goes whole. A stretch so found is repeated if it has `least` bytes or WORDS words. The first occurrence
of each chunk, by (doc_id, hash of the text, position), stays and the others are cut out.

Sums per digest are built map-side and chunks meet them in joins that Spark splits where a digest is hot; a
document's chunks are gathered with the bytes beside its runs, never a digest's documents.

Defined results: null and empty texts, and those of under SMALLEST bytes, lose nothing; cuts never split a character; rows are told apart by
doc_id and text, so texts that share a doc_id, or have none (they come last), lose what texts with ids of their own would; of rows alike in both
one keeps its text and the others lose it whole, if it is long enough to be a repeat; an empty table gives no row; other columns are kept by `cut` and ignored by the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes: gear window, least chunk, greatest gap between cut points; one position in MEAN is a cut point.
WINDOW, SMALLEST, GREATEST, MEAN = 16, 40, 256, 40
#: A repeated stretch has so many bytes or words at least.
LEAST, WORDS = 250, 50
#: Bytes beside a chunk that are compared.
CONTEXT = 320
_GEAR = np.random.default_rng(2).integers(0, 1 << 16, 256, dtype=np.uint16)
#: A row without a doc_id comes after all others.
LAST = (1 << 63) - 1
#: Shares that a group of rows alike is dealt over.
SALTS = 4096


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, sum over the last 16 bytes of their gear values shifted by their distance (16-bit state)."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint16(span)
        span *= 2
    return h


def cut_points(raws: list[bytes]) -> list[np.ndarray]:
    """Each text's cut points, its start and end included: where the hash is in its lowest MEAN-th part, at a character's start; in longer gaps every GREATEST bytes."""
    gap = bytes(WINDOW)
    data = np.frombuffer(gap.join([b"", *raws, b""]), dtype=np.uint8)
    ends = np.flatnonzero(gear(data) < (1 << 16) // MEAN) + 1
    ends = ends[(data[np.minimum(ends, len(data) - 1)] & 0xC0) != 0x80]
    out, start = [], WINDOW
    for raw in raws:
        stop = start + len(raw)
        lo, hi = np.searchsorted(ends, (start + 1, stop))
        cuts = np.concatenate([[0], ends[lo:hi] - start, [len(raw)]])
        wide = np.flatnonzero(np.diff(cuts) > GREATEST)
        if len(wide):
            more = []
            for a, b in zip(cuts[wide].tolist(), cuts[wide + 1].tolist()):
                for at in range(a + GREATEST, b, GREATEST):
                    while at < b and raw[at] & 0xC0 == 0x80:
                        at += 1
                    more.append(at)
            cuts = np.unique(np.concatenate([cuts, np.asarray(more, dtype=np.int64)]))
        out.append(cuts)
        start = stop + WINDOW
    return out


def chunk_spans(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's chunks: from every cut point to the first one at least SMALLEST bytes on."""
    out = []
    for cuts in cut_points(raws):
        to = np.searchsorted(cuts, cuts + SMALLEST)
        whole = to < len(cuts)
        out.append((cuts[whole], cuts[to[whole]]))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, LAST for null), version (tells texts of one doc_id apart), text."""
    return common.doc_columns(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text")


def chunk(rows: DataFrame) -> DataFrame:
    """digest, doc, version, place (first byte * 2048 + size, and 1024 more where the text ends with the chunk): every chunk of every text."""

    def run(batches):
        for docs, versions, texts in common.steps(batches, "doc", "version", "text"):
            raws = [t.encode("utf-8", "replace") for t in texts]
            spans = chunk_spans(raws)
            digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for raw, (s, e) in zip(raws, spans) for a, b in zip(s.tolist(), e.tolist()))
            n = [len(s) for s, _ in spans]
            place = np.concatenate([s * 2048 + (e - s) + 1024 * (e == len(raw)) for raw, (s, e) in zip(raws, spans)])
            cols = [pa.array(np.frombuffer(digests, dtype="<i8")), pa.array(np.repeat(np.array(docs, dtype=np.int64), n)), pa.array(np.repeat(np.array(versions, dtype=np.int64), n)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(cols, names=["digest", "doc", "version", "place"])

    return rows.mapInArrow(run, "digest long, doc long, version long, place long")


class Parts:
    """A document's repeated chunks in order: first bytes, ends, digests, and whether each one stays (it is its digest's first occurrence)."""

    def __init__(self, place: np.ndarray, digest: np.ndarray, own: np.ndarray):
        order = np.argsort(place, kind="stable")
        self.place, self.digest = place[order], digest[order]
        self.at, self.last = self.place >> 11, (self.place & 1024) > 0
        self.end = self.at + (self.place & 1023)
        first = np.zeros(len(order), dtype=bool)
        first[np.unique(self.digest, return_index=True)[1]] = True
        self.stays = own[order] & first

    def runs(self, gone: bool) -> list[tuple[int, int]]:
        """Runs of overlapping or touching chunks - only of those that go, or of all - by their first and last chunk."""
        some = np.flatnonzero(~self.stays) if gone else np.arange(len(self.at))
        if not len(some):
            return []
        new = np.flatnonzero(self.at[some][1:] > self.end[some][:-1]) + 1  # ends ascend with first bytes
        return list(zip(some[np.r_[0, new]].tolist(), some[np.r_[new - 1, len(some) - 1]].tolist()))

    def ends(self) -> set[tuple[int, int, bool]]:
        """(digest, side, before) of chunks at the ends of runs where the text goes on, with what stands before or behind them: side 0 asks for the first occurrence, 1 for the last one."""
        out = set()
        for gone in (True, False):
            for left, right in self.runs(gone):
                out |= {(left, True)} if self.at[left] else set()
                out |= set() if self.last[right] else {(right, False)}
        return {(int(self.digest[k]), int(self.stays[k]), before) for k, before in out}


def part_lists(column: pa.ListArray) -> list[Parts | None]:
    """Each row's chunks; none for a null."""
    values, offsets = column.values, column.offsets.to_pylist()
    place, digest, own = (values.field(k).to_numpy(zero_copy_only=False) for k in ("place", "digest", "own"))
    return [Parts(place[a:b], digest[a:b], own[a:b].astype(bool)) if ok else None for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist())]


def repeats(rows: DataFrame, n: int) -> DataFrame:
    """doc, version, parts (place, digest, own: whether the document has the digest's first occurrence)."""
    sums = chunk(rows).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "version")).alias("first")).filter("n > 1").select("digest", "first")
    sums = common.materialise(sums, "repeated-chunks", n)  # a plain table: Spark can then split a hot digest's side of the join
    common.drop_shuffles(rows.sparkSession)
    met = chunk(rows).join(sums, "digest").select("doc", "version", F.struct("place", "digest", (F.struct("doc", "version") == F.col("first")).alias("own")).alias("p"))
    return common.materialise(met.groupBy("doc", "version").agg(F.collect_set("p").alias("parts")), "parts", n)


def beside(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """doc, version, others (digest, side, before, itself, at: where in `bytes` the chunk begins, size, bytes): what the ends of a document's runs are compared with."""

    def ask(batches):
        for batch in batches:
            docs, versions = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "version"))
            parts = part_lists(batch.column(batch.schema.get_field_index("parts")))
            out = [(d, v, *a) for d, v, some in zip(docs, versions, parts) for a in some.ends()]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["doc", "version", "digest", "side", "before"])
        common.trim()

    asks = common.materialise(found.mapInArrow(ask, "doc long, version long, digest long, side int, before boolean"), "asks", n)
    places = found.select("doc", "version", F.explode("parts").alias("p")).select("doc", "version", "p.place", "p.digest")
    # Sums before the join: a document gives its first and last place of each digest, a task its least and greatest document.
    ends = places.groupBy("digest").agg(F.min(F.struct("doc", "version", "place")).alias("e0"), F.max(F.struct("doc", "version", "place")).alias("e1"))
    wanted = asks.groupBy("digest", "side", "before").agg(F.count("*").alias("n"))
    known = wanted.join(ends, "digest").select("digest", "side", "before", F.when(F.col("side") == 0, F.col("e0")).otherwise(F.col("e1")).alias("e"))
    per_doc = known.groupBy("e.doc", "e.version").agg(F.collect_set(F.struct("digest", "side", "before", "e.place")).alias("places"))

    def fetch(batches):
        for docs, versions, places, texts in common.steps(batches, "doc", "version", "places", "text"):
            out = []
            for d, v, some, text in zip(docs, versions, places, texts):
                raw = text.encode("utf-8", "replace")
                for p in some:
                    at, n = p["place"] >> 11, p["place"] & 1023
                    begin, stop = (max(0, at - CONTEXT), at + n) if p["before"] else (at, at + n + CONTEXT)
                    out.append((p["digest"], p["side"], p["before"], d, v, p["place"], at - begin, n, raw[begin:stop]))
            cols = list(zip(*out)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["digest", "side", "before", "other_doc", "other_version", "other_place", "at", "size", "bytes"])

    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    # Rows that are alike in doc_id and text each have the same bytes to give.
    fetched = rows.join(per_doc, ["doc", "version"]).select("doc", "version", "places", "text").mapInArrow(fetch, "digest long, side int, before boolean, other_doc long, other_version long, other_place long, at long, size long, bytes binary")
    contexts = common.materialise(fetched.dropDuplicates(["digest", "side", "before"]), "contexts", n)
    common.drop_shuffles(rows.sparkSession)
    itself = (F.col("doc") == F.col("other_doc")) & (F.col("version") == F.col("other_version"))
    met = asks.join(contexts, ["digest", "side", "before"]).select("doc", "version", F.struct("digest", "side", "before", F.when(itself, F.col("other_place")).alias("itself"), "at", "size", "bytes").alias("o"))
    return met.groupBy("doc", "version").agg(F.collect_set("o").alias("others"))


def agreeing(x: bytes, y: bytes) -> int:
    """Equal bytes at the beginning of both."""
    n = min(len(x), len(y))
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


def stretches(raw: bytes, parts: Parts, others: list[dict], gone: bool) -> list[tuple[int, int]]:
    """Runs with what agrees beside them; a run whose end another text doesn't bear out is none."""
    known = {(o["digest"], o["side"], o["before"]): o for o in others}
    out: list[tuple[int, int]] = []
    for left, right in parts.runs(gone):
        s, e = start, stop = int(parts.at[left]), int(parts.end[right])
        for k, before in ((left, True), (right, False)):
            at, to = int(parts.at[k]), int(parts.end[k])
            if (at if before else len(raw) - to) == 0:
                continue
            o = known.get((int(parts.digest[k]), int(parts.stays[k]), before))
            if o is None or o["itself"] == parts.place[k]:  # only a repeated row has no other occurrence
                break
            there = o["at"] + o["size"]
            if o["bytes"][o["at"] : there] != raw[at:to]:
                break
            if before:
                s = start - agreeing(raw[max(0, at - CONTEXT) : at][::-1], o["bytes"][: o["at"]][::-1])
            else:
                e = stop + agreeing(raw[to : to + CONTEXT], o["bytes"][there:])
        else:
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            else:
                out.append((s, e))
    return out


def repeated(raw: bytes, parts: Parts | None, others: list[dict] | None, least: int) -> tuple[int, list[tuple[int, int]]]:
    """Bytes in repeated stretches, whether they stay or go, and the spans to cut."""
    if parts is None:
        return 0, []
    long = lambda spans: [(s, e) for s, e in spans if e - s >= least or len(raw[s:e].split()) >= WORDS]
    whole = []
    for s, e in long(stretches(raw, parts, others or [], True)):
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while s < e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        whole.append((s, e))
    return sum(e - s for s, e in long(stretches(raw, parts, others or [], False))), whole


def numbered(rows: DataFrame, doc: str = "doc", version: str = "version", again: str = "again") -> DataFrame:
    """rows with `again`: whether another row that is alike in doc and version was chosen to stay.

    Only rows that have such a twin are dealt out anew, in two steps, so that no group of them is ever one task's: one of each
    of SALTS shares of a group first, then one of these."""
    twins = common.materialise(rows.groupBy(doc, version).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twins", 0)
    if twins.isEmpty():
        return rows.withColumn(again, F.lit(False))
    some = rows.join(twins, [doc, version], "left_semi").withColumn("cut_salt_", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    some = some.withColumn("cut_at_", F.row_number().over(Window.partitionBy(doc, version, "cut_salt_").orderBy(F.lit(0))))
    # The first of each share meets the others' firsts; all other rows stay alone.
    first = F.col("cut_at_") == 1
    some = some.withColumn("cut_share_", F.when(~first, F.struct("cut_salt_", "cut_at_")))
    chosen = F.row_number().over(Window.partitionBy(doc, version, "cut_share_").orderBy("cut_salt_")) == 1
    some = some.withColumn(again, ~(first & chosen)).drop("cut_salt_", "cut_at_", "cut_share_")
    return rows.join(twins, [doc, version], "left_anti").withColumn(again, F.lit(False)).unionByName(some)


def all_of(raw: bytes, least: int) -> tuple[int, list[tuple[int, int]]]:
    """A row whose twin stays: all of it is repeated."""
    return (len(raw), [(0, len(raw))]) if len(raw) >= least or len(raw.split()) >= WORDS else (0, [])


def hits(docs: DataFrame) -> DataFrame:
    """doc, version, parts, others of every row that has repeated chunks."""
    rows = keyed(docs)
    n = docs.count()
    found = repeats(rows, n)
    common.drop_shuffles(docs.sparkSession)
    return found.join(beside(rows, found, n), ["doc", "version"], "left")


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256, text (what is kept)."""
    rows = common.doc_columns(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text")
    met = numbered(rows).join(hits(docs), ["doc", "version"], "left").select("doc_id", "again", "parts", "others", "text")

    def run(batches):
        for batch in batches:
            ids, again, others, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "again", "others", "text"))
            parts = part_lists(batch.column(batch.schema.get_field_index("parts")))
            raws = [t.encode("utf-8", "replace") for t in texts]
            found = [all_of(r, least) if a else repeated(r, p, o, least) for r, a, p, o in zip(raws, again, parts, others)]
            kept = [without(r, s) for r, (_, s) in zip(raws, found)]
            cols = [
                pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array([n for n, _ in found], pa.int64()),
                pa.array([len(r) - len(k) for r, k in zip(raws, kept)], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256", "text"])
        common.trim()

    return met.mapInArrow(run, "doc_id long, n_bytes long, n_repeated long, n_removed long, n_spans long, kept_sha256 string, text string")


def cut(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs, all columns, with repeated stretches cut from text and n_chars, if there, set anew."""
    found = hits(docs).withColumnsRenamed({c: f"cut_{c}_" for c in ("doc", "version", "parts", "others")})
    keyed_ = docs.withColumns({"cut_doc_": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "cut_version_": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    rows = numbered(keyed_, "cut_doc_", "cut_version_", "cut_again_")
    met = rows.join(found, ["cut_doc_", "cut_version_"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "cut_again_", "cut_parts_", "cut_others_")

    def shorter(text: str | None, again: bool, parts: Parts | None, others: list[dict] | None) -> str | None:
        if text is None or parts is None and not again:
            return text
        raw = text.encode("utf-8", "replace")
        spans = (all_of(raw, least) if again else repeated(raw, parts, others, least))[1]
        return without(raw, spans).decode("utf-8", "replace") if spans else text

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, others = batch.column(at), batch.column(batch.schema.get_field_index("cut_others_"))
            parts = part_lists(batch.column(batch.schema.get_field_index("cut_parts_")))
            again = batch.column(batch.schema.get_field_index("cut_again_")).to_pylist()
            kept = [shorter(t.as_py(), a, p, o.as_py()) for t, a, p, o in zip(texts, again, parts, others)]
            changed = [k is not None and k != t.as_py() for k, t in zip(kept, texts)]
            out = batch.drop_columns(["cut_again_", "cut_parts_", "cut_others_"])
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(kept, out.schema.field("text").type))
            if (n := out.schema.get_field_index("n_chars")) >= 0:
                fresh = [len(k) if c else old for k, c, old in zip(kept, changed, out.column(n).to_pylist())]
                out = out.set_column(n, "n_chars", pa.array(fresh, out.schema.field(n).type))
            yield out
        common.trim()

    return met.mapInArrow(run, docs.schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
