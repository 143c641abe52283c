"""Vector code compression: product quantisation of integer vectors by delta-maintained Lloyd rounds.

A vector's components become integers, floor(256 x), and its PARTS equal parts are each coded by the nearest of at most ENTRIES entries of
the part's codebook. Assignments are kept as a table from round to round, and so are each entry's count and component sums: a
round assigns every part anew and sends only what changed, minus one member of the old entry and plus one of the new, added up in each task before
the shuffle (at most PARTS * ENTRIES rows a task, whatever the table's size). All sums are of integers, so results don't depend on order.

Defined results: rows whose vector is null, or has a null or non-finite component, are dropped, and so are vectors whose length is no positive multiple of
PARTS or differs from that of the first kept vector (least vec_id, then least vector); of rows that share a vec_id the least vector may begin a
codebook, once; rows without a vec_id are coded, but begin none; fewer than ENTRIES vectors make smaller codebooks; integers beyond
LIMIT either way are held at it, so that no distance overflows; repeated rows are coded alike; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held within this, far beyond what embeddings have.
LIMIT = 1 << 25
#: Distinct labels whose totals are broadcast at most; beyond, they are joined.
LABEL_BOUND = 100_000
STATE = "vec_id long, label string, cells array<long>, old binary, new binary"


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), cells (the integers) of all rows that are coded."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & ~F.coalesce(bad, F.lit(True))
    cells = F.transform(v, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(whole, cells).alias("cells"))
    return rows.filter(F.col("cells").isNotNull())


def nearest(cells: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's entry, the lower index of equally near ones, and its squared distance; cells: rows, parts, width; books: parts, entries, width."""
    index = np.empty(cells.shape[:2], dtype=np.uint8)
    far = np.empty(cells.shape[:2], dtype=np.int64)
    for p in range(cells.shape[1]):
        apart = np.zeros((len(cells), books.shape[1]), dtype=np.int64)
        for c in range(cells.shape[2]):
            step = cells[:, p, c, None] - books[p, None, :, c]
            apart += step * step
        index[:, p] = apart.argmin(axis=1)
        far[:, p] = np.take_along_axis(apart, index[:, p, None].astype(np.int64), axis=1)[:, 0]
    return index, far


def matrix(column: pa.ListArray) -> np.ndarray:
    """rows, parts, width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PARTS, -1)


def codes(column: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), PARTS)


class Books:
    """The codebooks, and the running count and sums of each entry's parts."""

    def __init__(self, first: list[list[int]]):
        cells = np.array(first, dtype=np.int64).reshape(len(first), PARTS, -1)
        self.entries = cells.transpose(1, 0, 2).copy()
        self.count = np.zeros(self.entries.shape[:2], dtype=np.int64)
        self.sums = np.zeros(self.entries.shape, dtype=np.int64)

    def add(self, changes: list) -> Books:
        """Takes plus and minus contributions in and moves every used entry to the floor of its parts' mean."""
        for part, entry, n, sums in changes:
            self.count[part, entry] += n
            self.sums[part, entry] += np.array(sums, dtype=np.int64)
        used = self.count > 0
        self.entries[used] = self.sums[used] // self.count[used][:, None]
        return self

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_vectors(rows: DataFrame, entries: int) -> tuple[int, list[list[int]]]:
    """The length that counts, and the cells of the least vec_ids that have it."""
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "cells").select(F.size("cells")).first()
    if head is None:
        return 0, []
    # Sums first: a vec_id that many rows share goes as one row from each task.
    named = rows.filter((F.size("cells") == head[0]) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("cells").alias("cells"))
    found = [r["cells"] for r in named.orderBy("vec_id").limit(entries).collect()]  # at most `entries` rows
    return head[0], found or [rows.filter(F.size("cells") == head[0]).agg(F.min("cells")).first()[0]]


def assigned(state: DataFrame, books: np.ndarray, final: bool) -> DataFrame:
    """STATE with `new` turned `old` and assigned anew, or the codes and errors at last."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, *rest = (batch.column(batch.schema.get_field_index(c)) for c in ("cells", "vec_id", "label", "new"))
            index, far = nearest(matrix(cells), books)
            if final:
                cols = [rest[0], rest[1], pa.array([x.tobytes().hex() for x in index], pa.string()), pa.array(far.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([rest[0], rest[1], cells, rest[2], pa.array([x.tobytes() for x in index], pa.binary())], names=["vec_id", "label", "cells", "old", "new"])

    return state.mapInArrow(run, "vec_id long, label string, code string, error long" if final else STATE)


def contributions(state: DataFrame, width: int, entries: int) -> DataFrame:
    """part, entry, n, sums: what parts whose assignment changed take from their old entry and give to their new one; added up in each task."""

    def run(batches):
        n, sums = np.zeros((PARTS, entries), dtype=np.int64), np.zeros((PARTS, entries, width), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = matrix(batch.column(batch.schema.get_field_index("cells")))
            new, old = (batch.column(batch.schema.get_field_index(c)) for c in ("new", "old"))
            now = codes(new)
            if old.null_count:  # the first round
                changed, turns = np.ones(now.shape, dtype=bool), ((now, 1),)
            else:
                before = codes(old)
                changed, turns = now != before, ((now, 1), (before, -1))
            row, part = np.nonzero(changed)
            for index, sign in turns:
                np.add.at(n, (part, index[row, part]), sign)
                np.add.at(sums, (part, index[row, part]), sign * cells[row, part])
        part, entry = np.nonzero((n != 0) | (sums != 0).any(axis=2))
        cols = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", "sums"])

    sent = state.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    return added.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("sums"))


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256."""
    spark = common.ship(vectors.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    rows = kept(vectors)
    size, first = first_vectors(rows, entries)
    state = rows.filter(F.size("cells") == size).select("vec_id", "label", "cells", F.lit(None).cast("binary").alias("old"), F.lit(None).cast("binary").alias("new"))
    if not first:
        return state.select("vec_id", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    books = Books(first)
    for k in range(rounds):
        state = common.materialise(assigned(state, books.entries, False), f"codes-{k}")
        books.add(contributions(state, size // PARTS, len(first)).collect())  # at most PARTS * entries rows
    coded = common.materialise(assigned(state, books.entries, True), "coded")
    key = F.struct(F.col("label").isNull(), F.coalesce("label", F.lit(""))).alias("key")
    totals = coded.groupBy(key).agg(F.sum("error").alias("label_error"))
    totals = common.materialise(totals, "label-errors")
    whole = coded.withColumn("key", key).join(F.broadcast(totals) if totals.count() <= LABEL_BOUND else totals, "key")
    return whole.select("vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(common.table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
