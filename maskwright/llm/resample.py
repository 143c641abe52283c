"""Target-distribution importance resampling: hashed n-gram weights, an exact k-th key by radix selection, ranks.

Features of a text are its runs of one to three words, in BUCKETS buckets by crc32. Two tables of counts, over all documents and over
all target texts, give each bucket an integer gain; a document's weight is the sum of its features' gains, and its score adds Gumbel noise
from a hash of its doc_id, so that the highest scores are a sample without replacement in proportion to exp(weight / 1000).

A batch's texts are hashed as arrays: words are found and hashed over their bytes, and a run's crc32 follows from those of its words, as
crc32 is linear (crc(ab) = crc(a) advanced by the length of b, xor crc(b)). A task adds up one array of BUCKETS counts, so the
sums that are shuffled don't grow with the text. The k-th key in the order (highest score, smallest doc_id) is found exactly, 16 bits
at a time: each round counts one digit of the rows that are still possible, which is at most 65,536 sums. Only selected rows are
range-sorted; ranks are a partition's offset plus the place in it.

Defined results: null and empty texts have no features, weight 0 and no rank; rows without a doc_id take noise from an empty id and lose
ties; of rows alike in score and doc_id so many are drawn as there is room for; with no target text all gains follow from the documents
alone; an empty table gives no row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
#: Bits of a key that one round of the selection decides.
DIGIT = 16
#: Bytes of text hashed at once; words up to LONG bytes go through arrays, longer ones one by one.
STEP, LONG = 1_000_000, 64
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The crc32 of each byte value, and advances: [n, j, b] is byte b at place j of a crc that n zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ (step & np.uint32(1)) * np.uint32(0xEDB88320)
    advance = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(255):
        advance.append(step[advance[-1] & np.uint32(255)] ^ (advance[-1] >> np.uint32(8)))
    return step, np.stack(advance)


_STEP, _ADVANCE = _tables()


def advanced(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each crc as n zero bytes leave it (both ends' inversions cancel)."""
    while True:
        some = np.minimum(n, 255)
        crc = _ADVANCE[some, 0, crc & 255] ^ _ADVANCE[some, 1, (crc >> 8) & 255] ^ _ADVANCE[some, 2, (crc >> 16) & 255] ^ _ADVANCE[some, 3, crc >> 24]
        n = n - some
        if not n.any():
            return crc


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each word, byte by byte over all words that have one there."""
    order = np.argsort(-size, kind="stable")
    first, length = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(min(LONG, int(length[0]) if len(length) else 0)):
        m = int(np.searchsorted(-length, -k, side="left"))
        crc[:m] = _STEP[(crc[:m] ^ data[first[:m] + k]) & 255] ^ (crc[:m] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-length, -LONG, side="left"))):
        crc[i] = zlib.crc32(data[first[i] : first[i] + length[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of every feature, and each text's words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, dtype=np.uint8)
    bounds = offsets - offsets[0]
    inside = _WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = bounds[1:] > bounds[:-1]
    begins[bounds[:-1][full]], ends[bounds[1:][full] - 1] = inside[bounds[:-1][full]], inside[bounds[1:][full] - 1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    text = np.searchsorted(bounds, start, side="right") - 1
    one = word_crcs(data, start, size)
    behind = advanced(np.full(len(one), zlib.crc32(b" "), dtype=np.uint32), size) ^ one  # of a blank and the word
    pair = text[1:] == text[:-1]
    two = advanced(one[:-1], size[1:] + 1) ^ behind[1:]
    triple = pair[1:] & pair[:-1]
    three = advanced(two[:-1], size[2:] + 1) ^ behind[2:]
    bucket = np.concatenate([one, two[pair], three[triple]]) % BUCKETS
    return np.concatenate([text, text[1:][pair], text[2:][triple]]), bucket, np.bincount(text, minlength=len(texts))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about STEP bytes of text (a single longer text stands alone)."""
    for batch in batches:
        width = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(width, (width[at - 1] if at else 0) + STEP, side="right")))
            yield batch.slice(at, to - at)
            at = to


def bucket_counts(texts: DataFrame) -> list[int]:
    """Features of all texts in each bucket; a task gives one row of at most BUCKETS sums."""

    def run(batches):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in _slices(batches):
            counts += np.bincount(features(batch.column(batch.schema.get_field_index("text")))[1], minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])
        common.trim()

    common.ship(texts.sparkSession)
    sums = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    counts = [0] * BUCKETS
    for bucket, n in sums:
        counts[bucket] = n
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln ratio) of the smoothed shares that a bucket has in the target and in the source."""
    all_s, all_t = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(source, target)]


def weigh(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    gain = np.array(gain, dtype=np.float64)  # sums are exact up to 2 ** 53

    def run(batches):
        for batch in _slices(batches):
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            at, bucket, words = features(texts)
            weight = np.bincount(at, weights=gain[bucket], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.astype(np.int64)), pa.array(np.bincount(at, minlength=len(texts)).astype(np.int64)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
        common.trim()

    return common.doc_columns(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x) of a Gumbel variate that a hash of the seed and the doc_id gives."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth(rows: DataFrame, names: list[str], k: int) -> list[int]:
    """The k-th smallest (k from 1) of the tuples in long columns, exactly, by counting one digit at a time of those still possible."""
    found, top = [], 1 << 63
    for name in names:
        value = F.col(name).bitwiseXOR(F.lit(-top))  # the sign turned: order as of unsigned numbers
        low, high = (x + top for x in rows.agg(F.min(name), F.max(name)).first())
        shift = -(-(low ^ high).bit_length() // DIGIT) * DIGIT  # bits above are the same in all rows
        key = high >> shift
        while shift:
            shift -= DIGIT
            digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")
            for digit_, n in sorted(rows.groupBy(digit).count().collect()):  # at most 2 ** DIGIT rows
                if k <= n:
                    break
                k -= n
            key = key << DIGIT | digit_
            rows = rows.filter(digit == digit_)
        found.append(key - top)
    return found


def ranked(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """rows with `rank` from 1 in the columns' order: range-sorted partitions, each after those before it."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names).withColumn("place_", F.monotonically_increasing_id())
    sorted_ = common.materialise(sorted_, label)  # places stand from here on
    part = F.shiftright("place_", 33).cast("int")
    offsets, at = [(-1, 0)], 0
    for p, n in sorted(sorted_.groupBy(part.alias("p")).count().collect()):  # a row a partition
        offsets.append((p, at))
        at += n
    placed = sorted_.withColumn("part_", part).join(F.broadcast(spark.createDataFrame(offsets, "part_ int, offset_ long")), "part_")
    return placed.withColumn("rank", F.col("offset_") + F.col("place_").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part_", "offset_", "place_")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null if not drawn): floor(percent * N / 100) of the N documents with least_words words or more."""
    gain = gains(bucket_counts(common.doc_columns(docs)), bucket_counts(target.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = common.materialise(scored.withColumns({"down_": -F.col("score"), "id_": F.coalesce("doc_id", F.lit((1 << 63) - 1))}), "scores")
    able = F.col("n_words") >= least_words
    k = percent * scored.filter(able).count() // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    down, last = kth(scored.filter(able).select("down_", "id_"), ["down_", "id_"], k)
    chosen = able & ((F.col("down_") < down) | (F.col("down_") == down) & (F.col("id_") <= last))
    drawn = ranked(scored.filter(chosen), ["down_", "id_"], "drawn")
    # More rows than k only where rows are alike in both.
    drawn = drawn.select(*names, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.filter(~chosen).select(*names, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
