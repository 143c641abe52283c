"""Token ids as canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints.

Ids are encoded once and kept; their global counts (at most the vocabulary) give code lengths by package-merge.
Blocks of whole documents, in ascending doc_id order, hold the code bits and a checkpoint - a bit offset - for
every SEGMENT ids, from which a table lookup per id decodes all segments of a block side by side. The file is a
Parquet folder of block rows beside a codebook folder of (id, length); the code itself follows from the lengths.

Defined results: null and empty texts have the end id alone; documents with equal doc_id follow each other;
an empty table writes an empty folder and returns no row; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import default_tokenizer, encode

#: Longest code; ids that share a checkpoint; ids of a block (more only for a longer document).
LONGEST, SEGMENT, BLOCK = 20, 256, 1 << 18
BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<long>, counts array<long>, checkpoints array<long>, bits binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Package-merge: optimal code lengths of at most `longest` for ids with counts (0: no code)."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    ids = np.flatnonzero(counts)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[ids].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        both = both[order]
        packages = both[0 : len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, found = 2 * (len(ids) - 1), np.zeros(len(ids), dtype=np.int64)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        found[:k] += 1
        take = 2 * (take - k)
    lengths[ids] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """For each LONGEST-bit window: the id it starts with, and from bit 27 on that code's length."""
    table = np.zeros(1 << LONGEST, dtype=np.uint32)
    codes = canonical(lengths)
    for i in np.flatnonzero(lengths).tolist():
        n = int(lengths[i])
        at = int(codes[i]) << LONGEST - n
        table[at : at + (1 << LONGEST - n)] = i | n << 27
    return table


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    n = lengths[ids]
    ends = np.cumsum(n)
    at = ends - n
    left = codes[ids] << (64 - n).astype(np.uint64)
    shift, word = (at & 63).astype(np.uint64), at >> 6
    words = np.zeros(int(ends[-1] >> 6) + 2, dtype=np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[starts]] = np.bitwise_or.reduceat(left >> shift, starts)
    over = np.flatnonzero((at & 63) + n > 64)
    words[word[over] + 1] |= left[over] << (np.uint64(64) - shift[over])
    return words.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], at[::SEGMENT]


def read_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """All segments at once: one table lookup for each id."""
    raw = np.frombuffer(bits + bytes(8), dtype=np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((SEGMENT, len(at)), dtype=np.uint32)
    most = 8 * (len(words) - 1)
    for k in range(SEGMENT):
        window = words[at >> 3] << (at & 7).astype(np.uint32) >> np.uint32(32 - LONGEST)
        found = table[window]
        out[k] = found & np.uint32(0x7FFFFFF)
        at += found >> np.uint32(27)
        np.minimum(at, most, out=at)
    return out.T.reshape(-1)[:n]


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, wide, ids: each document's ids with end_id behind, as compressed little-endian unsigned 16-bit (32-bit where an id needs it: wide)."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for ids, texts in common.steps(batches, "doc_id", "text"):
            found = encode(path, texts, end_id)
            wide = [bool((x > 0xFFFF).any()) for x in found]
            raw = [packer.compress(x.astype("<u4" if w else "<u2").tobytes()) for x, w in zip(found, wide)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(wide), pa.array(raw, pa.binary())], names=["doc_id", "wide", "ids"])

    return common.doc_columns(docs).mapInArrow(run, "doc_id long, wide boolean, ids binary")


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4" if wide else "<u2")


def id_counts(ids: DataFrame) -> DataFrame:
    """id, n over all documents; each task sums before anything is shuffled."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for wide, raw in common.steps(batches, "wide", "ids"):
            some = np.bincount(np.concatenate([_ids(r, w) for r, w in zip(raw, wide)]), minlength=len(total))
            some[: len(total)] += total
            total = some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    return ids.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_blocks(ids: DataFrame, lengths: np.ndarray, path: str) -> None:
    """The file: path/codebook (id, length) and path/blocks, in ascending doc_id order by (part, block)."""
    spark = ids.sparkSession
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches):
        codes, part, block, first = canonical(lengths), TaskContext.get().partitionId(), 0, 0
        docs, counts, held, size = [], [], [], 0

        def flush():
            nonlocal docs, counts, held, size, block, first
            all_ids = np.concatenate(held)
            bits, marks = write_bits(all_ids, codes, lengths)
            row = {"part": [part], "block": [block], "first": [first], "n_ids": [size], "doc_ids": [docs], "counts": [counts], "checkpoints": [marks.tolist()], "bits": [bits]}
            block, first, docs, counts, held, size = block + 1, first + size, [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for ids_, wide, raw in common.steps(batches, "doc_id", "wide", "ids"):
            for doc, w, r in zip(ids_, wide, raw):
                some = _ids(r, w)
                if size and size + len(some) > BLOCK:
                    yield flush()
                docs.append(doc)
                counts.append(len(some))
                held.append(some)
                size += len(some)
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary())])
    # Rows that share a doc_id, or have none, are dealt over tasks by their number.
    ordered = ids.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_documents(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start and either ids (little-endian uint32 bytes) or n_tokens and their crc32, of each document, decoded from the file."""
    book = spark.read.schema("id long, length int").parquet(f"{path}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max((r[0] for r in book), default=0) + 1, dtype=np.int64)
    for i, n in book:
        lengths[i] = n
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    base, run_ = {}, 0
    for part, n in sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect())):  # one row a written partition
        base[part], run_ = run_, run_ + n

    def run(batches):
        table = decoding_table(lengths)
        for b in batches:
            for r in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                raw = read_bits(r["bits"], np.asarray(r["checkpoints"]), r["n_ids"], table).astype("<u4").tobytes()
                ends = np.cumsum(r["counts"])
                starts = ends - r["counts"]
                each = [raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + base[r["part"]] + r["first"], pa.int64())]
                cols += [pa.array(r["counts"], pa.int64()), pa.array(map(zlib.crc32, each), pa.int64())] if digest else [pa.array(each, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "start", *(("n_tokens", "ids_crc32") if digest else ("ids",))]
    kinds = "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary")
    return blocks.mapInArrow(run, kinds)


def write_documents(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    ids = common.hold(token_ids(docs, tokenizer, end_id))
    counts = {r[0]: r[1] for r in id_counts(ids).collect()}  # at most the vocabulary
    full = np.zeros(max(counts, default=0) + 1, dtype=np.int64)
    for i, n in counts.items():
        full[i] = n
    write_blocks(ids, code_lengths(full), path)


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "huffman")
    write_documents(common.table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path, digest=True)
