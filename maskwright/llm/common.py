"""Shared helpers of the training-data operators: tables, scratch space, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Bytes of text that one vectorised step works on; keeps a Python worker's arrays small.
STEP_BYTES = 500_000
#: Rows and bytes of an Arrow batch at most, where the session leaves Spark's own (larger) limits.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b"),
    "spark.sql.inMemoryColumnarStorage.batchSize": ("10000", "1000"),
}
#: Bytes that an item of a list counts in a step.
ITEM_BYTES = 200
#: Rows of a partition that small results are coalesced to, so that many shuffle partitions don't become many tiny files.
COMPACT = 5_000


def ship(spark: SparkSession) -> SparkSession:
    """The package on all executors, and batches of a bounded size."""
    for key, (usual, bound) in BATCH.items():
        try:
            if spark.conf.get(key).lower().removesuffix("b") == usual.removesuffix("b"):
                spark.conf.set(key, bound)
        except Exception:  # noqa: BLE001  this Spark has no such limit
            continue
    return session.ship(spark)


def trim() -> None:
    """Give freed memory of this worker back to the machine: the next stage's workers may need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    return session.shared_dir(spark)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


#: Written scratch tables of this process, oldest first; run() callers may release them early.
_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the process ends."""
    path = f"{shared_dir(spark)}/maskwright-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release_all)
    _written.append((spark, path))
    return path


def release_all() -> None:
    while _written:
        _remove(*_written.pop())


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark drop shuffle files that no table refers to any more: on a busy cluster that may otherwise wait for the driver's garbage collection.

    Twice, as what Python lets go reaches the JVM only with the next call."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and lost executors lose nothing.

    rows: about how many there are, where that is known; then few rows don't become many tiny files."""
    spark = df.sparkSession
    df = df if rows is None else compact(df, rows)
    path = scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """df computed once and kept on the executors' disks, for steps of one plan. Partitions that go with a lost executor are
    computed again from their lineage, which is short and the same each time. For tables straight from a source: behind
    shuffles, materialise() also lets Spark drop the shuffle files and keeps plans small."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df, whose number of rows is known about, in no more partitions than its rows are worth."""
    return df.coalesce(max(8, -(-rows // COMPACT)))


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text only, text null as empty; other columns, whatever their names, don't matter."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def steps(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = STEP_BYTES) -> Iterator[list[list]]:
    """Columns as Python lists, in slices of about `limit` bytes of the last column (a single longer value stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(batch.schema.get_field_index(columns[-1]))
        sizes = pc.multiply(pc.list_value_length(last), ITEM_BYTES) if pa.types.is_list(last.type) else pc.binary_length(last)
        width = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, w in enumerate(width.tolist()):
            if size and size + w > limit:
                yield [batch.column(batch.schema.get_field_index(c)).slice(start, i - start).to_pylist() for c in columns]
                start, size = i, 0
            size += w
        yield [batch.column(batch.schema.get_field_index(c)).slice(start).to_pylist() for c in columns]
    trim()
