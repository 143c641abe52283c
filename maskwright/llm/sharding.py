"""Minimax contiguous partition of atomic groups (equal texts) into shards of near-equal bytes. Native.

Groups are ordered by their text's digest. The smallest capacity for which a greedy cut needs no more than
`shards` runs is found by binary search; each greedy check only asks for the last group whose running total
is within reach. Running totals come from a bounded summary - totals by digest prefix - refined with
exact groups only in the few prefixes where a cut may fall. A document's shard then follows from comparing its
own digest with the cuts: no join, and a third of all rows in one group stays spread over tasks.

Defined results: a null text has size 1 and the crc32 and group of the empty text; repeated rows share their
group's shard and have slots of their own; fewer groups than shards leave shards empty; an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LAW = "bytes"


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(text, 256).alias("group"),
    )


class RunningTotals:
    """next(x): the largest running total <= x, with the group it ends at, from prefix totals refined on demand."""

    def __init__(self, totals: dict[int, int], fetch):
        self.keys = sorted(totals)
        self.ends, run = [], 0
        for k in self.keys:
            run += totals[k]
            self.ends.append(run)
        self.total, self.fetch, self.inside, self.wanted = run, fetch, {}, set()

    def refine(self) -> bool:
        """Fetches the prefixes that were asked for and aren't known; False if there were none."""
        todo, self.wanted = self.wanted, set()
        if not todo:
            return False
        found: dict[int, list[tuple[str, int]]] = {k: [] for k in todo}
        for k, group, size in self.fetch(sorted(todo)):
            found[k].append((group, size))
        for k, groups in found.items():
            run, ends, names = self.before(k), [], []
            for group, size in sorted(groups):
                run += size
                ends.append(run)
                names.append(group)
            self.inside[k] = (ends, names)
        return True

    def before(self, k: int) -> int:
        i = bisect_left(self.keys, k)
        return self.ends[i - 1] if i else 0

    def next(self, x: int) -> int:
        i = bisect_right(self.ends, x)
        if i == len(self.keys):
            return self.total
        k, low = self.keys[i], self.ends[i - 1] if i else 0
        if k not in self.inside:
            self.wanted.add(k)
            return low
        ends = self.inside[k][0]
        j = bisect_right(ends, x)
        return ends[j - 1] if j else low

    def last_group(self, end: int) -> str | None:
        """The group at which a running total known to next() ends; None if that is a prefix's own end."""
        i = bisect_left(self.ends, end)
        ends, names = self.inside.get(self.keys[i], ([], []))
        return names[bisect_left(ends, end)] if end in ends else None


def minimax(index: RunningTotals, shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the greedy cuts (running totals) for it."""

    def cuts(capacity: int) -> list[int] | None:
        at, out = 0, []
        while at < index.total:
            if len(out) == shards or (to := index.next(at + capacity)) <= at and index.total:
                return None
            out.append(at := to)
        return out

    low, high = max(largest, -(-index.total // shards)), index.total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if cuts(mid) is not None else (mid + 1, high)
    return low, cuts(low) or []


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = common.hold(keyed(docs).withColumn("row", F.monotonically_increasing_id()))
    groups = common.hold(rows.groupBy("group").agg(F.sum("size").alias("size")))
    n, largest = groups.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    digits = 1
    while digits < 5 and n > 500 * 16**digits:
        digits += 1
    prefix: Column = F.conv(F.substring("group", 1, digits), 16, 10).cast("long")
    totals = {r[0]: r[1] for r in groups.groupBy(prefix.alias("p")).agg(F.sum("size")).collect()}  # at most 16 ** digits rows

    def fetch(keys):
        return groups.select(prefix.alias("p"), "group", "size").filter(F.col("p").isin(keys)).collect()

    index = RunningTotals(totals, fetch)
    capacity, ends = minimax(index, shards, largest)
    # Unrefined lookups answer too low, so the first capacity is an upper bound; only prefixes near its cuts can matter.
    while index.refine():
        capacity, ends = minimax(index, shards, largest)
    at: Column = F.lit(0)
    for end in ends[:-1]:
        group = index.last_group(end)
        if group is None:  # the cut is where a prefix ends: all its groups are on this side
            k = index.keys[bisect_left(index.ends, end)]
            group = f"{k:0{digits}x}" + "f" * (64 - digits)
        at = at + F.when(F.col("group") > F.lit(group), 1).otherwise(0)
    placed = rows.withColumn("shard", at.cast("int"))
    buckets = max(16, n // 50_000)
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row"))
    return dealt.join(counts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("base") + within - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
