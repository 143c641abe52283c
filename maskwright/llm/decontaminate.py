"""Benchmark decontamination by spaced seeds. Native.

Texts become arrays of word hashes (lower case, runs of letters and digits). Each fixed mask picks the word
positions that count within a window and ignores the rest; hashes of the picked words are joined with those of the
test items. Around every hit the item is laid over the text and agreeing words are noted in place. Where NEAR of
SPAN neighbouring words agree, they form a stretch; an item's stretches are added up over all its places in a text, so
that parts, insertions and cuts don't hide an overlap. It counts when at least `least` of the item's words agree in
one place or in stretches, or when stretches hold ENOUGH words. Every pattern of substitutions of up to a quarter of
an item's words (of eight words or more) leaves a hit; beyond, a pattern may leave none.

Hits are verified where they are found, in the map task: only sums for (text, item) are shuffled, so a
passage that a third of all documents hold is no single task's work. The item side is broadcast after its size is
checked; beyond SEED_BOUND rows, hits come from a shuffled join and are verified against the texts by a key of id and text.

Defined results: null and empty texts and items have no words and match nothing; items shorter than a mask use
one mask of their own length without gaps; equal items are all reported; repeated rows of a document report
the larger overlap once; rows without a doc_id are reported together under null, and `clean` judges every row by its own text; items without an
item_id are reported together under null; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed masks: 1 counts, 0 is ignored.
MASKS = ("1111", "11101", "11011", "1010101")
#: Seed rows that are broadcast at most (24 bytes each).
SEED_BOUND = 500_000
LEAST = 0.5
#: Words: a stretch has NEAR agreeing ones within SPAN; ENOUGH in stretches are an overlap, however long the item is.
NEAR, SPAN, ENOUGH = 6, 8, 13


def words(text: Column) -> Column:
    """Hashes of the text's words in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def closing(mask: str) -> tuple[tuple[int, ...], ...]:
    """Which places besides the mask's own would have to agree for another hit on the same diagonal: the word before a mask
    without gaps (its run then starts earlier), or ignored words that make a run of the first mask's length."""
    if "0" not in mask:
        return ((-1,),)
    run, gaps = len(MASKS[0]), [k for k, c in enumerate(mask) if c == "0"]
    found = {tuple(k for k in gaps if at <= k < at + run) for at in range(len(mask) - run + 1)}
    return tuple(sorted(f for f in found if not any(set(g) < set(f) for g in found)))


def seeds(rows: DataFrame, h: str, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """keep, at, h, seed, beside: a row for each window and mask, with the words of the places that `closing` names.

    Each place's words become plain columns first, which keeps hashing and the join after it in one generated loop."""
    shortest, span = min(map(len, masks)), max(map(len, masks))
    placed = rows.filter(F.size(h) >= shortest).select(*keep, h, F.explode(F.sequence(F.lit(0), F.size(h) - shortest)).alias("at"))
    spread = placed.select(*keep, h, "at", *[F.get(F.col(h), F.col("at") + k).alias(f"w{k}") for k in range(-1, span)])
    kinds = []
    for i, mask in enumerate(masks):
        picked = [F.col(f"w{k}") for k, c in enumerate(mask) if c == "1"]
        beside = sorted({k for some in closing(mask) for k in some})
        # Of one place beside, the second is alike on both sides: the drop rule then asks for the first alone.
        beside_ = [F.col(f"w{k}") for k in beside] if len(beside) == 3 else [F.col(f"w{beside[0]}"), F.lit(0).cast("long"), F.lit(None).cast("long")]
        kinds.append(F.struct(F.when(picked[-1].isNotNull(), F.xxhash64(F.lit(i), *picked)).alias("seed"), *[b.alias(f"b{n}") for n, b in enumerate(beside_)]))
    each = spread.select(*keep, "at", h, F.inline(F.array(*kinds)))
    return each.filter(F.col("seed").isNotNull())


def redundant() -> Column:
    """Whether a hit is implied by another one on its diagonal: (b0 and b1) or (b1 and b2) agree."""
    same = [F.coalesce(F.col(f"b{n}") == F.col(f"item_b{n}"), F.lit(False)) for n in range(3)]
    return (same[0] & same[1]) | (same[1] & same[2])


def agreeing(doc: str, item: str, diagonal: Column) -> Column:
    """Which words of the item agree in place when it starts at word `diagonal` of the text."""
    first, last = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(doc) - diagonal) - 1
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda k: F.get(F.col(doc), diagonal + k) == F.get(F.col(item), k))


def stretches(places: str) -> Column:
    """Those of the agreeing words that have NEAR - 1 others with them within SPAN words."""
    dense = lambda i: F.coalesce(F.get(F.col(places), i + NEAR - 1) - F.get(F.col(places), i) < SPAN, F.lit(False))
    return F.filter(F.col(places), lambda k, j: F.exists(F.sequence(F.greatest(j - NEAR + 1, F.lit(0)), j), dense))


def _key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart whose doc_id is shared or null."""
    return F.xxhash64(doc_id.cast("long"), text)


def rated(docs: DataFrame, items: DataFrame, least: float = LEAST, bound: int = SEED_BOUND) -> DataFrame:
    """doc_id, doc_key, item_id, b (n_agreeing, back: words before the text's start, n: the item's words) of every row that overlaps."""
    common.shared_dir(docs.sparkSession)
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item")).filter(F.size("item") > 0)
    tests = common.hold(tests.distinct().withColumn("item_key", F.xxhash64("item_id", "item")))
    span = min(map(len, MASKS))
    short = [r[0] for r in tests.filter(F.size("item") < span).select(F.size("item")).distinct().collect()]  # at most span - 1 rows
    masks = (*MASKS, *("1" * n for n in sorted(short)))
    probes = reduce(
        DataFrame.unionByName,
        [seeds(tests.filter(F.size("item") >= span), "item", MASKS, "item_key"), *(seeds(tests.filter(F.size("item") == n), "item", ("1" * n,), "item_key") for n in short)],
    )
    probes = common.hold(probes.select("seed", "item_key", F.col("at").alias("item_at"), *[F.col(f"b{n}").alias(f"item_b{n}") for n in range(3)]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("doc"), _key(F.col("doc_id"), F.col("text")).alias("doc_key"))
    if probes.count() <= bound:
        found = seeds(texts, "doc", masks, "doc_id", "doc_key").join(F.broadcast(probes), "seed").filter(~redundant())
        hits = found.join(F.broadcast(tests), "item_key")
    else:
        found = seeds(texts, "doc", masks, "doc_key").drop("doc").join(probes, "seed").filter(~redundant())
        found = found.select("doc_key", "item_key", "at", "item_at").withColumn("at", F.col("at") - F.col("item_at")).withColumn("item_at", F.lit(0)).distinct()
        hits = found.join(tests, "item_key").join(texts, "doc_key")
    start = F.col("at") - F.col("item_at")
    placed = hits.select("doc_id", "doc_key", "item_id", "item_key", start.alias("start"), F.size("item").alias("n"), agreeing("doc", "item", start).alias("places"))
    placed = placed.filter(F.size("places") >= F.least(F.lit(NEAR), F.lit(least) * F.col("n")))
    checked = placed.select("doc_id", "doc_key", "item_id", "item_key", "start", "n", F.size("places").alias("n_agreeing"), stretches("places").alias("part"))
    checked = checked.filter((F.size("part") > 0) | (F.col("n_agreeing") >= F.lit(least) * F.col("n")))
    summed = checked.groupBy("doc_id", "doc_key", "item_id", "item_key").agg(
        F.max(F.struct("n_agreeing", -F.col("start"), "n")).alias("b"), F.size(F.array_distinct(F.flatten(F.collect_set("part")))).alias("n_parts")
    )
    strong = summed.filter((F.greatest("b.n_agreeing", "n_parts") >= F.lit(least) * F.col("b.n")) | (F.col("n_parts") >= ENOUGH))
    return strong.select("doc_id", "doc_key", "item_id", F.struct(F.greatest("b.n_agreeing", "n_parts").alias("n_agreeing"), F.col("b.col2").alias("back"), F.col("b.n").alias("n")).alias("b"))


def overlaps(docs: DataFrame, items: DataFrame, least: float = LEAST, bound: int = SEED_BOUND) -> DataFrame:
    """doc_id, item_id, n_agreeing, overlap, start (word position of the item's first word in the text where most agree, may be negative)."""
    best = rated(docs, items, least, bound).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_agreeing").alias("n_agreeing"), (F.col("b.n_agreeing") / F.col("b.n")).alias("overlap"), (-F.col("b.back")).alias("start"))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, that overlap with no item."""
    hit = rated(docs, items, least).select(F.col("doc_key").alias("hit_key_")).distinct()
    return docs.join(hit, _key(F.col("doc_id"), F.col("text")) == F.col("hit_key_"), "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
