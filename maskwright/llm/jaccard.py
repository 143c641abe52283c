"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts with equal shingle sets are one class with its number of copies; the digest of the set names it, so doc_ids play
no part in what is linked. MinHash bands of the classes meet in buckets, whose least member stands for the bucket; a
class keeps one edge to the least of its buckets' and those buckets' edges are told once, so candidates are joined into
components by a number of edges linear in the classes, however large a bucket is. Each member of a component is
described by how its set differs from the component's first one, which for near copies is little. Pairs of a component are
compared block by block: MinHash values are compared STEP at a time and a pair is dropped once the posterior
probability of reaching the threshold, with a flat prior and so many agreements seen, is under `tolerance`; the rest is verified
exactly on the sets. A block returns each text's number of links and its root within the block, never its pairs.
Blocks hold about BLOCK texts or BLOCK_BYTES of differences, so a group that holds a third of all texts is many tasks of bounded size.

Defined results: null texts are empty; texts without words equal each other and nothing else; shorter texts than a
shingle have one shingle of all their words; rows with equal doc_id are separate rows with that id; class_id is the least doc_id
of the class's rows, null if none has one; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components
from .shingles import mix, shingle_sets

THRESHOLD, WIDTH = 0.8, 5
#: MinHash values: BANDS bands of ROWS. A pair at the threshold misses all bands with probability (1 - 0.8 ** 4) ** 24 < 4e-6.
BANDS, ROWS = 24, 4
STEP, TOLERANCE = 16, 1e-6
BLOCK, BLOCK_BYTES = 2048, 4_000_000
#: Pairs that are compared at once.
PAIRS = 1 << 17
#: A row without a doc_id comes after all others.
LAST = (1 << 63) - 1


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS * ROWS 32-bit values for each set (0 for empty sets)."""
    out = np.zeros((len(sets), BANDS * ROWS), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joint = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k, (a, b) in enumerate(zip(*_permutations())):
            out[full, k] = np.minimum.reduceat(((joint * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


@cache
def least_agreements(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After STEP, 2 * STEP, ... values: the fewest agreements with P(similarity >= threshold | agreements) >= tolerance.

    With a flat prior that probability is P(Binomial(n + 1, threshold) <= agreements)."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, version (tells texts of one doc_id apart), digest of the shingle set, n (its size), sig (MinHash values)."""

    def run(batches):
        for ids, versions, texts in common.steps(batches, "doc_id", "version", "text"):
            sets = shingle_sets(texts, width)
            sig = minhash(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(versions, pa.int32()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "version", "digest", "n", "sig"],
            )

    rows = common.doc_columns(docs).select("doc_id", F.hash("text").alias("version"), "text")
    return rows.mapInArrow(run, "doc_id long, version int, digest binary, n long, sig binary")


class Block:
    """Members of a component in arrays: MinHash values, set sizes, and differences from the component's first set.

    With base elements in that set, a of them missing from A and b from B, |A and B| = base - a - b + |differences in common|."""

    def __init__(self, sigs: list[bytes], base: int, sizes: list[int], missing: list[int], differences: list[bytes]):
        self.sig = np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(sigs), -1)
        self.base, self.size, self.missing = base, np.asarray(sizes), np.asarray(missing)
        n = [len(d) // 8 for d in differences]
        _, self.ids = np.unique(np.frombuffer(b"".join(differences), dtype=np.uint64), return_inverse=True)
        self.stop = np.cumsum(n)
        self.start = self.stop - n

    def links(self, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that reach the threshold: pruned by Bayes, then verified exactly."""
        agreements = np.zeros(len(left), dtype=np.int64)
        for at, least in zip(range(0, self.sig.shape[1], STEP), least_agreements(threshold, tolerance)):
            agreements += (self.sig[left, at : at + STEP] == self.sig[right, at : at + STEP]).sum(axis=1)
            keep = agreements >= least
            left, right, agreements = left[keep], right[keep], agreements[keep]
        a, b = self.size[left], self.size[right]
        fits = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
        left, right = left[fits], right[fits]
        found = np.zeros(len(left), dtype=bool)
        seen = np.zeros(len(self.ids) + 1, dtype=bool)
        order = np.argsort(left, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(left[order])) + 1) if len(order) else ():
            own = int(left[some[0]])
            mine = self.ids[self.start[own] : self.stop[own]]
            seen[mine] = True
            others = right[some]
            n = self.stop[others] - self.start[others]
            ends = np.cumsum(n)
            flat = np.repeat(self.start[others] - (ends - n), n) + np.arange(int(ends[-1]))
            hits = np.concatenate([[0], np.cumsum(seen[self.ids[flat]])])
            both = self.base - self.missing[own] - self.missing[others] + hits[ends] - hits[ends - n]
            found[some] = both >= threshold * (self.size[own] + self.size[others] - both) - 1e-9
            seen[mine] = False
        return left[found], right[found]


def _compare(nodes: list[bytes], copies: list[int], blocks: list[int], block: Block, threshold: float, tolerance: float):
    """Links of one pair of blocks (or of one block with itself): each node's root, the least it is joined with, and number of links. nodes ascend."""
    home, weight = np.asarray(blocks), np.asarray(copies)
    links, root = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    first = np.flatnonzero(home == home.min())
    alone = len(first) == len(nodes)
    second = first if alone else np.flatnonzero(home != home.min())
    step = max(1, PAIRS // len(second))
    for at in range(0, len(first), step):
        some = first[at : at + step]
        left, right = np.repeat(some, len(second)), np.tile(second, len(some))
        if alone:
            left, right = left[left < right], right[left < right]
        left, right = block.links(left, right, threshold, tolerance)
        links += np.bincount(left, weights=weight[right], minlength=len(nodes)).astype(np.int64) + np.bincount(right, weights=weight[left], minlength=len(nodes)).astype(np.int64)
        for group in np.split(np.arange(len(left)), np.flatnonzero(np.diff(left)) + 1) if len(left) else ():
            own, met = root[left[group[0]]], root[right[group]]
            if (met != own).any():
                met = np.unique(np.append(met, own))
                root[np.isin(root, met)] = met[0]
    return [nodes[r] for r in root.tolist()], links.tolist()


def _grouped(batches):
    """Runs of equal (component, i, j) in sorted rows, across batches; a node once."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:3] != row[:3]:
                yield held
                held = []
            if not held or held[-1][3] != row[3]:  # rows that are alike bring a class's text twice
                held.append(row)
    if held:
        yield held


def contracted(told: DataFrame, node: str, others: str) -> DataFrame:
    """a, b: edges that join what node - each of `others` (an array) join: one for each node, to the least, and between the others each once."""
    least = F.array_min(F.array_append(others, F.col(node)))
    one = told.select(F.col(node).alias("a"), least.alias("b"))
    rest = told.select(least.alias("a"), others).distinct().select("a", F.explode(others).alias("b")).distinct()
    return one.unionByName(rest).filter("a <> b")


def differing(members: DataFrame, width: int) -> DataFrame:
    """component, node, copies, sig, base, size, missing, differences of rows that also have text and first (the text of the component's first member)."""

    def run(batches):
        last, base = None, None
        for batch in batches:
            for rows in common.steps([batch], "component", "node", "copies", "sig", "first", "text"):
                component, nodes, copies, sigs, firsts, texts = rows
                cols = [[], [], [], []]
                for c, first, own in zip(component, firsts, shingle_sets(texts, width)):
                    if c != last:
                        last, base = c, shingle_sets([first], width)[0]
                    gone, new = np.setdiff1d(base, own, assume_unique=True), np.setdiff1d(own, base, assume_unique=True)
                    for col, v in zip(cols, (len(base), len(own), len(gone), np.sort(np.concatenate([gone, mix(~new)])).tobytes())):
                        col.append(v)
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((component, nodes, copies, sigs, *cols), kinds)], names=["component", "node", "copies", "sig", "base", "size", "missing", "differences"])

    chosen = members.select("component", "node", "copies", "sig", "first", "text")
    return chosen.mapInArrow(run, "component binary, node binary, copies long, sig binary, base long, size long, missing long, differences binary")


def linked(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, version, digest), and classes (digest, component, copies, links, key: least (doc_id, version) of its rows)."""
    signed = common.hold(signatures(docs, width))
    n = signed.count()
    key = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "version")
    classes = signed.groupBy("digest").agg(F.min(key).alias("key"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = common.materialise(classes, "classes", n)
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    buckets = classes.filter("n > 0").select("digest", F.explode(bands).alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("digest").alias("leader"), F.count("*").alias("members")).filter("members > 1").drop("members")
    # A class has at most BANDS leaders.
    stars = common.materialise(buckets.join(leaders, "bucket").groupBy("digest").agg(F.collect_set("leader").alias("leaders")), "stars", n)
    common.drop_shuffles(docs.sparkSession)
    found = components(contracted(stars, "digest", "leaders"), "a", "b", n).withColumnRenamed("node", "digest")

    rows = common.doc_columns(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.hash("text").alias("version"), "text")
    members = found.join(classes, "digest").select("component", F.col("digest").alias("node"), "copies", "sig", "key.doc", "key.version")
    members = members.join(rows, ["doc", "version"]).select("component", "node", "copies", "sig", "text")
    firsts = found.filter("digest = component").join(classes, "digest").select("component", "key.doc", "key.version")
    firsts = firsts.join(rows, ["doc", "version"]).select("component", F.col("text").alias("first")).dropDuplicates(["component"])
    told = common.materialise(differing(members.join(firsts, "component"), width), "differences", n)
    common.drop_shuffles(docs.sparkSession)

    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("differences")) / BLOCK_BYTES)).cast("int")
    placed = told.join(told.groupBy("component").agg(blocks.alias("n_blocks")), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "sig", "base", "size", "missing", "differences")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def run(batches):
        for group in _grouped(batches):
            nodes, copies, homes, sigs, base, sizes, missing, differences = (list(c) for c in list(zip(*group))[3:])
            roots, links = _compare(nodes, copies, homes, Block(sigs, base[0], sizes, missing, differences), threshold, tolerance)
            some = [k for k, n in enumerate(links) if n]
            cols = [pa.array([nodes[k] for k in some], pa.binary()), pa.array([roots[k] for k in some], pa.binary()), pa.array([links[k] for k in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "root", "links"])
        common.trim()

    verified = dealt.mapInArrow(run, "node binary, root binary, links long")
    # A node has one root for each block of its component.
    verified = common.materialise(verified.groupBy("node").agg(F.collect_set("root").alias("roots"), F.sum("links").alias("links")), "links", n)
    joined = components(contracted(verified, "node", "roots"), "a", "b", n)
    out = classes.select("digest", "key", "copies").join(verified.select(F.col("node").alias("digest"), "links"), "digest", "left")
    out = out.join(joined.withColumnRenamed("node", "digest"), "digest", "left")
    out = out.select("digest", F.coalesce("component", "digest").alias("component"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "key")
    return signed.select("doc_id", "version", "digest"), common.materialise(out, "linked", n)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id (least doc_id among all it is linked with, directly or over others), n_links (rows with
    similarity >= threshold, copies included), n_copies (rows with the same shingles)."""
    rows, classes = linked(docs, threshold, width, tolerance)
    ids = classes.groupBy("component").agg(F.min("key.doc").alias("class_id"))
    told = classes.join(ids, "component").select("digest", F.nullif("class_id", F.lit(LAST)).alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return common.compact(rows.join(told, "digest").select("doc_id", "class_id", "n_links", "n_copies"), rows.count())


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each class the row with the least doc_id (then hash of the text; rows without a doc_id come last), all columns; of repeated rows one."""
    rows, classes = linked(docs)
    first = classes.groupBy("component").agg(F.min("key").alias("k")).select(F.col("k.doc").alias("first_doc_"), F.col("k.version").alias("first_version_"))
    own = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("first_doc_"), F.col("version").alias("first_version_")).join(first, ["first_doc_", "first_version_"], "left_semi")
    again = common.materialise(own.groupBy("first_doc_", "first_version_").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again", 0)
    doc, version = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.hash(F.coalesce(F.col("text"), F.lit("")))
    same = (doc == F.col("first_doc_")) & (version == F.col("first_version_"))
    kept = docs.join(first, same, "left_semi")
    if not again.limit(1).count():
        return kept
    return kept.join(again, same, "left_anti").union(docs.join(again, same, "left_semi").withColumn("first_version_", version).dropDuplicates(["doc_id", "first_version_"]).drop("first_version_"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(common.table(spark, sf_dir, "documents"))
