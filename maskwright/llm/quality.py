"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise term
takes time linear in the features by the sum-of-squares identity. It is fitted on a bounded, documented sample of
labelled rows (SAMPLE of each class, by a hash of doc_id) and scores every whole text in one pass without a shuffle.

Defined results: null and empty texts score as texts without words; equal texts with equal n_chars score alike;
without labelled rows, or with one class of them only, the score is that class's share (0.5 without any);
labels that are null are no labels; an empty table gives no row; columns but doc_id, text and n_chars are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that the fit sees at most.
SAMPLE = 3000
BUCKETS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 1 << 13, 6, 6, 64, 0.1, 1e-5
#: A worker forgets its words' buckets beyond so many; it changes no score.
MEMORY = 150_000
STATISTICS = ("log length", "metadata length", "word length", "capitals", "digits", "marks", "bars", "bangs", "symbols", "unique words", "repeated lines", "line length", "top word")
SIZE = 2 * BUCKETS + len(STATISTICS)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


class _Words(dict):
    """word -> (bucket of the word, bucket of its shape)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        shape, last = [], ""
        for c in word[:24]:
            c = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if c != last:
                shape.append(c)
                last = c
        bare = "".join(filter(str.isalnum, word)).lower()
        self[word] = found = (zlib.crc32(bare.encode("utf-8", "replace")) % BUCKETS, BUCKETS + zlib.crc32("".join(shape).encode("utf-8", "replace")) % BUCKETS)
        return found


_words = _Words()


def forget() -> None:
    """At a task's end: the worker may serve other stages next."""
    _words.clear()
    common.trim()


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words and shapes (each half of length 1), then the statistics, not yet scaled."""
    if len(_words) > MEMORY:
        _words.clear()
    counts = Counter(text.split())
    total, n = sum(counts.values()), max(1, len(text))
    if counts:
        at = np.array([_words[w] for w in counts], dtype=np.int64)
        tf = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        sums = np.bincount(at.ravel(), weights=np.repeat(tf, 2))
        index = np.flatnonzero(sums)
        value = sums[index]
        half = np.searchsorted(index, BUCKETS)
        for part in (value[:half], value[half:]):
            part /= max(1e-9, float(np.sqrt((part * part).sum())))
    else:
        index, value = np.zeros(0, dtype=np.int64), np.zeros(0)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    lines = text.split("\n")
    stats = [
        np.log1p(len(text)), np.log1p(max(0, len(text) if n_chars is None else n_chars)), len(text) / max(1, total), raw[65:91].sum() / n, raw[48:58].sum() / n,
        (raw[44] + raw[46]) / n, raw[124] / n, raw[33] / n, raw[[35, 36, 37, 38, 42, 60, 61, 62, 64, 95]].sum() / n, len(counts) / max(1, total),
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), max(counts.values(), default=0) / max(1, total),
    ]
    return np.r_[index, 2 * BUCKETS + np.arange(len(stats))], np.r_[value, stats]


class Machine:
    """A fitted factorisation machine; plain arrays, so it travels with a task."""

    def __init__(self, share: float = 0.5):
        share = min(0.999, max(0.001, share))
        self.w0, self.w, self.v = float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, FACTORS))
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def scaled(self, value: np.ndarray) -> np.ndarray:
        value = value.copy()
        value[-len(STATISTICS) :] = np.clip((value[-len(STATISTICS) :] - self.mean) / self.scale, -4, 4) / 4
        return value

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        x = self.scaled(value)
        vx = self.v[index] * x[:, None]
        return float(self.w0 + self.w[index] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx * vx).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(index, value), -40, 40))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> Machine:
        """Logistic loss, AdaGrad over mini-batches in a fixed order."""
        stats = np.array([v[-len(STATISTICS) :] for _, v in rows])
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        rng = np.random.default_rng(7)
        self.v = rng.normal(0, 0.05, self.v.shape)
        gw, gv, g0 = np.full(SIZE, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        xs = [self.scaled(v) for _, v in rows]
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH].tolist()
                index, x = np.concatenate([rows[i][0] for i in some]), np.concatenate([xs[i] for i in some])
                size = [len(xs[i]) for i in some]
                starts = np.cumsum([0, *size[:-1]])
                vx = self.v[index] * x[:, None]
                sums = np.add.reduceat(vx, starts)
                out = self.w0 + np.add.reduceat(self.w[index] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                err = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - label[some]) / len(some)
                each = np.repeat(err, size)
                dw = np.bincount(index, weights=each * x, minlength=SIZE) + DECAY * self.w
                pull = each[:, None] * x[:, None] * (np.repeat(sums, size, axis=0) - vx)
                dv = np.stack([np.bincount(index, weights=pull[:, f], minlength=SIZE) for f in range(FACTORS)], axis=1) + DECAY * self.v
                gw += dw * dw
                gv += dv * dv
                g0 += err.sum() ** 2
                self.w -= RATE * dw / np.sqrt(gw)
                self.v -= RATE * 0.3 * dv / np.sqrt(gv)
                self.w0 -= RATE * err.sum() / np.sqrt(g0)
        return self


def _inputs(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_chars"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    common.ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(~is_held_out(F.col("doc_id")) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    shares = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return Machine(shares.get(1, 0) / total if total else 0.5)
    chosen = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, label int")  # at most 2 * SAMPLE rows

    def run(batches):
        for ids, label, n_chars, texts in common.steps(batches, "doc_id", "label", "n_chars", "text"):
            found = [features(t, n) for n, t in zip(n_chars, texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                names=["doc_id", "label", "index", "value"],
            )

    rows = _inputs(docs).join(F.broadcast(sample), "doc_id").mapInArrow(run, "doc_id long, label int, index binary, value binary").collect()
    if len({r["label"] for r in rows}) < 2:
        return Machine(shares.get(1, 0) / total)
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["index"]), bytes(r["value"])))
    pairs = [(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in rows]
    return Machine(shares.get(1, 0) / total).fit(pairs, np.array([r["label"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for ids, n_chars, texts in common.steps(batches, "doc_id", "n_chars", "text"):
            found = [machine.score(*features(t, n)) for n, t in zip(n_chars, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.float64())], names=["doc_id", "score"])
        forget()

    common.ship(docs.sparkSession)
    scored = _inputs(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs, all columns, that the machine does not reject."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            n_chars = batch.column(batch.schema.get_field_index("n_chars")).to_pylist() if "n_chars" in names else [None] * batch.num_rows
            good = [machine.score(*features(t.as_py() or "", n)) >= 0.5 for n, t in zip(n_chars, texts)]
            yield batch.filter(pa.array(good, pa.bool_()))
        forget()

    common.ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
