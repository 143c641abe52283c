"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts, normalised by length, with exception phrases.

Folding makes one writing of many: case, homoglyphs of other scripts, styled and full-width letters, stray marks, digits
and signs for letters, and invisible characters. l, 1 and i are one letter, so both readings of 1 match; letters with accents stay, as they tell
words apart in many languages; what is no letter parts words. The lexicon's entries are word beginnings of SHORTEST to LONGEST letters or whole words that toxic training texts have far more often among their words (a
likelihood ratio), each with its log ratio as weight; of a chain of beginnings the most telling one stays. Exception phrases are two-word phrases
around an entry that are mostly found in clean texts, and any that the caller gives: a match within one does not count. A text's matches give its
weight in all, by a thousand words, its distinct and its heaviest entries; a logistic fit turns them into a score.

Entries are learned on at most SAMPLE labelled texts of each class, chosen by a hash of doc_id; of near copies among them (by the least hash of
their three-word runs) one counts. Every text is scored whole, in one pass without a shuffle.

Defined results: null and empty texts score as texts without a match; equal texts score alike; without labelled rows, or with one class of
them only, the score is that class's share (0.5 without any); labels that are null are no labels; an empty table gives no row; columns but doc_id and
text are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled texts of each class that the lexicon and the fit see at most.
SAMPLE = 3000
#: Letters of a word beginning; the likelihood ratio, the toxic texts and the log ratio that an entry has at least.
SHORTEST, LONGEST, LEAST_RATIO, LEAST_TEXTS, LEAST_WEIGHT = 3, 8, 25.0, 4, 1.5
#: Clean texts that have an exception phrase at least, and times the texts of its toxic share.
EXCEPTION_TEXTS, EXCEPTION_TIMES = 3, 2.0
#: Added to each count, so that no weight is infinite; occurrences in one text that count at most while weights are learned.
SMOOTH, MOST = 0.5, 5
# Letters that look like Latin ones, and signs that stand for letters.
_ALIKE = dict(pair.split("=") for pair in "а=a в=b е=e к=k м=m н=h о=o р=p с=c т=t у=y х=x і=i ј=j ѕ=s ԁ=d һ=h ӏ=l ԛ=q ԝ=w ɡ=g ɑ=a ı=i α=a β=b ε=e ι=i κ=k ν=v ο=o ρ=p τ=t υ=u χ=x ω=w".split())
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
_LONE_SIGN = re.compile(r"(?<![^\W_])[@$]+|[@$]+(?![^\W_])")
NAMES = ("weight", "weight by length", "distinct entries", "heaviest entry")


class _Fold(dict):
    """A character's folded form, found when it is first met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c).lower()
        if unicodedata.category(c) in ("Cf", "Mn", "Me"):
            folded = ""
        elif plain[0] in _SIGNS or plain[0] in _ALIKE or plain[0].isalpha():
            folded = "".join(_SIGNS.get(x := _ALIKE.get(y, y), x) for y in plain if y in _SIGNS or y.isalpha())
        else:
            folded = " "
        if len(self) < 200_000:
            self[code] = folded
        return folded


_folds = _Fold()


def fold(text: str) -> str:
    """Folded words with one blank before, between and behind them."""
    text = unicodedata.normalize("NFC", text)
    if "$" in text or "@" in text:
        text = _LONE_SIGN.sub(" ", text)
    return f" {' '.join(text.translate(_folds).split())} "


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def beginnings(words: list[str]) -> dict[str, int]:
    """Entries that a text could have - each word with blanks around it, and its beginnings - and how often, MOST at most."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[f" {w} "] += n
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out[f" {w[:k]}"] += n
    return {e: min(n, MOST) for e, n in out.items()}


def signature(folded: str) -> int:
    """The least hash of its three-word runs: near copies mostly share it, other texts don't."""
    words = folded.split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))), default=0)


def ratio(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Twice the log likelihood ratio of the counts against equal shares."""
    share = (toxic + clean) / (all_toxic + all_clean)
    term = lambda k, n: sum(x * math.log(x / e) for x, e in ((k, n * share), (n - k, n * (1 - share))) if x > 0)
    return 2 * (term(toxic, all_toxic) + term(clean, all_clean))


def weight(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    return math.log((toxic + SMOOTH) / (all_toxic + 2 * SMOOTH)) - math.log((clean + SMOOTH) / (all_clean + 2 * SMOOTH))


def most_telling(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """entry -> weight, from entry -> (ratio, weight): those with no better beginning of theirs, nor a longer form at least as good."""
    beaten = set()
    for entry, (own, _) in found.items():
        for k in range(SHORTEST + 1, len(entry)):
            if (short := entry[:k]) in found:
                beaten.add(entry if found[short][0] > own else short)
    return {e: w for e, (_, w) in found.items() if e not in beaten}


class Lexicon:
    """Weighted entries and exception phrases as one automaton; travels as plain dicts and is built once a worker."""

    def __init__(self, entries: dict[str, float], exceptions: Iterable[str] = ()):
        self.entries, self.exceptions, self._automaton = entries, sorted(set(exceptions)), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, w in self.entries.items():
                self._automaton.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, str, float]]:
        """Place, entry and weight of each word's longest entry, but of those within an exception phrase."""
        if not self.entries:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(folded):
            start = end + 1 - size
            if w is None:
                spared.append((start, end + 1))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, w)
        for start in [s for s, (n, _) in best.items() if any(a <= s and s + n <= b for a, b in spared)] if spared else ():
            del best[start]
        return [(s, folded[s : s + n], w) for s, (n, w) in sorted(best.items())]

    def statistics(self, folded: str, found: list[tuple[int, str, float]]) -> list[float]:
        """NAMES of a text with such matches."""
        total = sum(w for _, _, w in found)
        return [math.log1p(total), math.log1p(1000 * total / folded.count(" ")), math.log1p(len({e for _, e, _ in found})), max((w for _, _, w in found), default=0.0)]


class Model:
    """A lexicon and the logistic fit over its statistics."""

    def __init__(self, share: float, lexicon: Lexicon | None = None, beta: np.ndarray | None = None):
        share = min(0.999, max(0.001, share))
        self.lexicon = lexicon or Lexicon({})
        self.beta = np.r_[math.log(share / (1 - share)), np.zeros(len(NAMES))] if beta is None else beta

    def judge(self, text: str) -> tuple[float, list[str]]:
        """The score, and the entries that counted, in text order."""
        folded = fold(text)
        found = self.lexicon.matches(folded)
        z = self.beta @ np.array([1.0, *self.lexicon.statistics(folded, found)])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40)))), list(dict.fromkeys(e.strip() for _, e, _ in found))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Intercept and coefficients by Newton steps, with a light ridge; w: each row's weight."""
    x, ridge = np.c_[np.ones(len(x)), x], np.diag([1e-6, *[0.5] * x.shape[1]])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _counted(sample: DataFrame, name: str, of) -> DataFrame:
    """name, toxic, clean, texts: how often each class has a key that `of` counts in a folded text, and the toxic texts with it; summed within each step before the shuffle."""

    def run(batches):
        for labels, texts in common.steps(batches, "label", "text"):
            counts, toxic_texts = (Counter(), Counter()), Counter()
            for label, text in zip(labels, texts):
                found = of(text)
                counts[label].update(found)
                if label:
                    toxic_texts.update(found.keys())
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0], toxic_texts))], names=[name, "toxic", "clean", "texts"])

    kinds = f"{name} string, toxic long, clean long, texts long"
    return sample.mapInArrow(run, kinds).groupBy(name).agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "texts")])


def phrases(lexicon: Lexicon, folded: str) -> dict[str, int]:
    """Two-word phrases around the entries of a text, once each."""
    out = {}
    for at, _, _ in lexicon.matches(folded):
        end = folded.index(" ", at + 1)
        if at:
            out[folded[folded.rindex(" ", 0, at) : end + 1]] = 1
        if end + 1 < len(folded):
            out[folded[at : folded.index(" ", end + 1) + 1]] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = ()) -> Model:
    """exceptions: phrases, as they are written, within which no entry counts."""
    spark = common.ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter(~is_held_out(F.col("doc_id")) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    shares = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    given = [f" {f} " for f in (fold(p).strip() for p in exceptions) if f]
    if len(shares) < 2:
        return Model(share)
    chosen = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = spark.createDataFrame(chosen.collect(), "doc_id long, label int")  # at most 2 * SAMPLE rows

    def folded(batches):
        for ids, label, texts in common.steps(batches, "doc_id", "label", "text"):
            texts = [fold(t) for t in texts]
            cols = [pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array([signature(t) for t in texts], pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "signature", "text"])

    rows = common.doc_columns(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(folded, "doc_id long, label int, signature long, text string")
    rows = common.materialise(rows, "labelled")
    first = rows.groupBy("label", "signature").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("version"))).alias("first"))
    sample = rows.join(F.broadcast(first), ["label", "signature"]).filter((F.col("doc_id") == F.col("first.doc_id")) & (F.xxhash64("text") == F.col("first.version")))
    sample = common.materialise(sample.select("label", "text"), "distinct-labelled", 2 * SAMPLE)
    counts, words = {}, {}
    for label, counts[label], words[label] in sample.groupBy("label").agg(F.count("*"), F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit(""))))).collect():
        pass
    if len(counts) < 2:
        return Model(share)
    entries = _counted(sample, "entry", lambda t: beginnings(t.split())).filter(F.col("texts") >= LEAST_TEXTS)
    found = {}
    for r in entries.filter(F.col("toxic") * words[0] > F.col("clean") * words[1] * 2).collect():  # what has LEAST_WEIGHT is among these
        own, w = (f(r["toxic"], r["clean"], words[1], words[0]) for f in (ratio, weight))
        if own >= LEAST_RATIO and w >= LEAST_WEIGHT:
            found[r["entry"]] = (own, w)
    bare = Lexicon(most_telling(found))
    near = _counted(sample, "phrase", lambda t: phrases(bare, t)).filter((F.col("clean") >= EXCEPTION_TEXTS) & (F.col("clean") * counts[1] >= EXCEPTION_TIMES * F.col("toxic") * counts[0]))
    lexicon = Lexicon(bare.entries, [*given, *(r["phrase"] for r in near.collect())])

    def measured(batches):
        for label, texts in common.steps(batches, "label", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([lexicon.statistics(t, lexicon.matches(t)) for t in texts], pa.list_(pa.float64()))], names=["label", "x"])

    measures = sorted((r["label"], list(r["x"])) for r in sample.mapInArrow(measured, "label int, x array<double>").collect())
    y, x = np.array([m[0] for m in measures], dtype=np.float64), np.array([m[1] for m in measures])
    times = {k: len(y) * (share if k else 1 - share) / counts[k] for k in counts}  # the classes' shares among all labelled rows
    return Model(share, lexicon, logistic(x, y, np.where(y > 0, times[1], times[0])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, terms (the entries that counted, folded, in text order)."""

    def run(batches):
        for ids, texts in common.steps(batches, "doc_id", "text"):
            found = [model.judge(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.string()))], names=["doc_id", "score", "terms"])

    scored = common.doc_columns(docs).mapInArrow(run, "doc_id long, score double, terms array<string>")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "terms")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels"))).drop("terms")
