"""Text detectors: the rule table, native hits with offsets, and the joint scan with overlap resolution."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checksums as C
from ..functions.text import EDGE, bounded, entropy


@dataclass(frozen=True)
class Rule:
    """`pattern` uses EDGE for boundaries; `gate` decides on a match (None: always), `p` is its probability."""

    name: str
    cls: str
    pattern: str
    p: float
    gate: Callable[[Column], Column] | None = None
    score: Callable[[Column], Column] | None = None
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


def _card(m: Column) -> Column:
    return F.length(C.digits(m)).between(13, 19) & C.luhn(m)


#: Shapes and probabilities of the text rules, in order.
RULES = (
    Rule("email", "email", bounded(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0.97),
    Rule("upi", "upi", bounded(r"[a-zA-Z0-9._-]{3,}@(?:okhdfcbank|okicici|oksbi|okaxis|paytm|ybl|ibl|axl|upi|apl)"), 0.95),
    Rule("aadhaar", "aadhaar", bounded(r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}"), 0.96, C.verhoeff),
    Rule("pan", "pan", bounded("[A-Z]{5}[0-9]{4}[A-Z]"), 0.95, C.pan_valid),
    Rule("ifsc", "ifsc", bounded("[A-Z]{4}0[A-Z0-9]{6}"), 0.90, C.ifsc_valid),
    Rule("card", "card", bounded("(?:[0-9][ -]?){12,19}"), 0.94, _card),
    Rule("phone", "phone", r"(?:\+?91[\s-]?)?" + bounded("[6-9][0-9]{9}") + r"|\+[0-9]{1,3}[\s-]?[0-9]{6,12}" + EDGE, 0.72, None, lambda m: F.when(C.indian_mobile(m), 0.72).otherwise(0.55)),
    Rule("dob", "dob", bounded(r"(?:0?[1-9]|[12][0-9]|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)[0-9]{2}"), 0.60),
    Rule("prefixed_secret", "apikey", bounded("(?:sk|pk|api|key|token|bearer)[-_][A-Za-z0-9_-]{16,}"), 0.93, ignore_case=True),
    Rule("jwt", "apikey", bounded(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"), 0.97),
    Rule("otp", "otp", bounded("[0-9]{4,8}"), 0.18),
    Rule("entropy", "apikey", bounded(r"[A-Za-z0-9_\-+/=]{24,}"), 0.60, lambda m: entropy(m) >= 3.9),
)
BY_NAME = {r.name: r for r in RULES}

#: Whatever any rule can match has one of these; everything else skips the scan.
CANDIDATE = r"[0-9]{4}|@|[0-9][/\-.](?:0?[1-9]|1[0-2])[/\-.]|[0-9] ?-?[0-9]|[-_][A-Za-z0-9_-]{16}|[A-Za-z0-9_\-+/=]{24}|[A-Z]{4}0[A-Z0-9]{6}|eyJ[A-Za-z0-9_-]{10,}\."
HITS = T.ArrayType(
    T.StructType(
        [T.StructField("cls", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("p", T.DoubleType())]
    )
)


def candidate(text: Column) -> Column:
    """Text nodes worth describing: four digits in a row or an at sign."""
    return text.rlike("[0-9]{4,}|@")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<text,start>> of all matches: lengths of the gaps between matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<text:string,start:int>>")

    def step(acc: Column, k: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, k))
        match = F.get(found, k)
        return F.struct((start + F.length(match)).alias("at"), F.array_append(acc["out"], F.struct(match.alias("text"), start.alias("start"))).alias("out"))

    n = F.size(found)
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(n > 0, folded).otherwise(none)


def rule_hits(df: DataFrame, rule: Rule, key: str, text: str = "text") -> DataFrame:
    """key, cls, hit, start, end, p: one rule, all native."""
    rows = df.filter(F.col(text).rlike(rule.java)).select(key, F.explode(matches(F.col(text), rule.java)).alias("m"))
    rows = rows.select(key, F.lit(rule.cls).alias("cls"), F.col("m.text").alias("hit"), F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.text")).alias("end"))
    if rule.gate is not None:
        rows = rows.filter(rule.gate(F.col("hit")))
    return rows.withColumn("p", rule.score(F.col("hit")) if rule.score is not None else F.lit(rule.p))


# The same rules for the joint scan in one Arrow pass: gates again, on Python strings.


def _py_luhn(d: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
    return 12 <= len(d) <= 19 and total % 10 == 0


def _py_verhoeff(d: str) -> bool:
    if len(d) != 12 or d[0] in "01":
        return False
    table, turn, check = C._dihedral(), C._permutations(), 0
    for i, c in enumerate(reversed(d)):
        check = table[check][turn[i % 8][int(c)]]
    return check == 0


def _py_entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _py_mobile(d: str) -> bool:
    return re.fullmatch("[6-9][0-9]{9}", d[2:] if len(d) > 10 and d.startswith("91") else d) is not None


def _probability(rule: Rule, m: str) -> float | None:
    d = re.sub("[^0-9]", "", m)
    if rule.name == "aadhaar" and not _py_verhoeff(d) or rule.name == "card" and not (13 <= len(d) <= 19 and _py_luhn(d)):
        return None
    if rule.name == "pan" and m[3] not in C.PAN_HOLDERS or rule.name == "entropy" and _py_entropy(m) < 3.9:
        return None
    return 0.55 if rule.name == "phone" and not _py_mobile(d) else rule.p


_COMPILED = [(r, re.compile(r.java.replace(EDGE, r"\b"), re.ASCII)) for r in RULES]


def resolve(hits: list[tuple[str, int, int, str, float]]) -> list[tuple[str, int, int, str, float]]:
    """Greedy by (start, longest): an overlapping hit replaces the first one it overlaps only if clearly likelier and no shorter."""
    kept: list[tuple[str, int, int, str, float]] = []
    for h in sorted(hits, key=lambda h: (h[1], h[1] - h[2])):
        k = next((i for i, o in enumerate(kept) if h[1] < o[2] and o[1] < h[2]), None)
        if k is None:
            kept.append(h)
        elif h[4] > kept[k][4] + 0.1 and h[2] - h[1] >= kept[k][2] - kept[k][1]:
            kept[k] = h
    return kept


def scan(text: str | None) -> list[tuple[str, int, int, str, float]]:
    found = []
    for rule, pattern in _COMPILED:
        for m in pattern.finditer(text or ""):
            if (p := _probability(rule, m[0])) is not None:
                found.append((rule.cls, m.start(), m.end(), m[0], p))
    return resolve(found)


@F.pandas_udf(HITS)
def scan_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("cls", "start", "end", "text", "p"), h)) for h in scan(t)])


def scan_patterns(text: Column) -> Column:
    """All rules with overlaps resolved; texts without a candidate never reach Python."""
    return scan_udf(F.when(text.rlike(CANDIDATE), text))


def resolve_overlaps(hits: Column) -> Column:
    """Overlap resolution of array<struct<start,end,p,...>> as a native fold, for hits from native rules."""
    order = F.array_sort(hits, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])))
    none = F.filter(hits, lambda h: F.lit(False))

    def step(kept: Column, h: Column) -> Column:
        meets = F.transform(kept, lambda o: (h["start"] < o["end"]) & (o["start"] < h["end"]))
        at = F.array_position(meets, F.lit(True)).cast("int")
        old = F.try_element_at(kept, F.when(at > 0, at).otherwise(F.lit(1)))
        better = (h["p"] > old["p"] + 0.1) & (h["end"] - h["start"] >= old["end"] - old["start"])
        swapped = F.transform(kept, lambda o, i: F.when((i + 1 == at) & better, h).otherwise(o))
        return F.when(at == 0, F.array_append(kept, h)).otherwise(swapped)

    return F.aggregate(order, none, step)


def detect(elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, start, end, cls, p, source: pattern hits over value and text of elements."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("content")) for f in ("value", "text")])).alias("f")
    rows = elements.select(*keys, fields).select(*keys, "f.*").filter(F.col("content").rlike(CANDIDATE))
    hits = rows.select(*keys, "field", F.explode(scan_udf("content")).alias("h"))
    return hits.select(*keys, "field", "h.start", "h.end", "h.cls", "h.p", F.lit("regex").alias("source"))
