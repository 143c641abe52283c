"""Evidence fusion: noisy-OR per (element, field, span, class), then a tie-break between two thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksums as C
from ..functions.text import clamp, norm
from ..schema import FIELD_TAGS, VISUAL, fate

KEEP, DISCARD, REPEATS = 0.80, 0.35, 4

# Words near a value that speak for or against its class; plain substrings.
FOR = (
    ("phone", "phone|mobile|contact|tel|whatsapp|call"),
    ("email", "e-?mail"),
    ("person", "name|applicant|candidate|holder|student"),
    ("address", "address|street|city|pin|postal|zip|residence"),
    ("card", "card|credit|debit|cvv|payment"),
    ("aadhaar", "aadhaar|aadhar|uid"),
    ("pan", r"pan|income\s*tax"),
    ("dob", "birth|dob|born"),
    ("otp", "otp|code|verification|verify"),
    ("ifsc", "ifsc|bank|branch"),
    ("upi", "upi|vpa|pay"),
)
AGAINST = (
    ("phone", r"order|invoice|tracking|awb|reference|txn|transaction|ticket|receipt|gst|pin\s*code|serial"),
    ("card", "order|invoice|tracking|reference|awb|serial|imei"),
    ("aadhaar", r"order|invoice|tracking|reference|serial|imei|account\s*number"),
    ("dob", "published|updated|posted|expires|valid|issued|delivery"),
    ("otp", r"price|amount|qty|quantity|year|pin\s*code|rupees|total"),
    ("person", "company|organisation|organization|brand|product|department"),
)


def _speaks(cls: Column, context: Column, table: tuple) -> Column:
    out = F.lit(False)
    for c, words in table:
        out = F.when(cls == c, context.rlike(words)).otherwise(out)
    return out


def noisy_or(p: Column) -> Column:
    """Aggregate: 1 - product(1 - p)."""
    return 1 - F.product(1 - clamp(p))


def left_context(raw: Column, start: Column, width: int = 40) -> Column:
    """The characters before a span."""
    begin = F.greatest(start - width, F.lit(0))
    return F.when(start.isNull(), F.lit("")).otherwise(F.substring(raw, begin + 1, start - begin))


def grouped(detections: DataFrame) -> DataFrame:
    """scope, id, field, start, end, cls with fused p, sources and their number; missing spans compare equal."""
    return detections.groupBy("scope", "id", "field", "start", "end", "cls").agg(
        noisy_or(F.col("p")).alias("p"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n_detections")
    )


def delta(cls: Column, context: Column, span: Column, tag: Column, role: Column, repeats: Column, n_sources: Column, on_task: Column | None = None) -> Column:
    """The tie-break's sum; it is added to p as a whole."""
    label = F.when(_speaks(cls, context, FOR), 0.30).when(_speaks(cls, context, AGAINST), -0.40).otherwise(0.0)
    check = F.when(cls == "aadhaar", F.when(C.verhoeff(span), 0.25).otherwise(-0.5)).when(cls == "card", F.when(C.luhn(span), 0.2).otherwise(-0.5)).otherwise(0.0)
    where = F.when(tag.isin(*FIELD_TAGS), 0.12).when(role == "heading", -0.15).otherwise(0.0)
    often = F.when(repeats >= REPEATS, -0.25).otherwise(0.0)
    task = F.lit(0.0) if on_task is None else F.when(on_task.isNull(), 0.0).when(on_task, -0.08).otherwise(0.06)
    return label + check + where + often + task + F.when(n_sources >= 2, 0.10).otherwise(0.0)


def unsubsumed(findings: DataFrame) -> DataFrame:
    """Where an element's value is dropped, its other value findings go; one pass over an element's findings."""
    drop = F.coalesce((F.col("field") == "value") & (F.col("fate") == "drop"), F.lit(False))
    gone = F.max(drop).over(Window.partitionBy("scope", "id"))
    return findings.withColumn("gone_", gone).filter("not gone_ or field <> 'value' or fate = 'drop'").drop("gone_")


def fuse(elements: DataFrame, detections: DataFrame) -> DataFrame:
    """scope, ord, id, field, start, end, cls, p, sources, fate, anchored: the findings that stand.

    detections: scope, id, field, start, end, cls, p, source. Detections without an element keep their noisy-OR."""
    e = elements.select("scope", "id", "ord", "tag", "role", "name", "label", "placeholder", "value", "text")
    raw = F.coalesce(F.when(F.col("field") == "value", F.col("value")).otherwise(F.col("text")), F.lit(""))
    span = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.substring(raw, F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(raw)
    each = detections.join(e, ["scope", "id"], "left").withColumn("span", norm(span))
    known = F.col("ord").isNotNull() & (F.col("span") != "")
    repeats = F.when(known, F.count(F.when(known, 1)).over(Window.partitionBy("scope", "span"))).otherwise(1)
    counted = each.withColumn("repeats", repeats)
    keys = ["scope", "id", "field", "start", "end", "cls"]
    groups = counted.groupBy(*keys).agg(
        noisy_or(F.col("p")).alias("p"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("repeats").alias("repeats"),
        *[F.first(c).alias(c) for c in ("ord", "tag", "role", "name", "label", "placeholder", "value", "text")],
    )
    context = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("label", "name", "placeholder")], F.nullif(left_context(raw, F.col("start")), F.lit(""))))
    moved = F.col("p") + delta(F.col("cls"), context, span, F.col("tag"), F.col("role"), F.col("repeats"), F.size("sources"))
    visual = F.col("cls").isin(*VISUAL)
    settled = F.when(visual | F.col("ord").isNull() | (F.col("p") >= KEEP), F.col("p")).otherwise(moved)
    least = F.when(visual, F.lit(DISCARD)).otherwise(F.lit(KEEP))
    scored = groups.select(*keys, "ord", "sources", F.col("p").alias("raw_p"), F.explode_outer(F.array(settled)).alias("p"))
    found = scored.filter((F.col("raw_p") >= DISCARD) & (F.col("p") >= least)).select(*keys, "ord", "p", "sources", fate(F.col("cls")).alias("fate"), F.col("ord").isNotNull().alias("anchored"))
    return unsubsumed(found)
