"""Lookups between elements, detections, findings, vault and history: equality joins within the scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_elements(detections: DataFrame, elements: DataFrame) -> DataFrame:
    """Detections with their element's columns and `anchored`; those without an element stay."""
    return detections.join(elements.withColumn("known_", F.lit(True)), ["scope", "id"], "left").withColumn("anchored", F.col("known_").isNotNull()).drop("known_")


def with_findings(elements: DataFrame, findings: DataFrame) -> DataFrame:
    """Elements with `found`, their findings' (cls, fate) in order of class; null where there are none."""
    lists = findings.groupBy("scope", "id").agg(F.array_sort(F.collect_list(F.struct("cls", "fate"))).alias("found"))
    return elements.join(lists, ["scope", "id"], "left")


def image_context(elements: DataFrame) -> DataFrame:
    """scope, id, context: an image's name, label and placeholder and its parent's name."""
    images = elements.filter("role = 'image' or tag = 'img'").select("scope", "id", "name", "label", "placeholder", "parent")
    up = elements.select("scope", F.col("id").alias("parent"), F.col("name").alias("up"))
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("name", "label", "placeholder", "up")]
    return images.join(up, ["scope", "parent"], "left").select("scope", "id", F.concat_ws(" ", *parts).alias("context"))


def resolved_handles(actions: DataFrame, vault: DataFrame) -> DataFrame:
    """Actions (scope, value) with `plain`, what the handle in value stands for; null if the vault doesn't know it."""
    known = vault.select("scope", F.col("handle").alias("value"), F.col("value").alias("plain"))
    return actions.withColumn("value", F.trim("value")).join(known, ["scope", "value"], "left")


def not_asked(fields: DataFrame, history: DataFrame) -> DataFrame:
    """Fields (scope, id) that the history (scope, action, target) has no question about."""
    asked = history.filter("action = 'ask_user' and target is not null").select("scope", F.col("target").alias("id")).distinct()
    return fields.join(asked, ["scope", "id"], "left_anti")


def realigned(raw: Column, wanted: Column, start: Column) -> Column:
    """Place of the occurrence of `wanted` in raw text that is nearest to `start`, the first of equals; `start` where there is none.

    raw is split before every occurrence, overlapping ones included, and the parts' lengths are summed: linear in raw."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(wanted, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    none = F.lit(None).cast("int")

    def step(s: Column, part: Column) -> Column:
        here = (s["at"] > 0) | F.startswith(raw, wanted)
        nearer = s["best"].isNull() | (F.abs(s["at"] - start) < F.abs(s["best"] - start))
        return F.struct((s["at"] + F.length(part)).alias("at"), F.when(here & nearer, s["at"]).otherwise(s["best"]).alias("best"))

    found = F.aggregate(F.split(raw, quoted), F.struct(F.lit(0).alias("at"), none.alias("best")), step)["best"]
    return F.when((wanted == "") | wanted.isNull(), start).otherwise(F.coalesce(found, start))


def offered(scores: DataFrame, k: int = 3) -> DataFrame:
    """scope, options: names of the scope's best controls (scope, ord, name, score), best first."""
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("score").desc(), "ord"))
    some = scores.filter("score > 0").withColumn("r", rank).filter(F.col("r") <= k)
    return some.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda o: o["name"]).alias("options"))


def first_pass(nodes: DataFrame) -> DataFrame:
    """Of a node's rows (scope, node, pass) from several passes the earliest pass's."""
    rank = F.row_number().over(Window.partitionBy("scope", "node").orderBy("pass"))
    return nodes.withColumn("r_", rank).filter("r_ = 1").drop("r_")


def within_budget(nodes: DataFrame, most: int = 400) -> DataFrame:
    """At most `most` nodes of a scope, in order of pass and place, so that media go before text."""
    rank = F.row_number().over(Window.partitionBy("scope").orderBy("pass", "node"))
    return nodes.withColumn("ord", rank).filter(F.col("ord") <= most)


def vault_locked(elements: DataFrame, findings: DataFrame) -> DataFrame:
    """scope, locked: without a profile, does a blank field of known class wait for one?"""
    known = findings.filter("field = 'value'").select("scope", "id").distinct().withColumn("known_", F.lit(True))
    blank = F.coalesce(F.col("value"), F.lit("")) == ""
    met = elements.join(known, ["scope", "id"], "left")
    return met.groupBy("scope").agg(F.bool_or(blank & F.col("known_").isNotNull()).alias("locked"))


#: What a lost backslash looks like in source lines.
SUSPECT_ESCAPES = (r"\[\^@s\]", r"/\^d\{", r"\.replace\(/D/g", r"\.replace\(/s\+/g", r"\.split\(/s\+/", r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def suspicious_escapes(lines: DataFrame) -> DataFrame:
    """The rows of (line, ...) with a suspicious escape, once for each kind, with its number `kind`."""
    kinds = F.array(*[F.when(F.col("line").rlike(p), F.lit(k)) for k, p in enumerate(SUSPECT_ESCAPES)])
    return lines.withColumn("kind", F.explode(F.array_compact(kinds)))
