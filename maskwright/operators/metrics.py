"""Telemetry, evaluation and step-log aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a, round2

STAGES = ("perceive", "detect", "fuse", "redact", "verify", "network", "policy", "execute")


def confusion(df: DataFrame, expected: Column, flagged: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; a zero denominator counts as 1."""
    e, f = expected.cast("boolean"), flagged.cast("boolean")
    c = df.agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"), F.count_if(~e & ~f).alias("tn"))
    part = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a.cast("double") / b)
    c = c.withColumn("precision", part(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def fate_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scope").agg(*[F.count_if(F.col("fate") == f).alias(n) for f, n in (("drop", "dropped"), ("substitute", "substituted"), ("mask", "masked"))], F.count("*").alias("n"))


def class_counts(findings: DataFrame) -> DataFrame:
    """scope, counts: map of class to number."""
    each = findings.groupBy("scope", "cls").agg(F.count("*").alias("n"))
    return each.groupBy("scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("counts"))


def by_source(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def network_totals(steps: DataFrame) -> DataFrame:
    """n, up, down over steps that sent something to the server."""
    sent = (F.col("route") == "server") & F.col("bytes_up").isNotNull()
    return steps.groupBy("run").agg(F.count_if(sent).alias("n"), F.coalesce(F.sum(F.when(sent, F.col("bytes_up"))), F.lit(0)).alias("up"), F.coalesce(F.sum(F.when(sent, F.length("reply"))), F.lit(0)).alias("down"))


def route_split(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run").agg(F.count_if(F.col("route").isin("local", "done")).alias("local"), F.count_if(F.col("route") == "server").alias("server"))


def run_summary(steps: DataFrame) -> DataFrame:
    ms = lambda r: F.floor(F.avg(F.when(F.col("route") == r, F.col("total_ms"))) + 0.5).cast("long")
    return steps.groupBy("run").agg(
        F.count("*").alias("steps"), F.count_if(F.col("route") == "local").alias("local"), F.count_if(F.col("route") == "server").alias("server"),
        F.coalesce(F.sum("bytes_up"), F.lit(0)).alias("bytes"), ms("local").alias("local_ms"), ms("server").alias("server_ms"), F.bool_or(F.contains("vision", F.lit("degraded"))).alias("degraded"),
    )


def stage_shares(timings: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """run, stage, ms, share of the run's total."""
    long = timings.unpivot(["run"], list(stages), "stage", "ms")
    total = F.sum("ms").over(Window.partitionBy("run"))
    return long.withColumn("share", F.when(total > 0, F.col("ms") / total).otherwise(0.0))


def frame_saved(regions: DataFrame, width: int, height: int) -> DataFrame:
    return regions.groupBy("scope").agg((1 - F.sum(F.col("w") * F.col("h")).cast("double") / (width * height)).alias("saved"))


def coverage_share(cells: DataFrame, columns: int, rows: int) -> DataFrame:
    return cells.groupBy("scope").agg(F.countDistinct("cx", "cy").alias("covered")).withColumn("pct", F.floor(F.col("covered") * 100.0 / (columns * rows) + 0.5).cast("long"))


def scorecard(cases: DataFrame) -> DataFrame:
    """passed, local and total of router cases (route, expected)."""
    return cases.agg(F.count_if(F.col("route") == F.col("expected")).alias("passed"), F.count_if(F.col("route") == "local").alias("local"), F.count("*").alias("total"))


def fingerprint(states: DataFrame) -> DataFrame:
    """scope, fp: hash of the elements' states in order (scope, ord, state)."""
    return states.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "state"))), lambda s: s["state"]), "|").alias("s")).select("scope", fnv1a(F.col("s")).alias("fp"))


def stalls(steps: DataFrame) -> DataFrame:
    """run, step, stalled: consecutive steps before this one with the same fingerprint; from two on a run stops."""
    w = Window.partitionBy("run").orderBy("step")
    new = F.coalesce((F.col("fp") != F.lag("fp").over(w)).cast("int"), F.lit(0))
    islands = steps.withColumn("island", new).withColumn("island", F.sum("island").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.withColumn("stalled", F.row_number().over(Window.partitionBy("run", "island").orderBy("step")) - 1).drop("island")


def repeat_guard(actions: DataFrame) -> DataFrame:
    """Adds repeated: the same (kind, target) succeeded in an earlier step of the run."""
    w = Window.partitionBy("run", "kind", "target").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return actions.withColumn("repeated", F.coalesce(F.max((F.col("result") == "ok").cast("int")).over(w), F.lit(0)) == 1)


def ask_once(asks: DataFrame) -> DataFrame:
    """The first ask of each field of a run."""
    return asks.withColumn("r", F.row_number().over(Window.partitionBy("run", "target").orderBy("step"))).filter("r = 1").drop("r")


def image_flag(steps: DataFrame) -> DataFrame:
    """Adds with_image: the reply before asked for one."""
    return steps.withColumn("with_image", F.coalesce(F.lag("type").over(Window.partitionBy("run").orderBy("step")) == "need_image", F.lit(False)))


def top_margin(scores: DataFrame) -> DataFrame:
    """scope, top, margin to the second (null if alone)."""
    w = Window.partitionBy("scope").orderBy(F.col("score").desc(), "ord")
    return scores.select("scope", F.col("score").alias("top"), (F.col("score") - F.lead("score").over(w)).alias("margin"), F.row_number().over(w).alias("r")).filter("r = 1").drop("r")


def last_rows(history: DataFrame, n: int = 6) -> DataFrame:
    return history.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("step").desc()))).filter(F.col("r") <= n).drop("r")


def windowed_telemetry(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """An extension: tumbling counts and means by type."""
    rows = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", round2(F.col("mean")).alias("mean"))


def write_report(df: DataFrame, path: str) -> None:
    """The evaluation sink: JSON lines."""
    df.write.mode("overwrite").json(path)


def html_report(metrics: dict[str, object]) -> str:
    """A one-table page of headline figures, which are few."""
    import html

    rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>" for k, v in metrics.items())
    return f"<!DOCTYPE html><meta charset=utf-8><title>Report</title><table>{rows}</table>"
