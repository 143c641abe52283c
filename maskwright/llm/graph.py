"""Connected components of an edge table, as joins and sums in rounds; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """node, component (its least node), for every node of an edge. Each round takes the least label among the
    neighbours and then that label's own label, so chains shorten by more than half a round. rows: about how many nodes there are."""
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = common.materialise(one.union(one.select("b", "a")).distinct(), "edges", rows)
    labels = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", rows)
    while True:
        known = labels.withColumnRenamed("node", "a")
        near = both.join(known, "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("beyond"))
        moved = lower.join(jump, "new").select("node", "component", F.least("new", "beyond").alias("new"))
        moved = common.materialise(moved, "labels", rows)
        labels = moved.select("node", F.col("new").alias("component"))
        if not moved.filter("component <> new").limit(1).count():
            return labels
