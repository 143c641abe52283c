"""The vault of each task: handles that are stable within a run's task and forgotten with it, on a stream and on a table.

A row is a value found at a step: (run, ts, step, ord, task, cls, value); ord orders a step's values as they are minted: value before
text, from the right within a string. A run's task ends where another one begins or, on a stream, after an hour of event time without a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.redact import mint
from ..schema import CLASSES
from .ordered import Ordered, in_order

PREFIX = {cls: prefix for cls, _, prefix in CLASSES}


class Vault(Ordered):
    """State of a run: its task, (cls, value) -> handle, and the last number of each prefix."""

    columns, out = "ord int, task string, cls string, value string", "run long, step long, ord int, task string, cls string, value string, handle string"

    def declare(self, handle):
        self.task = handle.getValueState("task", "task string")
        self.handles = handle.getMapState("handles", "kind string, value string", "handle string")
        self.numbers = handle.getMapState("numbers", "prefix string", "n long")

    def forget(self):
        for state in (self.task, self.handles, self.numbers):
            state.clear()

    def take(self, key, rows):
        out = []
        for _, step, ord_, task, cls, value in rows:
            if not self.task.exists() or self.task.get()[0] != task:
                self.forget()
                self.task.update((task,))
            if value is None:
                handle = None
            elif self.handles.containsKey((cls, value)):
                handle = self.handles.getValue((cls, value))[0]
            else:
                prefix = PREFIX.get(cls, "PII")
                n = (self.numbers.getValue((prefix,))[0] if self.numbers.containsKey((prefix,)) else 0) + 1
                self.numbers.updateValue((prefix,), (n,))
                handle = f"{prefix}_{n}"
                self.handles.updateValue((cls, value), (handle,))
            out.append((int(key[0]), step, ord_, task, cls, value, handle))
        return out


def task_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `part`: how many times a run's task has changed so far."""
    run = Window.partitionBy("run").orderBy(*order)
    changed = F.coalesce((~F.col("task").eqNullSafe(F.lag("task").over(run))).cast("int"), F.lit(0))
    first = F.row_number().over(run) == 1
    return rows.withColumn("part", F.when(first, 0).otherwise(changed)).withColumn("part", F.sum("part").over(run))


def task_vaults(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """run, step, ord, task, cls, value, handle; null values have no handle."""
    if rows.isStreaming:
        return in_order(rows, "run", Vault(), delay)
    placed = task_parts(rows, ["ts", "step", "ord"]).withColumn("scope", F.struct("run", "part")).withColumn("place", F.struct("ts", "step", "ord"))
    named = mint(placed.filter("value is not null")).unionByName(placed.filter("value is null").withColumn("handle", F.lit(None).cast("string")))
    return named.select("run", "step", "ord", "task", "cls", "value", "handle")
