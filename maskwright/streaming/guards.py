"""Step guards over a stream of agent steps, keyed by run: the same answers as the batch forms in operators.metrics.

Steps with a time (`ts`) are taken in order of time, late ones included; those without one in order of step within each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import Ordered, in_order

STEP_CAP, STALL_CAP = 25, 2
OUT = "run long, step long, fp string, stalled int, repeated boolean, first_ask boolean, stop string"
STATE = "task string, fp string, stalled int, done array<string>, asked array<string>, steps int"


def advance(state: tuple, rows: pd.DataFrame, sort: bool = True) -> tuple[tuple, pd.DataFrame]:
    """One run's state over more of its steps: (task, fp, stalled, done, asked, steps). A new task forgets everything."""
    task, fp, stalled, done, asked, steps = state
    done, asked, out = set(done), set(asked), []
    for r in (rows.sort_values("step") if sort else rows).itertuples():
        if r.task != task:
            task, fp, stalled, done, asked, steps = r.task, None, 0, set(), set(), 0
        steps += 1
        stalled = stalled + 1 if fp == r.fp else 0
        fp = r.fp
        key, ask = f"{r.kind}\0{r.target}", r.kind == "ask_user" and r.target not in asked
        repeated = key in done
        if r.result == "ok":
            done.add(key)
        if r.kind == "ask_user":
            asked.add(r.target)
        stop = "step cap" if steps >= STEP_CAP else "no progress" if stalled >= STALL_CAP else None
        out.append((r.run, r.step, r.fp, stalled, repeated, ask, stop))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
    return (task, fp, stalled, sorted(done), sorted(asked), steps), frame


def _whole(steps: DataFrame) -> DataFrame:
    """A table's runs by windows: part numbers a run's tasks, island the stretches of equal fingerprints in one."""
    step = ["ts", "step"] if "ts" in steps.columns else ["step"]
    run = Window.partitionBy("run").orderBy(*step)
    changed = lambda c, w: F.coalesce((~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int"), F.lit(0))
    parts = steps.withColumn("part", changed("task", run)).withColumn("part", F.sum("part").over(run))
    part = Window.partitionBy("run", "part").orderBy(*step)
    islands = parts.withColumn("n", F.row_number().over(part)).withColumn("island", changed("fp", part)).withColumn("island", F.sum("island").over(part))
    same = Window.partitionBy("run", "part", "kind", "target").orderBy(*step)
    done = F.max((F.col("result") == "ok").cast("int")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    told = islands.select(
        F.col("run").cast("long").alias("run"), F.col("step").cast("long").alias("step"), "fp", (F.row_number().over(Window.partitionBy("run", "part", "island").orderBy(*step)) - 1).alias("stalled"),
        (F.coalesce(done, F.lit(0)) == 1).alias("repeated"), ((F.col("kind") == "ask_user") & (F.row_number().over(same) == 1)).alias("first_ask"), "n",
    )
    stop = F.when(F.col("n") >= STEP_CAP, "step cap").when(F.col("stalled") >= STALL_CAP, "no progress")
    return told.select("run", "step", "fp", "stalled", "repeated", "first_ask", stop.alias("stop"))


class Guards(Ordered):
    """State of a run: what `advance` needs from its steps so far."""

    columns, out = "task string, fp string, kind string, target string, result string", OUT

    def declare(self, handle):
        self.state = handle.getValueState("state", STATE)

    def forget(self):
        self.state.clear()

    def take(self, key, rows):
        frame = pd.DataFrame([r[1:] for r in rows], columns=self.names[1:])
        frame.insert(0, "run", int(key[0]))
        held = tuple(self.state.get()) if self.state.exists() else (None, None, 0, [], [], 0)
        new, out = advance(held, frame, sort=False)
        self.state.update(new)
        return list(out.itertuples(index=False, name=None))


def guarded(steps: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """steps: run, step, task, fp, kind, target, result, and ts where event time counts; a stream or a table."""
    if not steps.isStreaming:
        return _whole(steps)
    if "ts" in steps.columns:
        return in_order(steps, "run", Guards(), delay)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # A batch's frames may split a run's steps anywhere: they are ordered by step before the state moves on.
        rows = pd.concat(list(frames))
        new, out = advance(state.get if state.exists else (None, None, 0, [], [], 0), rows)
        state.update(new)
        yield out

    return steps.groupBy("run").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
