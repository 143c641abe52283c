"""Event-time order for keyed state: rows wait until the watermark has passed them, then a run's rows are taken in their own order.

A micro-batch's order and its borders therefore decide nothing: late rows within the watermark's delay are put where they belong, and later ones
are dropped by Spark. After `idle` of event time without a row all of a run's state goes, so nothing outlives its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Ordered(StatefulProcessor):
    """Subclasses say which columns rows have besides `at` (milliseconds) and `step`, declare their state, and take rows in order."""

    #: Columns after at and step, as a schema; what comes out; milliseconds of event time after which a run's state goes.
    columns, out, idle = "", "", 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = ["at", "step", *(c.split()[0] for c in self.columns.split(", "))]
        kept = ", ".join(f"v_{c}" for c in self.columns.split(", "))  # state columns can't have every name
        self.waiting = handle.getMapState("waiting", "at long, place long", f"at long, step long, {kept}")
        self.places = handle.getValueState("places", "n long")
        self.last = handle.getValueState("last", "at long")
        self.declare(handle)

    def declare(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            some = [tuple(None if pd.isna(v) else v for v in r) for r in frame[self.names].itertuples(index=False)]
            place = self.places.get()[0] if self.places.exists() else 0
            for row in some:
                place += 1
                self.waiting.updateValue((int(row[0]), place), row)
            self.places.update((place,))
            for at in {r[0] for r in some}:
                self.handle.registerTimer(int(at))
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [(tuple(k), tuple(v)) for k, v in self.waiting.iterator()]
        due = sorted((r for k, r in held if k[0] <= now), key=lambda r: tuple((v is not None, v) for v in r))
        if due:
            for k in [k for k, _ in held if k[0] <= now]:
                self.waiting.removeKey(k)
            self.last.update((due[-1][0],))
            self.handle.registerTimer(int(due[-1][0]) + self.idle)
            yield self.frame(self.take(key, due))
        elif self.last.exists() and self.last.get()[0] + self.idle <= now and not held:
            self.last.clear()
            self.places.clear()
            self.forget()

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in self.out.split(", ")])

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, processor: Ordered, delay: str) -> DataFrame:
    """A stream with a column `ts` through the processor; sets the session's state store to the one that such state needs."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    names = [c.split()[0] for c in processor.columns.split(", ")]
    marked = rows.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts")).select("ts", key, "at", "step", *names)
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.out, outputMode="append", timeMode="EventTime")
