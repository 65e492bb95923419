"""Counts in a stream's own state: changes in event-time order, and reading the state while the stream runs.

Insertions and removals that stop at none or at the maximum don't commute, so what a key's count is depends on their order.  Here that
is event time, whatever the triggers: a key keeps its count as of the watermark and, by time, the changes after it.  Each trigger
gives the count that all changes known so far amount to; when the watermark passes, a timer folds them into the
count, and a key without count or changes leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from countloom.functions.expressions import key_in_range
from countloom.operators import counted
from countloom.plans.spec import FilterSpec

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def applied(count: int, changes: list[tuple[int, int, int]], maximum: int | None) -> int:
    """A count after changes (time, more, less), in order of time; of one instant first what is added."""
    for _, more, less in sorted(changes):
        count = max(0, (count + more if maximum is None else min(count + more, maximum)) - less)
    return count


class Changes(StatefulProcessor):
    """count: as of the watermark; pending: what came after it, by time in microseconds."""

    def __init__(self, maximum: int | None):
        self.maximum = maximum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "count bigint")
        self.pending = handle.getMapState("pending", "at bigint", "more bigint, less bigint")

    def _settled(self) -> int:
        return self.count.get()[0] if self.count.exists() else 0

    def _waiting(self) -> list[tuple[int, int, int]]:
        return [(k[0], v[0], v[1]) for k, v in self.pending.iterator()] if self.pending.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[int]] = {}
        for frame in rows:  # one entry an instant and sign
            at, n = frame["at"].to_numpy(), frame["n"].to_numpy()
            times, which = np.unique(at, return_inverse=True)
            more, less = np.zeros(len(times), np.int64), np.zeros(len(times), np.int64)
            np.add.at(more, which, np.maximum(n, 0))
            np.add.at(less, which, np.maximum(-n, 0))
            for t, m, x in zip(times.tolist(), more.tolist(), less.tolist(), strict=True):
                own = new.setdefault(t, [0, 0])
                own[0] += m
                own[1] += x
        known = {t: (m, x) for t, m, x in self._waiting()}
        earliest = min(known, default=None)
        for t, (m, x) in new.items():
            before = known.get(t, (0, 0))
            known[t] = before[0] + m, before[1] + x
            self.pending.updateValue((t,), known[t])
        if known and (earliest is None or min(known) < earliest):
            self.handle.registerTimer(min(known) // 1000 + 1)
        count = applied(self._settled(), [(t, *v) for t, v in known.items()], self.maximum)
        yield pd.DataFrame({"key": [key[0]], "count": [count]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._waiting()
        done = [c for c in waiting if c[0] <= upto]
        count = applied(self._settled(), done, self.maximum)
        for t, _, _ in done:
            self.pending.removeKey((t,))
        left = [t for t, _, _ in waiting if t > upto]
        if left:
            self.handle.registerTimer(min(left) // 1000 + 1)
        if count:
            self.count.update((count,))
        elif self.count.exists():
            self.count.clear()
        yield pd.DataFrame({"key": [], "count": []}, dtype="int64")

    def close(self) -> None:
        pass


def running_changes(stream: DataFrame, spec: FilterSpec, *, key: str, n: str, time: str, late: str) -> DataFrame:
    """(key, count) of the keys of each trigger, for insertions (n > 0) and removals (n < 0) in event-time order; update mode.

    The last count of a key is the same however the stream is cut into triggers, as long as no row comes more than `late` behind
    the newest (those are dropped).  Rows without key, time or number are left out.  The session's state store becomes RocksDB's.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    changes = timed.select(F.col(time), key_in_range(key, spec).alias("key"), F.col(n).cast("bigint").alias("n"), F.unix_micros(time).alias("at")).filter("key is not null and n is not null and at is not null")
    return changes.groupBy("key").transformWithStateInPandas(Changes(spec.maximum_count), "key bigint, count bigint", "Update", "EventTime")


def state_counts(spark: SparkSession, checkpoint: str, *, batch: int | None = None) -> DataFrame:
    """(key, count, label) that a stream of running_counts() has in its state, running or not, after a committed batch (by default the newest)."""
    reader = spark.read.format("statestore")
    rows = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return rows.select(F.col("key.key").alias("key"), F.col("value").getField(rows.schema["value"].dataType.names[0]).alias("count"), F.lit(0).cast("bigint").alias("label"))


def changes_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, count) as of the watermark that a stream of running_changes() has in its state."""
    rows = spark.read.format("statestore").option("stateVarName", "count").load(checkpoint)
    return rows.select(F.col("key.key").alias("key"), F.col("value.count").alias("count"))


def with_base(spark: SparkSession, checkpoint: str, base: DataFrame, spec: FilterSpec) -> DataFrame:
    """(key, count, label): a stored set and what a running stream has counted beside it, without stopping the stream."""
    both = base.select("key", "count", "label").unionAll(state_counts(spark, checkpoint))
    return both.groupBy("key").agg(counted.saturated(F.sum("count"), spec).alias("count"), F.max("label").alias("label"))
