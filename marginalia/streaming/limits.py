"""Rate limits over fixed windows as keyed state with timers: what a window has counted is forgotten two windows after it began.

Streams need the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT_WINDOWS = 2


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Counter(StatefulProcessor):
    """A map of a key's open windows to their counts; a window's timer removes it."""

    def __init__(self, key: str, seconds: int, limit: int):
        self.key, self.seconds, self.limit = key, seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", StructType([StructField("window_start", LongType())]), StructType([StructField("n", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = sorted(t for frame in rows for t in frame["at"].tolist())
        out, counts = [], {}
        for at in times:
            start = at // (self.seconds * 1_000_000) * self.seconds
            if start not in counts:
                known = self.counts.containsKey((start,))
                counts[start] = self.counts.getValue((start,))[0] if known else 0
                if not known:
                    self.handle.registerTimer((start + KEPT_WINDOWS * self.seconds) * 1000)
            counts[start] += 1
            out.append((key[0], at, start, counts[start], counts[start] <= self.limit))
        for start, n in counts.items():
            self.counts.updateValue((start,), (n,))
        yield pd.DataFrame(out, columns=[self.key, "at", "window_start", "n", "allowed"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() // 1000 - KEPT_WINDOWS * self.seconds
        if self.counts.containsKey((start,)):
            self.counts.removeKey((start,))
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, key: str, seconds: int, limit: int, ts: str = "ts") -> DataFrame:
    """Every event with its place n in its key's window (from the epoch) and whether that is within the limit: key, at (microseconds), window_start (seconds), n, allowed.

    A stream judges events as they come, those of one batch in order of time; a row may be as late as its window is kept: it is
    dropped once two windows have passed since its window began, when the window's count is gone too. A key's state is a number for each window
    that isn't gone. Null keys are passed over. On a batch the place is that in the order of time.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    shape = f"{key} {kind}, at long, window_start long, n long, allowed boolean"
    if not rows.isStreaming:
        start = F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds
        rows = rows.select(key, F.unix_micros(ts).alias("at"), start.cast("long").alias("window_start"))
        n = F.row_number().over(Window.partitionBy(key, "window_start").orderBy("at")).cast("long")
        return rows.withColumn("n", n).withColumn("allowed", F.col("n") <= limit)
    marked = rows.withWatermark(ts, f"{seconds} seconds").select(key, ts, F.unix_micros(ts).alias("at"))
    return marked.groupBy(key).transformWithStateInPandas(_Counter(key, seconds, limit), shape, "append", "EventTime")
