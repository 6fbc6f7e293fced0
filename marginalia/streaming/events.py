"""Event streams: windowed counters, duplicates, progress and an accept-once-a-gap filter, each with its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, ts: str = "ts", files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what is there; times without a zone become UTC timestamps."""
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def counters(events: DataFrame, seconds: int, by: list[str], late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts of fixed windows from the epoch; state is dropped once the watermark has passed. The same on a batch."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    n = rows.groupBy(*by, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return n.select(*by, F.unix_timestamp("w.start").alias("window_start"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Each key once; a stream forgets keys older than the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def progress(events: DataFrame, key: str, value: str, done: str) -> DataFrame:
    """The furthest value and whether the key was ever done: an update-mode aggregate that only rises."""
    return events.groupBy(key).agg(F.max(value).alias("progress"), F.bool_or(done).alias("completed"))


def accepted(events: DataFrame, key: str, gap_seconds: int, ts: str = "ts") -> DataFrame:
    """Counts of accepted events of each key: the first, then each that comes at least the gap after the last accepted.

    A window can't express it, since each window begins with an accepted event. The state of a key is two numbers.
    Null keys are passed over.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull()).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    gap = gap_seconds * 1_000_000

    def step(last: int | None, n: int, times: list[int]) -> tuple[int | None, int]:
        for t in sorted(times):
            if last is None or t - last >= gap:
                last, n = t, n + 1
        return last, n

    if events.isStreaming:

        def update(k: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            last, n = state.get if state.exists else (None, 0)
            last, n = step(last, n, [t for f in frames for t in f["at"].tolist()])
            state.update((last, n))
            yield pd.DataFrame({key: [k[0]], "accepted": [n]})

        return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, accepted long", "last long, n long", "update", GroupStateTimeout.NoTimeout)

    from marginalia.operators.learning import fold

    return fold(rows, key, ["at"], lambda: (None, 0), lambda s, t: step(s[0], s[1], [t]), ["at"], f"{key} {kind}, last long, accepted long").drop("last")


def accepted_events(events: DataFrame, key: str, gap_seconds: int, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The accepted events themselves: key and at (microseconds), as a stream of rows that are final.

    An event waits until the watermark has passed it, so events are judged in the order of their times, whichever
    batch they came in; one later than the watermark is dropped. A key's state, the last accepted time and the events
    that wait, goes once no event that may still come could be refused because of it. The same on a batch, without
    a watermark. Null keys are passed over.
    """
    kind = events.schema[key].dataType.simpleString()
    gap = gap_seconds * 1_000_000
    rows = events.where(F.col(key).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))

    def judge(last: int | None, times: list[int]) -> tuple[int | None, list[int]]:
        out = []
        for t in sorted(times):
            if last is None or t - last >= gap:
                out.append(t)
                last = t
        return last, out

    if not events.isStreaming:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, last = None, None
            for frame in frames:
                made = []
                for k, t in frame.itertuples(index=False, name=None):
                    if k != now:
                        now, last = k, None
                    last, good = judge(last, [t])
                    made += [(k, x) for x in good]
                yield pd.DataFrame(made, columns=[key, "at"])

        dealt = rows.select(key, F.unix_micros(ts).alias("at")).repartition(key).sortWithinPartitions(key, "at")
        return dealt.mapInPandas(run, f"{key} {kind}, at long")

    def update(k: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get if state.exists else (None, []))
        waiting = [*waiting, *(t for f in frames for t in f["at"].tolist())]
        mark = state.getCurrentWatermarkMs() * 1000
        last, good = judge(last, [t for t in waiting if t < mark])
        waiting = [t for t in waiting if t >= mark]
        if not waiting and (last is None or last + gap <= mark):
            if state.exists:
                state.remove()
        else:
            state.update((last, waiting))
            state.setTimeoutTimestamp(max(min(waiting, default=last + gap if last is not None else mark) // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame({key: [k[0]] * len(good), "at": good})

    marked = rows.withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("at"))
    return marked.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, at long", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
