"""Streams with late and repeated rows against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from marginalia.streaming import events as ev
from marginalia.streaming import limits

START = dt.datetime(2024, 1, 1)


def drain(spark, df, mode, name, tmp_path):
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
    return spark.table(name)


def files(spark, folder, batches):
    """One Parquet file for each batch, in order; each gets a batch of its own."""
    for i, rows in enumerate(batches):
        data = [(k, u, START + dt.timedelta(minutes=m)) for k, (u, m) in enumerate(rows, 1000 * i)]
        spark.createDataFrame(data, "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_accepted_events_with_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches = [[(1, 0), (1, 50), (2, 10)], [(1, 40), (1, 130), (2, 75), (None, 80)], [(1, 95), (2, 71), (3, 140)], [(1, 400), (2, 400)], [(9, 5000)], [(9, 9000)]]
    files(spark, folder, batches)
    stream = ev.read(spark, folder, files_per_trigger=1)
    found = {tuple(r) for r in drain(spark, ev.accepted_events(stream, "user_id", 3600, late="2 hours"), "append", "accepted_late", tmp_path).collect()}
    batch = {tuple(r) for r in ev.accepted_events(spark.read.parquet(folder), "user_id", 3600).collect()}
    last = int((START + dt.timedelta(minutes=5000)).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert {x for x in batch if x[1] < last} <= found <= batch
    assert (1, int((START + dt.timedelta(minutes=95)).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)) in found  # came after the event of minute 130, which it keeps out


def test_once_in_a_stream(spark, tmp_path):
    folder = str(tmp_path / "once")
    files(spark, folder, [[(1, 0), (2, 5)], [(1, 20), (3, 30)], [(2, 40), (4, 50)]])
    stream = ev.read(spark, folder, files_per_trigger=1)
    found = [r["user_id"] for r in drain(spark, ev.once(stream, ["user_id"], late="3 hours"), "append", "once_stream", tmp_path).collect()]
    assert sorted(found) == [1, 2, 3, 4] == sorted(r["user_id"] for r in ev.once(spark.read.parquet(folder), ["user_id"]).collect())


def test_late_rows_of_counters(spark, tmp_path):
    folder = str(tmp_path / "count")
    files(spark, folder, [[(1, 0), (1, 70)], [(1, 10), (1, 300)], [(1, 310)], [(1, 20), (1, 600)]])
    stream = ev.read(spark, folder, files_per_trigger=1)
    found = drain(spark, ev.counters(stream, 3600, ["user_id"], late="2 hours"), "append", "late_counters", tmp_path).collect()
    first = [r["n"] for r in found if r["window_start"] == int(START.replace(tzinfo=dt.timezone.utc).timestamp())]
    assert first == [2]  # the row of minute 20 comes after the window was closed
    assert ev.counters(spark.read.parquet(folder), 3600, ["user_id"]).agg(F.sum("n")).first()[0] == 7


def test_rate_limit_with_expiry(spark, tmp_path):
    """Counts go on over batches, a late row of a kept window counts, one of a window that is gone is dropped, and gone windows leave no state."""
    limits.use_state_store(spark)
    folder = str(tmp_path / "rate_in")
    # The watermark is one hour behind: after minute 200 it is at 140.
    files(spark, folder, [[(1, 0), (1, 10), (2, 5)], [(1, 20), (1, 70), (None, 71)], [(1, 40), (2, 100)], [(3, 200)], [(1, 30), (3, 201), (1, 145)], [(9, 400)], [(9, 401)]])
    stream = ev.read(spark, folder, files_per_trigger=1)
    found = sorted((r["user_id"], (r["at"] - int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)) // 60_000_000, r["n"], r["allowed"]) for r in drain(spark, limits.rate_limited(stream, "user_id", 3600, 3), "append", "rate", tmp_path).collect())
    assert found == [(1, 0, 1, True), (1, 10, 2, True), (1, 20, 3, True), (1, 40, 4, False), (1, 70, 1, True), (1, 145, 1, True), (2, 5, 1, True), (2, 100, 1, True), (3, 200, 1, True), (3, 201, 2, True), (9, 400, 1, True), (9, 401, 2, True)]
    left = spark.read.format("statestore").option("stateVarName", "counts").load(str(tmp_path / "rate"))
    assert {r["key"][0] for r in left.select("key").collect()} == {9}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_rate_limit_of_a_table(spark):
    rows = [(k, START + dt.timedelta(minutes=m)) for k, m in [(1, 0), (1, 59), (1, 60), (1, 30), (2, 5), (None, 1)]]
    made = limits.rate_limited(spark.createDataFrame(rows, "user_id long, ts timestamp"), "user_id", 3600, 2)
    assert sorted((r["user_id"], r["n"], r["allowed"]) for r in made.collect()) == [(1, 1, True), (1, 1, True), (1, 2, True), (1, 3, False), (2, 1, True)]
