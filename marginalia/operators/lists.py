"""Bounded lists, runs and merges of a key's ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.math import rnd
from marginalia.operators.learning import fold
from marginalia.operators.sequences import newest


def bounded(df: DataFrame, by: list[str], newest_first: list[Column], column: str, most: int, alias: str) -> DataFrame:
    """The newest `most` values of each key as an array, newest first; each task cuts its keys before the shuffle."""
    cut = newest(df, by, newest_first, most)
    return cut.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", column))), lambda x: x[column]).alias(alias))


def recently_used(df: DataFrame, by: list[str], item: str, ts: str, most: int, alias: str) -> DataFrame:
    """Move to front: each key's distinct items by last use, newest first, at most `most`; ties by item."""
    last = df.groupBy(*by, item).agg(F.max(ts).alias("_last"))
    return bounded(last, by, [F.desc("_last"), F.col(item)], item, most, alias)


def shields(days: DataFrame, user: str = "user_id", need: int = 7) -> DataFrame:
    """Shields over each user's active days (user, day; each once): earned after `need` active days in a row while none is held, spent to fill one missed day."""
    kind = days.schema[user].dataType.simpleString()
    rows = days.select(user, F.unix_date("day").alias("_day"))

    def step(state: tuple, day: int) -> tuple:
        held, run, last, earned, spent = state
        gap = day - last
        if gap == 2 and held:
            held, run, spent = 0, run + 2, spent + 1
        else:
            run = run + 1 if gap == 1 else 1
        if run >= need and not held:
            held, earned = 1, earned + 1
        return held, run, day, earned, spent

    made = fold(rows, user, ["_day"], lambda: (0, 0, -10, 0, 0), step, ["_day"], f"{user} {kind}, held long, run long, last long, earned long, spent long")
    return made.select(user, "held", "run", "earned", "spent")


def changes(df: DataFrame, by: list[str], order: list, value: str, most: int) -> DataFrame:
    """The rows at which a key's value differs from the one before, newest first, at most `most`; with before and position."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    moved = df.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(value)))
    return newest(moved, by, [F.desc(c) for c in order], most)


def failure_streaks(df: DataFrame, by: list[str], order: str, failed: Column) -> DataFrame:
    """failures: rows since a key's last success; total and last_failed. The last success is an aggregate, so no key is sorted."""
    rows = df.select(*by, F.col(order).alias("_at"), F.coalesce(failed, F.lit(False)).alias("_failed"))
    ok = rows.groupBy(*by).agg(F.max(F.when(~F.col("_failed"), F.col("_at"))).alias("_ok"))
    after = F.col("_failed") & (F.col("_ok").isNull() | (F.col("_at") > F.col("_ok")))
    return rows.join(ok, by).groupBy(*by).agg(F.count_if(after).alias("failures"), F.count("*").alias("total"), F.max_by("_failed", "_at").alias("last_failed"))


def recent_against_all(df: DataFrame, by: list[str], newest_first: list[Column], value: str, size: int = 5) -> DataFrame:
    """Mean of the newest `size` values of each key beside the mean of all."""
    every = df.where(F.col(value).isNotNull()).groupBy(*by).agg(rnd(F.avg(value), 4).alias("overall"), F.count("*").alias("n"))
    head = newest(df.where(F.col(value).isNotNull()), by, newest_first, size).groupBy(*by).agg(rnd(F.avg(value), 4).alias("recent"))
    return every.join(head, by)


def anchored_windows(df: DataFrame, key: str, seconds: int, limit: int, ts: str = "ts") -> DataFrame:
    """Windows that begin with the first event after the last window's end: key, windows, accepted (up to `limit` in each), rejected."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))

    def step(state: tuple, at: int) -> tuple:
        start, inside, windows, accepted, rejected = state
        if windows == 0 or at - start >= seconds * 1_000_000:
            start, inside, windows = at, 0, windows + 1
        ok = inside < limit
        return start, inside + 1, windows, accepted + ok, rejected + (not ok)

    made = fold(rows, key, ["_at"], lambda: (0, 0, 0, 0, 0), step, ["_at"], f"{key} {kind}, start long, inside long, windows long, accepted long, rejected long")
    return made.select(key, "windows", "accepted", "rejected")


def stable_partition(df: DataFrame, first: Column, order: list, n: int) -> DataFrame:
    """The head of a listing with the rows that match first, each part in its order; with position."""
    head = df.withColumn("_match", F.coalesce(first, F.lit(False))).orderBy(F.desc("_match"), *order).limit(n)
    return head.withColumn("position", F.row_number().over(Window.orderBy(F.desc("_match"), *order))).drop("_match")


def spread(rows: Column, kind: str, category: str, most: int = 3, first: int | None = None) -> Column:
    """An ordered array of rows (of type `kind`) so that no more than `most` of a category follow each other; those that would go to the tail, in order. With `first`, only so many of the result are kept at any time.

    Rows without a category are never moved, and rows that are moved don't end a run.
    """
    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast(kind).alias("late"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"))
    room = lambda c: F.lit(True) if first is None else F.size(c) < first

    def step(state: Column, row: Column) -> Column:
        name = row[category].cast("string")
        same = name.eqNullSafe(state["last"])
        over = name.isNotNull() & same & (state["run"] >= most)
        return F.struct(
            F.when(~over & room(state["kept"]), F.concat(state["kept"], F.array(row))).otherwise(state["kept"]).alias("kept"),
            F.when(over & room(state["late"]), F.concat(state["late"], F.array(row))).otherwise(state["late"]).alias("late"),
            F.when(over, state["last"]).otherwise(name).alias("last"),
            F.when(over, state["run"]).when(same, state["run"] + 1).otherwise(1).alias("run"),
        )

    whole = lambda s: F.concat(s["kept"], s["late"])
    return F.aggregate(rows, start, step, whole if first is None else lambda s: F.slice(whole(s), 1, first))


def spread_runs(df: DataFrame, by: list[str], order: list, category: str, most: int = 3) -> DataFrame:
    """A listing in which no more than `most` rows of a category follow each other (see spread). place: the new position in the key's list.

    The lists are short heads of a ranking, so each is one array that is folded inside the JVM.
    """
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    lists = df.withColumn("_at", position).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", *[c for c in df.columns if c not in by]))).alias("_rows"))
    done = lists.select(*by, spread(F.col("_rows"), lists.schema["_rows"].dataType.simpleString(), category, most).alias("_rows"))
    return done.select(*by, F.posexplode("_rows").alias("_place", "_row")).select(*by, (F.col("_place") + 1).alias("place"), "_row.*").drop("_at")
