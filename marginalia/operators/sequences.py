"""Operators on ordered rows of a key: streaks, latest rows, trends, budgets, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.dates import window_start
from marginalia.functions.math import rnd
from marginalia.operators.learning import fold


def active_days(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.where(F.col(user).isNotNull()).select(user, F.to_date(ts).alias("day")).distinct()


def streaks(days: DataFrame, today: str, user: str = "user_id") -> DataFrame:
    """longest and current run of consecutive days; the current one ends today or yesterday. days: user, day, each once."""
    order = Window.partitionBy(user).orderBy("day")
    islands = days.withColumn("island", F.date_sub("day", F.row_number().over(order)))
    runs = islands.groupBy(user, "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    now = F.lit(today).cast("date")
    return runs.groupBy(user).agg(F.max("n").alias("longest"), F.coalesce(F.max(F.when(F.col("last").between(F.date_sub(now, 1), now), F.col("n"))), F.lit(0)).alias("current"), F.sum("n").alias("days"))


def last_days(days: DataFrame, today: str, n: int = 7, user: str = "user_id") -> DataFrame:
    """flags: n characters 0 or 1, oldest first, ending today; for every user that has a day at all."""
    now = F.lit(today).cast("date")
    marks = [F.max(F.when(F.col("day") == F.date_sub(now, i), "1").otherwise("0")) for i in range(n - 1, -1, -1)]
    return days.groupBy(user).agg(F.concat(*marks).alias("flags"))


def newest(df: DataFrame, by: list[str], order: list, n: int = 1, rank: str = "position") -> DataFrame:
    """The first n rows of each key; order must be total. Spark cuts each partition to n rows a key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def last_write(df: DataFrame, by: list[str], version: list[str], columns: list[str]) -> DataFrame:
    """The columns of the greatest version of each key, combined on the map side: no sort, no window."""
    top = df.groupBy(*by).agg(F.max(F.struct(*version, *[c for c in columns if c not in version])).alias("_top"))
    return top.select(*by, *[F.col(f"_top.{c}").alias(c) for c in columns])


def recent_trend(df: DataFrame, by: list[str], order: list, value: str, size: int = 5, band: float = 0.05) -> DataFrame:
    """Mean of the newest `size` values against that of the `size` before; relative change beyond band tells the trend."""
    cut = newest(df.where(F.col(value).isNotNull()), by, order, 2 * size)
    means = cut.groupBy(*by).agg(F.avg(F.when(F.col("position") <= size, F.col(value))).alias("recent"), F.avg(F.when(F.col("position") > size, F.col(value))).alias("prior"), F.count("*").alias("n"))
    change = (F.col("recent") - F.col("prior")) / F.col("prior")
    label = F.when(F.col("n") < 3, "insufficient").when(F.col("prior").isNull() | (F.col("prior") == 0), "stable").when(change >= band, "improving").when(change <= -band, "declining").otherwise("stable")
    return means.select(*by, rnd("recent", 4).alias("recent"), rnd("prior", 4).alias("prior"), label.alias("trend"))


def rate_limit(events: DataFrame, seconds: int, limit: int, by: list[str], ts: str = "ts") -> DataFrame:
    """Fixed windows from the epoch: window_start (seconds), n, accepted, rejected."""
    n = events.groupBy(*by, window_start(ts, seconds).alias("window_start")).agg(F.count("*").alias("n"))
    return n.withColumn("accepted", F.least("n", F.lit(limit))).withColumn("rejected", F.greatest(F.col("n") - limit, F.lit(0)))


def spikes(events: DataFrame, seconds: int, threshold: int, by: list[str], ts: str = "ts") -> DataFrame:
    """Windows whose count reaches the threshold, marked new where the window before didn't."""
    n = events.groupBy(*by, window_start(ts, seconds).alias("window_start")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("window_start")
    before = F.when(F.lag("window_start").over(order) == F.col("window_start") - seconds, F.lag("n").over(order)).otherwise(0)
    return n.withColumn("before", before).where(F.col("n") >= threshold).withColumn("is_new", F.col("before") < threshold)


def budgeted(df: DataFrame, by: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """The leading rows of each key whose running cost stays within the budget."""
    total = F.sum("_cost").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_cost", cost).withColumn("spent", total).where(F.col("spent") <= budget).drop("_cost")


def diversify(df: DataFrame, by: list[str], score: str, category: str, tie: str, step: float = 6.0, most: float = 18.0) -> DataFrame:
    """effective: the score less a penalty for each better row of the category before it; rows without a category pay none."""
    nth = F.row_number().over(Window.partitionBy(*by, category).orderBy(F.desc(score), tie)) - 1
    penalty = F.when(F.coalesce(category, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(most), step * nth))
    return df.withColumn("effective", F.col(score) - penalty)


def average_fold(df: DataFrame, by: list[str], newest_first: list, outcome: Column, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average of outcomes, the oldest one taken whole. Rows stream through newest first with falling weights, so a hot key is neither ranked nor buffered."""
    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)

    def step(state: tuple, x: float) -> tuple:
        total, weight, last, n = state
        return total + last * weight * alpha if n else 0.0, weight * (1 - alpha) if n else 1.0, x, n + 1

    rows = df.withColumn("_x", outcome.cast("double"))
    made = fold(rows, by, newest_first, lambda: (0.0, 1.0, 0.0, 0), step, ["_x"], f"{kinds}total double, weight double, last double, evidence long")
    return made.select(*by, rnd(F.col("total") + F.col("last") * F.col("weight"), 6).alias("confidence"), "evidence")
