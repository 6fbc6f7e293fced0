"""Product analytics: funnels, ratios, cohorts, calendars, histograms. Each groups once and pre-aggregates before it shuffles."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.dates import week_start
from marginalia.functions.math import heat, percentage, rnd


def user_stages(events: DataFrame, stages: list[str], user: str = "user_id", kind: str = "event_type") -> DataFrame:
    """One row a user (null users are one row) with the number of events of each stage, columns s0, s1, ..."""
    return events.groupBy(user).agg(*[F.count_if(F.col(kind) == s).alias(f"s{i}") for i, s in enumerate(stages)])


def funnel(events: DataFrame, stages: list[str], user: str = "user_id", kind: str = "event_type") -> DataFrame:
    """stage, name, events, users, from_previous, from_start. users did every stage so far, in any order; null users count as events only."""
    known = F.col(user).isNotNull()
    did = [F.col(f"s{i}") > 0 for i in range(len(stages))]
    sums = user_stages(events, stages, user, kind).agg(
        *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(stages))],
        *[F.count_if(reduce(and_, did[: i + 1], known)).alias(f"u{i}") for i in range(len(stages))],
    )
    rows = []
    for i, s in enumerate(stages):
        first = F.when(F.col("u0") > 0, F.col("u0")).when(F.col(f"u{i}") > 0, F.col(f"u{i}")).otherwise(1)
        rows.append(F.struct(F.lit(i + 1).alias("stage"), F.lit(s).alias("name"), F.col(f"n{i}").alias("events"), F.col(f"u{i}").alias("users"), (percentage(f"u{i}", f"u{i - 1}") if i else F.lit(100.0)).alias("from_previous"), percentage(F.col(f"u{i}"), first).alias("from_start")))
    return sums.select(F.inline(F.array(*rows)))


def conversions(events: DataFrame, ratios: dict[str, tuple[str, str]], user: str = "user_id", kind: str = "event_type") -> DataFrame:
    """ratio, base, converted, percent: of the users who did the first kind, those who did the second too."""
    kinds = sorted({k for pair in ratios.values() for k in pair})
    did = {k: F.col(f"s{i}") > 0 for i, k in enumerate(kinds)}
    flags = user_stages(events.where(F.col(user).isNotNull()), kinds, user, kind)
    sums = flags.agg(*[F.count_if(did[a]).alias(f"{name}_base") for name, (a, _) in ratios.items()], *[F.count_if(did[a] & did[b]).alias(f"{name}_both") for name, (a, b) in ratios.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(f"{n}_base").alias("base"), F.col(f"{n}_both").alias("converted"), percentage(f"{n}_both", f"{n}_base").alias("percent")) for n in ratios])))


def usage(events: DataFrame, kind: str = "event_type", user: str = "user_id") -> DataFrame:
    """For each kind its events, users, events a user and share of all events."""
    per_user = events.groupBy(kind, user).agg(F.count("*").alias("n"))
    per_kind = per_user.groupBy(kind).agg(F.sum("n").alias("events"), F.count(user).alias("users"))
    total = F.sum("events").over(Window.partitionBy(F.lit(0)))  # one row a kind
    return per_kind.withColumn("total", total).select(kind, "events", "users", F.when(F.col("users") > 0, rnd(F.col("events") / F.col("users"), 2)).otherwise(0.0).alias("per_user"), percentage("events", "total").alias("share"))


def retention(events: DataFrame, now: str, weeks: int = 8, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """cohort, size, week, users, percent for each cohort (first week in the window) and each later week, zeros included."""
    weeks = max(1, min(52, weeks))
    this = week_start(F.lit(now).cast("timestamp"))
    index = F.floor(F.datediff(week_start(ts), F.date_sub(this, 7 * (weeks - 1))) / 7).cast("int")
    seen = events.where(F.col(user).isNotNull()).select(user, index.alias("i")).where((F.col("i") >= 0) & (F.col("i") < weeks))
    users = seen.groupBy(user).agg(F.collect_set("i").alias("all"), F.min("i").alias("cohort"))  # at most 52 numbers
    held = users.select("cohort", F.explode("all").alias("i")).groupBy("cohort", "i").agg(F.count("*").alias("users"))
    grid = events.sparkSession.range(weeks).select(F.col("id").cast("int").alias("cohort")).select("cohort", F.explode(F.sequence("cohort", F.lit(weeks - 1))).alias("i"))
    size = users.groupBy("cohort").agg(F.count("*").alias("size"))
    full = grid.join(held, ["cohort", "i"], "left").join(size, "cohort", "left")
    n, of = F.coalesce("users", F.lit(0)), F.coalesce("size", F.lit(0))
    start = F.date_add(F.date_sub(this, 7 * (weeks - 1)), F.col("cohort") * 7)
    return full.select(start.cast("string").alias("cohort"), of.alias("size"), (F.col("i") - F.col("cohort")).alias("week"), n.alias("users"), percentage(n, of).alias("percent"))


def zero_fill(rows: DataFrame, registry: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of the registry, with 0 where rows have none."""
    return registry.join(rows.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def heatmap(events: DataFrame, ts: str = "ts") -> DataFrame:
    """dow (1 = Sunday), hour, n and heat 0 to 4 for all 168 cells."""
    grid = events.sparkSession.range(168).select((F.floor(F.col("id") / 24) + 1).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    found = events.groupBy(F.dayofweek(ts).alias("dow"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(found), ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("n"), heat(F.coalesce("n", F.lit(0))).alias("heat"))


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative buckets by key: le (+Inf last), count; one pass, counted before the shuffle."""
    sums = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count"))]
    return sums.select(*by, F.inline(F.array(*rows)))


def objective(df: DataFrame, good: Column, target: float, by: list[str]) -> DataFrame:
    """Share of good rows against a target: total, good, fraction, met, budget_left."""
    sums = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(good).alias("good"))
    share = F.col("good") / F.col("total")
    return sums.select(*by, "total", "good", rnd(share, 4).alias("fraction"), (share >= target).alias("met"), rnd(1 - (1 - share) / (1 - target), 4).alias("budget_left"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of known column values as columns: no pass to find them."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))


def running(df: DataFrame, by: list[str], order: list, value: str, alias: str) -> DataFrame:
    return df.withColumn(alias, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_buckets(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """A row for each key and bound, the last one without a bound (le null): how many values don't exceed it. One pass, one row a key before the rows are laid out."""
    n = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(value).alias("_all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("n")))
    return n.select(*by, F.explode(rows).alias("_b")).select(*by, "_b.le", "_b.n")


def fraction_under(buckets: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """From cumulative buckets: total, fast (the count of the largest bound up to the threshold; 0 if there is none) and their ratio."""
    made = buckets.groupBy(*by).agg(F.max("n").alias("total"), F.coalesce(F.max(F.when(F.col("le") <= threshold, F.col("n"))), F.lit(0)).alias("fast"))
    return made.withColumn("fraction", F.when(F.col("total") > 0, rnd(F.col("fast") / F.col("total"), 4)).otherwise(1.0))


def hit_ratio(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """hits, misses and the percentage of hits."""
    n = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return n.withColumn("ratio", percentage(F.col("hits"), F.col("hits") + F.col("misses")))


def pass_rates(cases: DataFrame, by: str) -> DataFrame:
    """cases: one row each with passed and checks. Counts and pass rate by feature and of all."""
    made = cases.groupingSets([[F.col(by)], []], F.col(by)).agg(F.count("*").alias("cases"), F.sum("checks").alias("checks"), F.count_if("passed").alias("passed"))
    return made.select(F.coalesce(by, F.lit("all")).alias(by), "cases", "checks", "passed", percentage("passed", "cases").alias("rate"))


def summary_by(df: DataFrame, dimensions: list[str], sums: list[str], flags: dict[str, Column]) -> DataFrame:
    """Totals of everything and by each dimension alone, in one pass: dimension ("total" for all), key, count, the sums, and counts of the rows that each flag holds for. Null keys are "unknown"; an empty table gives no rows."""
    rows = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dimensions], *sums, *[c.alias(f"_{k}") for k, c in flags.items()])
    made = rows.groupingSets([[], *[[d] for d in dimensions]], *dimensions).agg(F.grouping_id(*dimensions).alias("_g"), F.count("*").alias("count"), *[F.sum(c).alias(c) for c in sums], *[F.count_if(f"_{k}").alias(k) for k in flags])
    n = len(dimensions)
    which = reduce(lambda w, i: w.when(F.col("_g") == (1 << n) - 1 - (1 << n - 1 - i), dimensions[i]), range(1, n), F.when(F.col("_g") == (1 << n) - 1 - (1 << n - 1), dimensions[0])).otherwise("total")
    return made.select(which.alias("dimension"), F.coalesce(*dimensions, F.lit("")).alias("key"), "count", *sums, *flags)
