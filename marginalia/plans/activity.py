"""Queries on the event log: funnels, cohorts, streaks, counters, learner state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import dates, policy, safety
from marginalia.functions.math import familiarity, rnd
from marginalia.operators import analytics, learning, relational, sequences
from marginalia.plans.registry import query
from marginalia.sources.tables import table

STAGES = ["signup", "view", "click", "purchase"]
NOW = "2024-01-31"
TODAY = "2024-01-30"
WEEKS = 4


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _funnel_sql() -> str:
    flags = ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') AS s{i}" for i, s in enumerate(STAGES))
    sums = ", ".join(f"CAST(coalesce(sum(s{i}), 0) AS BIGINT) AS n{i}, count(*) FILTER (WHERE user_id IS NOT NULL AND {' AND '.join(f's{k} > 0' for k in range(i + 1))}) AS u{i}" for i in range(len(STAGES)))
    rows = []
    for i, s in enumerate(STAGES):
        first = f"CASE WHEN u0 > 0 THEN u0 WHEN u{i} > 0 THEN u{i} ELSE 1 END"
        before = f"CASE WHEN u{i - 1} <= 0 THEN 0.0 ELSE floor(CAST(u{i} AS DOUBLE) / u{i - 1} * 100 * 10 + 0.5) / 10 END" if i else "CAST(100.0 AS DOUBLE)"
        rows.append(f"SELECT {i + 1} AS stage, '{s}' AS name, n{i} AS events, u{i} AS users, {before} AS from_previous, floor(CAST(u{i} AS DOUBLE) / ({first}) * 100 * 10 + 0.5) / 10 AS from_start FROM t")
    return f"WITH f AS (SELECT user_id, {flags} FROM events GROUP BY user_id), t AS (SELECT {sums} FROM f) " + " UNION ALL ".join(rows)


@query(_funnel_sql())
def event_funnel(spark: SparkSession, d: str) -> DataFrame:
    return analytics.funnel(events(spark, d), STAGES)


@query("""
WITH f AS (SELECT user_id, bool_or(event_type = 'signup') AS su, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
r AS (SELECT 'activation' AS ratio, count(*) FILTER (WHERE su) AS base, count(*) FILTER (WHERE su AND v) AS converted FROM f
  UNION ALL SELECT 'completion', count(*) FILTER (WHERE v), count(*) FILTER (WHERE v AND p) FROM f
  UNION ALL SELECT 'study', count(*) FILTER (WHERE c), count(*) FILTER (WHERE c AND p) FROM f)
SELECT *, CASE WHEN base <= 0 THEN 0.0 ELSE floor(CAST(converted AS DOUBLE) / base * 100 * 10 + 0.5) / 10 END AS percent FROM r
""")
def conversion_ratios(spark: SparkSession, d: str) -> DataFrame:
    return analytics.conversions(events(spark, d), {"activation": ("signup", "view"), "completion": ("view", "purchase"), "study": ("click", "purchase")})


@query("""
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users,
  floor(CAST(count(*) AS DOUBLE) / count(DISTINCT user_id) * 100 + 0.5) / 100 AS per_user,
  floor(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) * 100 * 10 + 0.5) / 10 AS share
FROM events GROUP BY event_type
""")
def feature_usage(spark: SparkSession, d: str) -> DataFrame:
    return analytics.usage(events(spark, d))


@query(f"""
WITH w AS (SELECT DISTINCT user_id, date_diff('day', date_trunc('week', TIMESTAMP '{NOW}') - INTERVAL {7 * (WEEKS - 1)} DAY, date_trunc('week', ts)) // 7 AS i FROM events WHERE user_id IS NOT NULL),
s AS (SELECT * FROM w WHERE i BETWEEN 0 AND {WEEKS - 1}),
c AS (SELECT user_id, min(i) AS cohort FROM s GROUP BY user_id),
n AS (SELECT cohort, i, count(*) AS users FROM s JOIN c USING (user_id) GROUP BY cohort, i),
z AS (SELECT cohort, count(*) AS size FROM c GROUP BY cohort),
g AS (SELECT a.r AS cohort, b.r AS i FROM range({WEEKS}) a(r), range({WEEKS}) b(r) WHERE b.r >= a.r)
SELECT strftime(date_trunc('week', TIMESTAMP '{NOW}') - INTERVAL {7 * (WEEKS - 1)} DAY + CAST(g.cohort * 7 AS INTEGER) * INTERVAL 1 DAY, '%Y-%m-%d') AS cohort,
  coalesce(size, 0) AS size, CAST(g.i - g.cohort AS INTEGER) AS week, coalesce(users, 0) AS users,
  CASE WHEN coalesce(size, 0) = 0 THEN 0.0 ELSE floor(CAST(coalesce(users, 0) AS DOUBLE) / size * 100 * 10 + 0.5) / 10 END AS percent
FROM g LEFT JOIN n USING (cohort, i) LEFT JOIN z USING (cohort)
""")
def weekly_retention(spark: SparkSession, d: str) -> DataFrame:
    return analytics.retention(events(spark, d), NOW, WEEKS)


@query("""
WITH g AS (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 7 DAY)) AS day),
n AS (SELECT date_trunc('week', ts) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT strftime(g.day, '%G-W%V') AS week, coalesce(events, 0) AS events, coalesce(users, 0) AS users FROM g LEFT JOIN n ON CAST(g.day AS DATE) = CAST(n.day AS DATE)
""")
def iso_week_counts(spark: SparkSession, d: str) -> DataFrame:
    weeks = dates.calendar(spark, "2023-12-25", "2024-02-05", "7 day")
    found = events(spark, d).groupBy(dates.week_start("ts").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    return weeks.join(F.broadcast(found), "day", "left").select(dates.iso_week("day").alias("week"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("users", F.lit(0)).alias("users"))


@query("""
WITH g AS (SELECT CAST(a.r + 1 AS INTEGER) AS dow, CAST(b.r AS INTEGER) AS hour FROM range(7) a(r), range(24) b(r)),
n AS (SELECT dayofweek(ts) + 1 AS dow, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT dow, hour, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) <= 0 THEN 0 WHEN n <= 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 6 THEN 3 ELSE 4 END AS heat FROM g LEFT JOIN n USING (dow, hour)
""")
def activity_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return analytics.heatmap(events(spark, d))


@query(f"""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL),
i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
r AS (SELECT user_id, island, count(*) AS n, max(day) AS last FROM i GROUP BY 1, 2)
SELECT user_id, max(n) AS longest, coalesce(max(n) FILTER (WHERE last BETWEEN DATE '{TODAY}' - 1 AND DATE '{TODAY}'), 0) AS current, CAST(sum(n) AS BIGINT) AS days FROM r GROUP BY user_id
""")
def user_streaks(spark: SparkSession, d: str) -> DataFrame:
    return sequences.streaks(sequences.active_days(events(spark, d)), TODAY)


@query(f"""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL)
SELECT user_id, {" || ".join(f"max(CASE WHEN day = DATE '{TODAY}' - {i} THEN '1' ELSE '0' END)" for i in range(6, -1, -1))} AS flags FROM d GROUP BY user_id
""")
def last7_flags(spark: SparkSession, d: str) -> DataFrame:
    return sequences.last_days(sequences.active_days(events(spark, d)), TODAY)


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS p FROM events WHERE value IS NOT NULL),
m AS (SELECT user_id, avg(value) FILTER (WHERE p <= 5) AS recent, avg(value) FILTER (WHERE p > 5) AS prior, count(*) AS n FROM r WHERE p <= 10 GROUP BY user_id)
SELECT user_id, floor(recent * 10000 + 0.5) / 10000 AS recent, floor(prior * 10000 + 0.5) / 10000 AS prior,
  CASE WHEN n < 3 THEN 'insufficient' WHEN prior IS NULL OR prior = 0 THEN 'stable' WHEN (recent - prior) / prior >= 0.05 THEN 'improving' WHEN (recent - prior) / prior <= -0.05 THEN 'declining' ELSE 'stable' END AS trend
FROM m
""")
def recent_vs_prior_trend(spark: SparkSession, d: str) -> DataFrame:
    return sequences.recent_trend(events(spark, d), ["user_id"], [F.desc("ts"), F.col("event_id")], "value")


@query("""
SELECT user_id, event_id, event_type, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS position FROM events) WHERE position <= 3
""")
def last_n_per_user(spark: SparkSession, d: str) -> DataFrame:
    return sequences.newest(events(spark, d), ["user_id"], [F.desc("ts"), F.col("event_id")], 3).select("user_id", "event_id", "event_type", "position")


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1
""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return sequences.last_write(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("""
WITH n AS (SELECT user_id, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1, 2)
SELECT *, least(n, 2) AS accepted, greatest(n - 2, 0) AS rejected FROM n
""")
def tumbling_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rate_limit(events(spark, d), 21_600, 2, ["user_id"])


@query("""
WITH n AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN lag(window_start) OVER o = window_start - 3600 THEN lag(n) OVER o ELSE 0 END AS before FROM n WINDOW o AS (PARTITION BY event_type ORDER BY window_start))
SELECT event_type, window_start, n, before, before < 5 AS is_new FROM b WHERE n >= 5
""")
def spike_alerts(spark: SparkSession, d: str) -> DataFrame:
    return sequences.spikes(events(spark, d), 3600, 5, ["event_type"])


BOUNDS = [10.0, 25.0, 50.0, 100.0, 250.0]


@query(" UNION ALL ".join([f"SELECT event_type, '{b:g}' AS le, count(*) FILTER (WHERE value <= {b}) AS count FROM events GROUP BY event_type" for b in BOUNDS] + ["SELECT event_type, '+Inf' AS le, count(value) AS count FROM events GROUP BY event_type"]))
def histogram_buckets(spark: SparkSession, d: str) -> DataFrame:
    return analytics.histogram(events(spark, d), "value", BOUNDS, ["event_type"])


@query("""
WITH t AS (SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value <= 100) AS good FROM events GROUP BY event_type)
SELECT *, floor(CAST(good AS DOUBLE) / total * 10000 + 0.5) / 10000 AS fraction, CAST(good AS DOUBLE) / total >= 0.85 AS met,
  floor((1 - (1 - CAST(good AS DOUBLE) / total) / (1 - CAST(0.85 AS DOUBLE))) * 10000 + 0.5) / 10000 AS budget_left FROM t
""")
def slo_fraction(spark: SparkSession, d: str) -> DataFrame:
    return analytics.objective(events(spark, d), F.col("value") <= 100, 0.85, ["event_type"])


@query("""
SELECT user_id, max(value) AS progress, bool_or(event_type = 'purchase') AS completed, strftime(min(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS completed_at FROM events GROUP BY user_id
""")
def monotone_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress only rises, completion is never undone and keeps its first time."""
    done = F.col("event_type") == "purchase"
    return events(spark, d).groupBy("user_id").agg(F.max("value").alias("progress"), F.bool_or(done).alias("completed"), F.date_format(F.min(F.when(done, F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


_OUTCOME = "CASE event_type WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.35 WHEN 'click' THEN 0.75 ELSE 1.0 END"


@query(f"""
WITH r AS (SELECT user_id, CAST({_OUTCOME} AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, floor(sum(x * pow(0.7, back) * CASE WHEN back = n - 1 THEN 1.0 ELSE 0.3 END) * 1000000 + 0.5) / 1000000 AS confidence, count(*) AS evidence FROM r GROUP BY user_id
""")
def ewma_mastery(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "view", 0.35).when(F.col("event_type") == "click", 0.75).otherwise(1.0)
    return sequences.average_fold(events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], outcome)


@query("""
WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS i, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS BIGINT) AS reps FROM e
  UNION ALL SELECT user_id, rn, CASE WHEN q = 0 THEN 1 WHEN q = 3 THEN greatest(1, CAST(floor(step * CAST(0.6 AS DOUBLE) + 0.5) AS BIGINT)) ELSE step END, ease, reps
  FROM (SELECT user_id, rn, q, ease, CASE WHEN q = 0 THEN 0 ELSE reps + 1 END AS reps, CASE WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE CAST(floor(i * ease + 0.5) AS BIGINT) END AS step
    FROM (SELECT e.user_id, e.rn, e.q, f.i, f.reps, CASE WHEN e.q = 0 THEN greatest(CAST(1.3 AS DOUBLE), f.ease - CAST(0.2 AS DOUBLE)) ELSE greatest(CAST(1.3 AS DOUBLE), f.ease + CAST(0.1 AS DOUBLE) - (5 - e.q) * (CAST(0.08 AS DOUBLE) + (5 - e.q) * CAST(0.02 AS DOUBLE))) END AS ease
      FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)))
SELECT user_id, i AS interval_days, floor(ease * 10000 + 0.5) / 10000 AS ease, reps AS repetitions FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1
""")
def sm2_state(spark: SparkSession, d: str) -> DataFrame:
    """Spaced-repetition state of each user after all events as reviews."""
    grade = F.when(F.col("event_type") == "error", "again").when(F.col("event_type") == "view", "hard").when(F.col("event_type") == "click", "good").otherwise("easy")
    return learning.schedule(events(spark, d).withColumn("grade", grade), "user_id", ["ts", "event_id"], "grade").withColumn("ease", rnd("ease", 4))


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS exposures, count(*) FILTER (WHERE event_type IN ('click', 'error')) AS reviews, count(*) FILTER (WHERE event_type = 'click') AS correct FROM events GROUP BY user_id),
e AS (SELECT *, 1 - exp(-exposures / 4.0) AS e, least(1.0, reviews / 4.0) AS t FROM c)
SELECT user_id, exposures, reviews, floor((CASE WHEN reviews = 0 THEN 0.6 * e ELSE 0.6 * e * (1 - t) + CAST(correct AS DOUBLE) / greatest(reviews, 1) * t END) * 10000 + 0.5) / 10000 AS familiarity,
  floor((1 - exp(-(exposures + reviews) / 5.0)) * 10000 + 0.5) / 10000 AS sure FROM e
""")
def word_mastery(spark: SparkSession, d: str) -> DataFrame:
    from marginalia.functions.math import confidence

    counts = events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("exposures"), F.count_if(F.col("event_type").isin("click", "error")).alias("reviews"), F.count_if(F.col("event_type") == "click").alias("correct"))
    return counts.select("user_id", "exposures", "reviews", rnd(familiarity("exposures", "reviews", "correct"), 4).alias("familiarity"), rnd(confidence(F.col("exposures") + F.col("reviews")), 4).alias("sure"))


@query("""
SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS decile, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2
""")
def property_deciles(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, d).where(k.isNotNull()).groupBy("event_type", F.floor(k / 10).alias("decile")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, '1' AS version, 2 AS n FROM events
""")
def props_sanitised(spark: SparkSession, d: str) -> DataFrame:
    clean = safety.clean_properties("props")
    return events(spark, d).select("event_id", clean["k"].alias("k"), clean["_v"].alias("version"), F.size(clean).alias("n"))


@query("""
SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')
""")
def segment_intersection(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    joined = e.where((F.col("event_type") == "signup") & policy.half_open("ts", F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))
    return relational.intersect_keys(joined, e.where("event_type = 'purchase'"), "user_id")


@query("""
SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL AND ts >= TIMESTAMP '2024-01-29')
""")
def lapsed_users(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("user_id is not null")
    return relational.with_none(e.select("user_id").distinct(), e.where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")), ["user_id"])


@query("""
SELECT user_id, hour(ts) BETWEEN 7 AND 21 AS awake, count(*) AS n FROM events GROUP BY 1, 2
""")
def quiet_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events inside and outside of quiet hours from 22 to 7."""
    return events(spark, d).groupBy("user_id", (~dates.quiet(F.hour("ts"), F.lit(22), F.lit(7))).alias("awake")).agg(F.count("*").alias("n"))
