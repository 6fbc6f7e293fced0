"""Queries on a learner's log: shields, bounded lists, levels, weak areas, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import levels
from marginalia.functions.math import LEVELS, crawl_health, rnd, trend
from marginalia.operators import learning, lists, sequences
from marginalia.plans.registry import query
from marginalia.sources.tables import table

TODAY = "2024-01-30"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("""
WITH RECURSIVE d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL)),
f AS (SELECT user_id, day, rn, CAST(0 AS BIGINT) AS held, CAST(1 AS BIGINT) AS run, CAST(0 AS BIGINT) AS earned, CAST(0 AS BIGINT) AS spent FROM d WHERE rn = 1
  UNION ALL SELECT user_id, day, rn, CASE WHEN run >= 7 AND mid = 0 THEN 1 ELSE mid END, run, earned + CASE WHEN run >= 7 AND mid = 0 THEN 1 ELSE 0 END, spent
  FROM (SELECT d.user_id, d.day, d.rn, f.earned,
      CASE WHEN d.day - f.day = 2 AND f.held = 1 THEN f.run + 2 WHEN d.day - f.day = 1 THEN f.run + 1 ELSE 1 END AS run,
      CASE WHEN d.day - f.day = 2 AND f.held = 1 THEN 0 ELSE f.held END AS mid, f.spent + CASE WHEN d.day - f.day = 2 AND f.held = 1 THEN 1 ELSE 0 END AS spent
    FROM f JOIN d ON d.user_id = f.user_id AND d.rn = f.rn + 1))
SELECT user_id, held, run, earned, spent FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1
""")
def streak_shields(spark: SparkSession, d: str) -> DataFrame:
    """Shields earned and spent over each user's active days."""
    return lists.shields(sequences.active_days(events(spark, d)))


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error')
SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS history FROM r WHERE n <= 25 GROUP BY user_id
""")
def error_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 25 errors of each user, newest first."""
    made = lists.bounded(events(spark, d).where("event_type = 'error'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "event_id", 25, "history")
    return made.withColumn("history", F.array_join("history", ","))


@query("""
WITH k AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, max(ts) AS last FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, k) AS n FROM k)
SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY n) AS keys FROM r WHERE n <= 20 GROUP BY user_id
""")
def recently_used_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each user's 20 keys used last, each once."""
    rows = events(spark, d).where("user_id is not null").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return lists.recently_used(rows, ["user_id"], "k", "ts", 20, "keys").withColumn("keys", F.array_join("keys", ","))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
m AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS position FROM o WHERE before IS NULL OR before <> o_orderpriority)
SELECT o_custkey, o_orderkey, o_orderpriority, before, position FROM m WHERE position <= 100
""")
def level_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The orders at which a customer's priority changed, newest first, 100 at most."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return lists.changes(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", 100).select("o_custkey", "o_orderkey", "o_orderpriority", "before", "position")


@query("""
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS failed FROM events WHERE user_id IS NOT NULL),
k AS (SELECT user_id, max(event_id) FILTER (WHERE NOT failed) AS ok FROM e GROUP BY 1),
s AS (SELECT user_id, count(*) FILTER (WHERE failed AND (ok IS NULL OR event_id > ok)) AS failures, count(*) AS total, arg_max(failed, event_id) AS last_failed FROM e JOIN k USING (user_id) GROUP BY 1)
SELECT *, CASE WHEN failures >= 3 THEN 'failing' WHEN failures >= 1 OR last_failed THEN 'degraded' ELSE 'healthy' END AS health FROM s
""")
def crawl_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures in a row since the last success of each source, and its health."""
    rows = events(spark, d).where("user_id is not null")
    made = lists.failure_streaks(rows, ["user_id"], "event_id", F.col("event_type") == "error")
    return made.withColumn("health", crawl_health("failures", F.lit(0), F.when(F.col("last_failed"), "error")))


@query("""
WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
m AS (SELECT o_custkey, floor(avg(v) * 10000 + 0.5) / 10000 AS overall, count(*) AS n, floor(avg(v) FILTER (WHERE n <= 5) * 10000 + 0.5) / 10000 AS recent FROM r GROUP BY 1)
SELECT *, CASE WHEN recent - overall >= 10000 THEN 'improving' WHEN recent - overall <= -10000 THEN 'declining' ELSE 'stable' END AS trend FROM m
""")
def recent_against_all(spark: SparkSession, d: str) -> DataFrame:
    """The newest five values of each customer against all."""
    made = lists.recent_against_all(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice")
    return made.withColumn("trend", trend("recent", "overall", 10000.0))


@query("""
WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL),
f AS (SELECT user_id, rn, ts AS start, CAST(1 AS BIGINT) AS inside, CAST(1 AS BIGINT) AS windows, CAST(1 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS rejected FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.ts - f.start >= INTERVAL 1 DAY THEN e.ts ELSE f.start END, CASE WHEN e.ts - f.start >= INTERVAL 1 DAY THEN 1 ELSE f.inside + 1 END,
    f.windows + CASE WHEN e.ts - f.start >= INTERVAL 1 DAY THEN 1 ELSE 0 END,
    f.accepted + CASE WHEN e.ts - f.start >= INTERVAL 1 DAY OR f.inside < 3 THEN 1 ELSE 0 END, f.rejected + CASE WHEN e.ts - f.start >= INTERVAL 1 DAY OR f.inside < 3 THEN 0 ELSE 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, windows, accepted, rejected FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1
""")
def anchored_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Three events in each day-long window that begins with a user's first event after the last one."""
    return lists.anchored_windows(events(spark, d), "user_id", 86_400, 3)


@query("""
WITH RECURSIVE e AS (SELECT user_id, value / 400 AS x, least(0.8, 0.3 * greatest(0.0, least(5.0, value / 100))) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE user_id IS NOT NULL),
f AS (SELECT user_id, rn, x AS c FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, f.c * (1 - e.a) + e.x * e.a FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, floor(c * 1000000 + 0.5) / 1000000 AS confidence, rn AS evidence FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1
""")
def skill_average(spark: SparkSession, d: str) -> DataFrame:
    """A moving average whose step grows with the weight of each outcome."""
    return learning.average(events(spark, d), ["user_id"], ["event_id"], F.col("value") / 400, weight=F.col("value") / 100)


@query("""
WITH s AS (SELECT c_custkey, CAST(floor((c_acctbal + 1000) / 2000) AS INTEGER) % 6 AS rank, CAST((c_custkey * 37) % 101 AS DOUBLE) AS avg, CAST(c_custkey % 6 AS INTEGER) AS n, CAST(c_custkey % 4 AS INTEGER) AS done FROM customer),
v AS (SELECT *, CASE WHEN n >= 3 AND avg >= 85 AND rank < 5 THEN 'up' WHEN n >= 3 AND avg < 50 AND rank > 0 THEN 'down' ELSE 'hold' END AS suggestion FROM s)
SELECT c_custkey, suggestion, CASE suggestion WHEN 'up' THEN rank + 1 WHEN 'down' THEN rank - 1 ELSE rank END AS target,
  CASE suggestion WHEN 'up' THEN CASE WHEN done >= 2 THEN floor(least(1.0, (avg - 85) / 15 + 0.7) * 100 + 0.5) / 100 ELSE 0.6 END WHEN 'down' THEN floor(least(1.0, (50 - avg) / 30 + 0.55) * 100 + 0.5) / 100 ELSE 0.0 END AS confidence FROM v
""")
def quiz_level_change(spark: SparkSession, d: str) -> DataFrame:
    """A level up or down by the mean of quiz scores, with its confidence."""
    rank = (F.floor((F.col("c_acctbal") + 1000) / 2000).cast("int") % 6).alias("rank")
    rows = table(spark, d, "customer").select("c_custkey", rank, ((F.col("c_custkey") * 37) % 101).cast("double").alias("avg"), (F.col("c_custkey") % 6).cast("int").alias("n"), (F.col("c_custkey") % 4).cast("int").alias("done"))
    return levels.quiz_change(rows, "rank", "avg", "n", "done", least_attempts=3, least_done=2).select("c_custkey", "suggestion", "target", "confidence")


_SKILLS = ["click", "error", "purchase", "signup", "view"]


@query(f"""
WITH s AS (SELECT user_id, event_type AS skill, avg(value) / 150 AS confidence, count(*) AS evidence FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT user_id, count(*) AS skills, CAST(sum(evidence) AS BIGINT) AS evidence, avg(confidence) AS overall, count(*) FILTER (WHERE confidence < 0.4) AS weak,
  (arg_min(skill, struct_pack(c := confidence, i := list_position({_SKILLS}, skill)))) AS weakest, (arg_max(skill, struct_pack(c := confidence, i := -list_position({_SKILLS}, skill)))) AS strongest FROM s GROUP BY 1)
SELECT user_id, floor(overall * 10000 + 0.5) / 10000 AS overall, evidence, weakest, strongest,
  CASE WHEN skills < 3 OR evidence < 10 THEN 'hold' WHEN overall >= 0.7 AND weak = 0 THEN 'up' WHEN overall < 0.4 THEN 'down' ELSE 'hold' END AS suggestion FROM a
""")
def skill_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each user's mean confidence over the skills with evidence, the weakest and the strongest, and what level change they suggest."""
    skills = events(spark, d).where("user_id is not null").groupBy("user_id", F.col("event_type").alias("skill")).agg((F.avg("value") / 150).alias("confidence"), F.count("*").alias("evidence"))
    made = levels.skill_profile(skills, ["user_id"], _SKILLS, up=0.7, down=0.4, least_skills=3, least_evidence=10)
    return made.withColumn("overall", rnd("overall", 4)).select("user_id", "overall", "evidence", "weakest", "strongest", "suggestion")


@query("""
WITH v AS (SELECT c_mktsegment, count(*) FILTER (WHERE c_custkey % 3 = 0) AS easy, count(*) FILTER (WHERE c_custkey % 3 = 1) AS fine, count(*) FILTER (WHERE c_custkey % 3 = 2) AS hard FROM customer GROUP BY 1)
SELECT c_mktsegment, easy, fine, hard, CAST(easy - hard AS DOUBLE) / (easy + fine + hard) AS bias FROM v
""")
def feedback_bias(spark: SparkSession, d: str) -> DataFrame:
    """Votes too easy, just right and too hard, and their bias between -1 and 1."""
    kind = F.col("c_custkey") % 3
    votes = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(kind == 0).alias("easy"), F.count_if(kind == 1).alias("fine"), F.count_if(kind == 2).alias("hard"))
    return votes.withColumn("bias", levels.feedback_bias("easy", "fine", "hard"))


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL),
i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
r AS (SELECT user_id, count(*) AS n, max(day) AS last FROM i GROUP BY user_id, island),
k AS (SELECT user_id, max(n) AS longest, coalesce(max(n) FILTER (WHERE last BETWEEN DATE '2024-01-29' AND DATE '2024-01-30'), 0) AS current FROM r GROUP BY 1),
t AS (SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'view') AS started, floor(sum(value) * 100 + 0.5) / 100 AS total,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23') AS week, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-23') AS week_before FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT t.*, CASE WHEN week - week_before >= 1 THEN 'improving' WHEN week - week_before <= -1 THEN 'declining' ELSE 'stable' END AS trend, longest, current FROM t JOIN k USING (user_id)
""")
def learner_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A learner's totals, week against week before, and streaks, from one pass for the sums and one for the days."""
    rows = events(spark, d).where("user_id is not null")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    week, before = F.col("ts") >= at("2024-01-23"), (F.col("ts") >= at("2024-01-16")) & (F.col("ts") < at("2024-01-23"))
    sums = rows.groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "view").alias("started"),
        rnd(F.sum("value"), 2).alias("total"), F.count_if(week).alias("week"), F.count_if(before).alias("week_before"),
    )
    streak = sequences.streaks(sequences.active_days(rows), TODAY).select("user_id", "longest", "current")
    return sums.withColumn("trend", trend("week", "week_before", 1)).join(streak, "user_id")


@query("""
WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS weak, count(*) FILTER (WHERE event_type = 'click') AS due, count(*) AS saved, avg(value) FILTER (WHERE event_type = 'purchase') AS quiz, avg(value) FILTER (WHERE event_type = 'view') AS spoken FROM events WHERE user_id IS NOT NULL GROUP BY 1),
a AS (SELECT user_id, 'vocabulary' AS area, greatest(CAST(weak AS DOUBLE) / saved, CASE WHEN due > 0 THEN 0.4 ELSE 0.0 END) AS severity FROM s WHERE weak > 0 OR due > 0
  UNION ALL SELECT user_id, 'comprehension', (70 - quiz) / 70 FROM s WHERE quiz < 70
  UNION ALL SELECT user_id, 'pronunciation', (75 - spoken) / 75 FROM s WHERE spoken < 75),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY severity DESC, area) AS INTEGER) AS position FROM a)
SELECT user_id, area, floor(severity * 10000 + 0.5) / 10000 AS severity, position FROM r WHERE position <= 6
""")
def weak_areas(spark: SparkSession, d: str) -> DataFrame:
    """Ten counts and means of each learner in one pass, the weak areas that they show, and the six worst."""
    kind = lambda k: F.col("event_type") == k
    sums = events(spark, d).where("user_id is not null").groupBy("user_id").agg(
        F.count_if(kind("error")).alias("weak"), F.count_if(kind("click")).alias("due"), F.count("*").alias("saved"),
        F.avg(F.when(kind("purchase"), F.col("value"))).alias("quiz"), F.avg(F.when(kind("view"), F.col("value"))).alias("spoken"),
    )
    areas = levels.weak_areas(sums, weak="weak", due="due", saved="saved", quiz="quiz", spoken="spoken")
    return sequences.newest(areas, ["user_id"], [F.desc("severity"), F.col("area")], 6).select("user_id", "area", rnd("severity", 4).alias("severity"), "position")


@query(f"""
WITH c AS (SELECT c_custkey, {list(LEVELS)}[CAST(c_custkey % 7 AS INTEGER) + 1] AS level, {list(LEVELS)}[CAST(c_nationkey % 6 AS INTEGER) + 1] AS reader FROM customer),
r AS (SELECT *, CASE WHEN level IS NULL THEN NULL ELSE list_position({list(LEVELS)}, level) - 1 END AS rank, list_position({list(LEVELS)}, reader) - 1 AS most FROM c)
SELECT c_custkey, level, CAST(row_number() OVER (ORDER BY coalesce(rank, 99), c_custkey) AS INTEGER) AS position FROM r WHERE rank IS NULL OR rank <= most QUALIFY position <= 200
""")
def at_or_below_level(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a level that isn't above the reader's, by level; unknown levels come last."""
    pick = lambda i: F.get(F.array(*map(F.lit, LEVELS)), i.cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", pick(F.col("c_custkey") % 7).alias("level"), pick(F.col("c_nationkey") % 6).alias("reader"))
    kept = rows.where(levels.at_or_below("level", "reader"))
    order = [levels.sort_rank("level"), F.col("c_custkey")]
    return sequences.newest(kept.withColumn("_all", F.lit(1)), ["_all"], order, 200).select("c_custkey", "level", "position")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'view' AND value < 40) AS weak_words, count(*) FILTER (WHERE event_type = 'click' AND (value IS NULL OR ts <= TIMESTAMP '2024-01-20')) AS due_words,
  count(*) FILTER (WHERE event_type = 'click') AS saved_words, count(*) FILTER (WHERE event_type = 'signup' AND value < 50) AS low_articles, count(*) FILTER (WHERE event_type = 'signup') AS assessed_articles,
  floor(avg(value) FILTER (WHERE event_type = 'purchase') * 100 + 0.5) / 100 AS quiz_average, count(*) FILTER (WHERE event_type = 'purchase') AS quiz_attempts,
  floor(avg(value) FILTER (WHERE event_type = 'error') * 100 + 0.5) / 100 AS spoken_average, count(*) FILTER (WHERE event_type = 'error') AS spoken_attempts FROM events WHERE user_id IS NOT NULL GROUP BY 1
""")
def study_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What a study plan needs to know of each learner: words, articles, quizzes and speech, all from one conditional pass. Averages without an attempt are null."""
    kind, value = F.col("event_type"), F.col("value")
    of = lambda k: F.when(kind == k, value)
    due = value.isNull() | (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    return events(spark, d).where("user_id is not null").groupBy("user_id").agg(
        F.count_if((kind == "view") & (value < 40)).alias("weak_words"), F.count_if((kind == "click") & due).alias("due_words"), F.count_if(kind == "click").alias("saved_words"),
        F.count_if((kind == "signup") & (value < 50)).alias("low_articles"), F.count_if(kind == "signup").alias("assessed_articles"),
        rnd(F.avg(of("purchase")), 2).alias("quiz_average"), F.count_if(kind == "purchase").alias("quiz_attempts"), rnd(F.avg(of("error")), 2).alias("spoken_average"), F.count_if(kind == "error").alias("spoken_attempts"),
    )
