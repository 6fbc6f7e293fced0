"""Queries on queues, budgets, metrics, listings and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import arrays, policy
from marginalia.operators import analytics, jobs, lists, relational, sequences
from marginalia.plans.registry import query
from marginalia.sources.tables import table

NOW = "1998-08-01"
_JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS key, o_orderpriority AS type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
  o_orderdate AS locked_at, CAST(o_orderkey % 5 AS INTEGER) AS attempts, 5 AS max_attempts, o_totalprice AS price FROM orders)"""


def queue(spark: SparkSession, d: str) -> DataFrame:
    """The orders as jobs."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("type"), status.alias("status"), F.col("o_orderdate").alias("locked_at"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), F.col("o_totalprice").alias("price"),
    )


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(f"""
WITH {_JOBS}, s AS (SELECT *, status = 'processing' AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 600 SECOND AS stuck FROM jobs)
SELECT 'status' AS view, status AS key, count(*) AS n, count(*) FILTER (WHERE stuck) AS stuck FROM s GROUP BY 2
UNION ALL SELECT 'type', type, count(*), count(*) FILTER (WHERE stuck) FROM s GROUP BY 2 UNION ALL SELECT 'all', '', count(*), count(*) FILTER (WHERE stuck) FROM s
""")
def job_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by status, by type and in all, and how many of them are stuck."""
    return jobs.dashboard(queue(spark, d), at(NOW))


@query(f"""
WITH {_JOBS}, f AS (SELECT id, attempts + 1 AS attempts, price > 400000 OR attempts + 1 >= max_attempts AS dead FROM jobs WHERE status = 'processing')
SELECT id, attempts, CASE WHEN dead THEN 'dead_letter' ELSE 'failed' END AS status, CASE WHEN NOT dead THEN CAST(least(60000.0, 1000 * pow(2, attempts - 1) + 0.5 * least(1000.0, 1000 * pow(2, attempts - 1))) AS BIGINT) END AS wait_ms FROM f
""")
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Jobs in flight after they have failed: retried with growing waits, or given up."""
    running = queue(spark, d).where("status = 'processing'")
    done = jobs.failed(running, F.lit(NOW).cast("timestamp"), F.col("price") > 400_000, jitter=0.5)
    wait = F.floor((F.unix_micros("run_after") - F.unix_micros(F.lit(NOW).cast("timestamp"))) / 1000)
    return done.select("id", "attempts", "status", wait.alias("wait_ms"))


@query(f"""
WITH {_JOBS}, r AS (SELECT c_custkey AS key, count(*) AS requests FROM customer GROUP BY 1), s AS (SELECT key, bool_or(status <> 'completed') AS active FROM jobs GROUP BY 1)
SELECT r.key, r.requests, CASE WHEN active THEN 'return' WHEN active IS NOT NULL THEN 'reset' ELSE 'create' END AS action FROM r LEFT JOIN s USING (key)
""")
def enqueue_actions(spark: SparkSession, d: str) -> DataFrame:
    """What a request for each key does to the queue."""
    return jobs.enqueue(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), queue(spark, d), "key")


@query(f"""
WITH {_JOBS}, r AS (SELECT id, type, status, row_number() OVER (ORDER BY type, locked_at, id) AS position FROM jobs WHERE status = 'pending' OR (status = 'processing' AND locked_at < TIMESTAMP '1998-07-01' - INTERVAL 600 SECOND))
SELECT id, type, status, CAST(position AS INTEGER) AS position FROM r WHERE position <= 40
""")
def job_claims(spark: SparkSession, d: str) -> DataFrame:
    """The next 40 jobs, by priority and age; those whose lease has run out may be taken over."""
    ready = (F.col("status") == "pending") | jobs.stuck(at("1998-07-01"))
    return relational.claim(queue(spark, d), ready, [F.col("type"), F.col("locked_at"), F.col("id")], 40).select("id", "type", "status", "position")


@query("""
WITH s AS (SELECT o_custkey, unnest(['audio', 'quiz', 'level', 'words']) AS step FROM (SELECT DISTINCT c_custkey AS o_custkey FROM customer)),
d AS (SELECT DISTINCT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'audio' WHEN '2-HIGH' THEN 'quiz' WHEN '3-MEDIUM' THEN 'level' ELSE 'words' END AS step FROM orders WHERE o_orderstatus = 'F'),
a AS (SELECT DISTINCT o_custkey, 'quiz' AS step FROM orders WHERE o_orderstatus = 'P')
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.o_custkey = s.o_custkey AND d.step = s.step) AND NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = s.o_custkey AND a.step = s.step)
""")
def backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    """The steps that each item lacks and that aren't queued yet."""
    o = table(spark, d, "orders")
    step = F.when(F.col("o_orderpriority") == "1-URGENT", "audio").when(F.col("o_orderpriority") == "2-HIGH", "quiz").when(F.col("o_orderpriority") == "3-MEDIUM", "level").otherwise("words")
    done = o.where("o_orderstatus = 'F'").select("o_custkey", step.alias("step"))
    active = o.where("o_orderstatus = 'P'").select("o_custkey", F.lit("quiz").alias("step"))
    return jobs.missing_steps(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), done, ["audio", "quiz", "level", "words"], "o_custkey", active)


@query("""
WITH l AS (SELECT user_id, event_type AS step, arg_max(CASE WHEN value > 100 THEN 'failed' ELSE 'done' END, event_id) AS outcome FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT user_id, count(*) FILTER (WHERE outcome = 'done') AS done, count(*) FILTER (WHERE outcome = 'failed') AS failed, list(step) FILTER (WHERE outcome = 'done') AS names FROM l GROUP BY 1),
n AS (SELECT *, list_filter(['signup', 'view', 'click', 'purchase'], lambda x: NOT list_contains(coalesce(names, []), x)) AS todo FROM s)
SELECT user_id, CAST(done AS INTEGER) AS done, CAST(failed AS INTEGER) AS failed, todo[1] AS next_step, len(todo) = 0 AND failed = 0 AS publish FROM n
""")
def pipeline_steps(spark: SparkSession, d: str) -> DataFrame:
    """Where each item stands in its steps, and whether it may be published."""
    runs = table(spark, d, "events").where("user_id is not null").select("user_id", F.col("event_type").alias("step"), "event_id", F.when(F.col("value") > 100, "failed").otherwise("done").alias("outcome"))
    return jobs.pipeline_state(runs, "user_id", ["signup", "view", "click", "purchase"], "event_id")


@query("""
WITH s AS (SELECT c_custkey, list(o_orderkey ORDER BY o_orderkey) AS items FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
e AS (SELECT c_custkey, items, CAST(c_custkey % 4 AS INTEGER) AS next_index FROM s), r AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, next_index + CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END AS next_index, next_index + CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END >= len(items) AS completed
FROM e LEFT JOIN r ON r.o_custkey = e.c_custkey AND r.o_orderkey = e.items[next_index + 1]
""")
def series_progress(spark: SparkSession, d: str) -> DataFrame:
    """Readers' places in their series after what they have read."""
    o = table(spark, d, "orders")
    series = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("items")).join(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    enrolled = series.withColumn("next_index", (F.col("c_custkey") % 4).cast("int"))
    read = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("item"))
    return jobs.advance_series(enrolled, read, "c_custkey").select("c_custkey", "next_index", "completed")


@query("""
WITH r AS (SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS item FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
p AS (SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS item FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, CASE WHEN r.item IS NOT NULL THEN 'resume' WHEN p.item IS NOT NULL THEN 'pick' ELSE 'none' END AS source, coalesce(r.item, p.item) AS item
FROM customer LEFT JOIN r ON r.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey
""")
def daily_plan(spark: SparkSession, d: str) -> DataFrame:
    """What each reader is offered today: to resume, else the best pick, else nothing."""
    o = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "c_custkey", "o_orderkey": "item", "o_orderdate": "at", "o_totalprice": "score"})
    return jobs.daily_plan(table(spark, d, "customer"), o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'O'"), "c_custkey")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS r FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY event_id) AS s FROM a WHERE r <= 4),
c AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id) AS t FROM b WHERE s <= 6)
SELECT strftime(day, '%Y-%m-%d') AS day, outcome, count(*) AS n FROM (
  SELECT day, 'user' AS outcome FROM a WHERE r > 4 UNION ALL SELECT day, 'feature' FROM b WHERE s > 6 UNION ALL SELECT day, CASE WHEN t > 15 THEN 'global' ELSE 'ok' END FROM c) GROUP BY 1, 2
""")
def budget_checks(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each day that pass the budgets of the user, the feature and all, and where the others stop."""
    rows = table(spark, d, "events").where("user_id is not null").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    made = jobs.budget_checks(rows, [("user", ["user_id", "day"], 4), ("feature", ["event_type", "day"], 6), ("global", ["day"], 15)], [F.col("event_id")])
    return made.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "outcome").agg(F.count("*").alias("n"))


@query("""
WITH u AS (SELECT event_type AS feature, count(*) AS used FROM events GROUP BY 1), l(feature, "limit") AS (VALUES ('view', CAST(150 AS BIGINT)), ('click', 100000), ('tutor', 40))
SELECT coalesce(u.feature, l.feature) AS feature, "limit", coalesce(used, 0) AS used, CASE WHEN "limit" IS NOT NULL THEN greatest("limit" - coalesce(used, 0), 0) ELSE 0 END AS remaining FROM u FULL JOIN l ON u.feature = l.feature
""")
def budget_status(spark: SparkSession, d: str) -> DataFrame:
    """Limit, use and rest of every feature, configured ones without use included."""
    limits = spark.createDataFrame([("view", 150), ("click", 100_000), ("tutor", 40)], "feature string, limit long")
    used = table(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("used"))
    return jobs.budget_status(used, limits, "feature")


_BOUNDS = [10, 25, 50, 100, 250]


@query(f"""
WITH b AS (SELECT event_type, unnest({_BOUNDS} || [1000000000]) AS le FROM (SELECT DISTINCT event_type FROM events)),
c AS (SELECT b.event_type, b.le, count(*) FILTER (WHERE e.value <= b.le) AS n FROM b JOIN events e ON e.event_type = b.event_type GROUP BY 1, 2)
SELECT event_type, max(n) AS total, max(n) FILTER (WHERE le <= 60) AS fast, floor(CAST(max(n) FILTER (WHERE le <= 60) AS DOUBLE) / max(n) * 10000 + 0.5) / 10000 AS fraction FROM c GROUP BY 1
""")
def fast_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of values under a threshold, told from cumulative buckets: the largest bound that doesn't exceed it."""
    counts = analytics.cumulative_buckets(table(spark, d, "events"), ["event_type"], "value", _BOUNDS)
    return analytics.fraction_under(counts, ["event_type"], 60)


@query("""
SELECT 'route=' || o_orderpriority || ',status=' || o_orderstatus AS labels, count(*) AS hits, CAST(sum(l_linenumber) AS BIGINT) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def counter_sums(spark: SparkSession, d: str) -> DataFrame:
    """A counter summed over equal label sets, whatever the order of their labels."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    labels = F.when(F.col("l_orderkey") % 2 == 0, F.create_map(F.lit("status"), "o_orderstatus", F.lit("route"), "o_orderpriority")).otherwise(F.create_map(F.lit("route"), "o_orderpriority", F.lit("status"), "o_orderstatus"))
    return rows.groupBy(arrays.label_key(labels).alias("labels")).agg(F.count("*").alias("hits"), F.sum("l_linenumber").alias("value"))


@query("""
SELECT event_type, count(*) FILTER (WHERE value < 40) AS hits, count(*) FILTER (WHERE value >= 40) AS misses, floor(CAST(count(*) FILTER (WHERE value < 40) AS DOUBLE) / count(*) * 100 * 10 + 0.5) / 10 AS ratio FROM events GROUP BY 1
""")
def cache_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses of each cache and the share of hits."""
    return analytics.hit_ratio(table(spark, d, "events"), ["event_type"], F.col("value") < 40)


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, count(*) OVER () AS total, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer WHERE c_nationkey < 20)
SELECT c_custkey, CAST(position AS INTEGER) AS position, total, CAST(greatest(1, ceil(total / 12.0)) AS BIGINT) AS pages, position + 1 <= 24 OR total > 24 AS has_more FROM r WHERE position > 12 AND position <= 24
""")
def page_with_totals(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a listing, with the number of rows and pages and whether more follow."""
    rows = table(spark, d, "customer").where("c_nationkey < 20").select("c_custkey", "c_acctbal")
    return relational.page_with_total(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 2, 12).select("c_custkey", "position", "total", "pages", "has_more")


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey) AS INTEGER) AS position FROM orders QUALIFY position <= 3
""")
def due_order(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's next three by due date; those without one come last."""
    due = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    rows = table(spark, d, "orders").withColumn("due", due)
    return sequences.newest(rows, ["o_custkey"], [F.col("due").asc_nulls_last(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "position")


@query("""
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT l_suppkey, count(*) AS listed, max(total) > 500 AS overflow FROM r WHERE n <= 500 GROUP BY 1
""")
def capped_listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings cut at 500 rows, with a flag where rows were left out: one row more than the cap is looked at."""
    cut = sequences.newest(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 501)
    return cut.groupBy("l_suppkey").agg(F.least(F.count("*"), F.lit(500)).alias("listed"), (F.count("*") > 500).alias("overflow"))


@query("""
WITH m AS (SELECT p_partkey, p_type LIKE '%a%' AS hit, row_number() OVER (ORDER BY (p_type LIKE '%a%') DESC, p_retailprice DESC, p_partkey) AS position FROM part)
SELECT p_partkey, CAST(position AS INTEGER) AS position FROM m WHERE position <= 30
""")
def topic_first(spark: SparkSession, d: str) -> DataFrame:
    """A listing in which the rows of the reader's topics come first, each part in its own order."""
    return lists.stable_partition(table(spark, d, "part"), F.col("p_type").contains("a"), [F.desc("p_retailprice"), F.col("p_partkey")], 30).select("p_partkey", "position")


@query("""
WITH s AS (SELECT user_id, max(value) AS percent, bool_or(event_type = 'purchase') AS completed FROM events WHERE event_id % 2 = 0 AND user_id IS NOT NULL GROUP BY 1),
c AS (SELECT user_id, max(value) AS percent, bool_or(event_type = 'signup') AS completed FROM events WHERE event_id % 2 = 1 AND user_id IS NOT NULL GROUP BY 1)
SELECT coalesce(s.user_id, c.user_id) AS user_id, greatest(coalesce(s.percent, 0), coalesce(c.percent, 0)) AS percent,
  coalesce(s.completed, false) OR coalesce(c.completed, false) OR greatest(coalesce(s.percent, 0), coalesce(c.percent, 0)) >= 95 AS completed FROM s FULL JOIN c ON s.user_id = c.user_id
""")
def progress_merge(spark: SparkSession, d: str) -> DataFrame:
    """Progress kept on a server and on a device, merged: the furthest place, and done if either says so."""
    e = table(spark, d, "events").where("user_id is not null")
    one = lambda part, done: e.where(F.col("event_id") % 2 == part).groupBy("user_id").agg(F.max("value").alias("percent"), F.bool_or(F.col("event_type") == done).alias("completed"))
    return relational.merge_progress(one(0, "purchase"), one(1, "signup"), "user_id")


@query("""
WITH n AS (SELECT c_custkey, trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END) AS server, trim(CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN '' ELSE c_name END) AS client, trim(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CASE c_custkey % 2 WHEN 0 THEN c_mktsegment ELSE c_name END END) AS base FROM customer)
SELECT c_custkey, nullif(CASE WHEN server = client THEN client WHEN server = base THEN client WHEN client = base THEN server WHEN server = '' THEN client WHEN client = '' THEN server ELSE client || '\n---\n' || server END, '') AS text,
  NOT (server = client OR coalesce(server = base, false) OR coalesce(client = base, false) OR server = '' OR client = '') AS conflict FROM n
""".replace("\\n", "' || chr(10) || '"))
def note_merge(spark: SparkSession, d: str) -> DataFrame:
    """Notes edited on two sides, merged against the common base; both are kept where they differ."""
    k = F.col("c_custkey")
    server = F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    client = F.when(k % 4 == 0, F.col("c_mktsegment")).when(k % 4 == 1, "").otherwise(F.col("c_name"))
    base = F.when(k % 5 == 0, None).when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    merged = policy.merge_notes(server, client, base, "\n---\n")
    return table(spark, d, "customer").select("c_custkey", merged["text"].alias("text"), merged["conflict"].alias("conflict"))


@query("""
SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, o_custkey, count(*) AS n, count(*) >= 2 AS full FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2
""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    """Imports of each user since midnight UTC of each day, and whether the quota of two is used up."""
    rows = table(spark, d, "orders").where(F.col("o_orderdate") >= at("1998-01-01"))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_custkey").agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("full"))


@query("""
SELECT c_mktsegment, count(*) FILTER (WHERE o_orderdate <= TIMESTAMP '1996-01-01') AS due, count(*) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1
""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cards that are due and cards in all, by deck."""
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count_if(policy.is_due("o_orderdate", at("1996-01-01"))).alias("due"), F.count("*").alias("total"))


@query("""
WITH s AS (SELECT l_suppkey, l_orderkey, bool_or(l_returnflag = 'R') AS failed, bool_or(l_discount > 0.08) AS fallback, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS steps FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_suppkey, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE fallback) AS fallback, string_agg(DISTINCT steps, ';' ORDER BY steps) AS steps FROM s GROUP BY 1)
SELECT * FROM p ORDER BY failed DESC, l_suppkey LIMIT 10
""")
def problem_entities(spark: SparkSession, d: str) -> DataFrame:
    """The ten entities with most failures, with their fallbacks and the sets of steps they took."""
    line = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("failed"), F.bool_or(F.col("l_discount") > 0.08).alias("fallback"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("steps"))
    made = line.groupBy("l_suppkey").agg(F.count_if("failed").alias("failed"), F.count_if("fallback").alias("fallback"), F.array_join(F.sort_array(F.collect_set("steps")), ";").alias("steps"))
    return made.orderBy(F.desc("failed"), "l_suppkey").limit(10)


@query("""
WITH c AS (SELECT event_type AS feature, user_id AS test, bool_and(value > 5) AS passed, count(*) AS checks FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(feature, 'all') AS feature, count(*) AS cases, CAST(sum(checks) AS BIGINT) AS checks, count(*) FILTER (WHERE passed) AS passed, floor(CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) * 100 * 10 + 0.5) / 10 AS rate FROM c GROUP BY GROUPING SETS ((feature), ())
""")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Checks to cases to features to all: a case passes when all of its checks do."""
    cases = table(spark, d, "events").where("user_id is not null").groupBy(F.col("event_type").alias("feature"), F.col("user_id").alias("test")).agg(F.bool_and(F.col("value") > 5).alias("passed"), F.count("*").alias("checks"))
    return analytics.pass_rates(cases, "feature")


def _answer(v: Column) -> Column:
    return F.when(v % 37 == 0, 404).when(v % 10 < 6, 200).when(v % 10 == 6, 409).when(v % 10 == 7, 429).otherwise(503)


_STATUS = "CASE WHEN {v} % 37 = 0 THEN 404 WHEN {v} % 10 < 6 THEN 200 WHEN {v} % 10 = 6 THEN 409 WHEN {v} % 10 = 7 THEN 429 ELSE 503 END"


@query(f"""
WITH RECURSIVE c AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos,
    list_transform([1, 2, 3, 4, 5], lambda k: {_STATUS.format(v="(event_id * (k + 3) + k)")}) AS answers FROM events),
t AS (SELECT *, coalesce(list_position(list_transform(answers, lambda s: s NOT IN (429, 503)), true), 5) AS tries, coalesce(list_filter(answers, lambda s: s NOT IN (429, 503))[1] IN (200, 409), false) AS good FROM c),
r AS (
  SELECT event_id, user_id, day, pos, CASE WHEN tries > 4 THEN 'pending' WHEN good THEN 'done' ELSE 'failed' END AS state, least(tries, 4) AS sent, 1 AS began, least(tries, 4) AS ended FROM t WHERE pos = 1 UNION ALL
  SELECT t.event_id, t.user_id, t.day, t.pos, CASE WHEN r.state <> 'done' THEN 'held' WHEN r.ended + tries - 1 > 4 THEN 'pending' WHEN good THEN 'done' ELSE 'failed' END,
    CASE WHEN r.state <> 'done' THEN 0 ELSE least(r.ended + tries - 1, 4) - r.ended + 1 END, CASE WHEN r.state = 'done' THEN r.ended END, CASE WHEN r.state = 'done' THEN least(r.ended + tries - 1, 4) END
  FROM r JOIN t ON t.user_id = r.user_id AND t.day = r.day AND t.pos = r.pos + 1)
SELECT event_id, state, CAST(sent AS INTEGER) AS sent, CAST(began AS INTEGER) AS began, CAST(ended AS INTEGER) AS ended FROM r
""")
def offline_replay(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each user's queued changes of a day in four passes: sent in order, tried again, held back behind one that failed."""
    answers = F.transform(F.array(*map(F.lit, range(1, 6))), lambda k: _answer(F.col("event_id") * (k + 3) + k))
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "ts", answers.alias("answers"))
    return jobs.replayed(rows, ["user_id", "day"], ["ts", "event_id"], "answers", passes=4).select("event_id", "state", "sent", "began", "ended")


@query("""
WITH l AS (SELECT CAST(l_linenumber AS VARCHAR) AS mode, coalesce(l_returnflag, 'unknown') AS flag, coalesce(l_linestatus, 'unknown') AS status, CAST(l_quantity AS BIGINT) AS quantity, CAST(floor(l_extendedprice) AS BIGINT) AS price, l_discount = 0 AS fallback, l_tax > 0.05 AS cached FROM lineitem),
g AS (SELECT 'total' AS dimension, '' AS key, * FROM l UNION ALL SELECT 'mode', mode, * FROM l UNION ALL SELECT 'flag', flag, * FROM l UNION ALL SELECT 'status', status, * FROM l)
SELECT dimension, key, count(*) AS count, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(price) AS BIGINT) AS price, count(*) FILTER (fallback) AS fallback, count(*) FILTER (cached) AS cached FROM g GROUP BY 1, 2
""")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of all lines and by each of three keys, with filtered counts, in one pass."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("mode"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("long").alias("quantity"), F.floor("l_extendedprice").alias("price"), "l_discount", "l_tax")
    return analytics.summary_by(rows, ["mode", "flag", "status"], ["quantity", "price"], {"fallback": F.col("l_discount") == 0, "cached": F.col("l_tax") > 0.05})


@query("""
WITH e AS (SELECT event_id, event_type || ':' || coalesce(user_id, -1) AS print, ts, value > 95 AS fatal FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY print ORDER BY ts, event_id) AS occurrences FROM e)
SELECT event_id, occurrences, occurrences >= 5 OR coalesce(fatal, false) AS alert FROM n
""")
def alert_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an error of a kind and user: how often it was seen by then, and whether it raises an alert."""
    rows = table(spark, d, "events").select("event_id", F.concat_ws(":", "event_type", F.coalesce("user_id", F.lit(-1))).alias("print"), "ts", (F.col("value") > 95).alias("fatal"))
    return jobs.alerts(rows, "print", ["ts", "event_id"], 5, F.col("fatal")).select("event_id", "occurrences", "alert")


@query(r"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a' || user_id END AS article, CASE WHEN event_id % 2 = 0 THEN event_type END AS feature FROM events
""")
def job_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Texts out of payloads in which some are numbers or missing, or which are no objects."""
    made = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"article": 7, "feature": "'), F.col("event_type"), F.lit('"}'))).otherwise(F.concat(F.lit('{"feature": "'), F.col("event_type"), F.lit('", "article": "a'), F.col("user_id"), F.lit('"}')))
    made = F.when(F.col("event_id") % 2 == 1, F.regexp_replace(made, '"feature": "[a-z]+"', '"feature": null')).otherwise(made)
    return table(spark, d, "events").select("event_id", *jobs.payload_fields(made, "article", "feature"))
