"""Queries whose point is a join: defaults, expectations, fallbacks, containment, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import policy, text
from marginalia.functions.math import rnd
from marginalia.operators import joins, relational
from marginalia.plans.registry import query
from marginalia.sources.tables import table

SKILLS = ["click", "error", "grammar", "purchase", "signup", "view"]


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer")


@query("""
SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'P'
""")
def orders_of_segment(spark: SparkSession, d: str) -> DataFrame:
    """Open orders of customers of one segment, beside their names."""
    rows = orders(spark, d).where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return joins.with_parent(rows, customers(spark, d), ["c_custkey"], F.col("c_mktsegment") == "BUILDING", ["c_name", "c_nationkey"]).select("o_orderkey", "c_name", "c_nationkey")


_GROUPS = """m AS (SELECT c_nationkey AS g, c_custkey AS u FROM customer), t AS (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS g, p_partkey AS t FROM part WHERE p_size <= 12),
d AS (SELECT DISTINCT o_custkey AS u, l_partkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')"""


def groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members and tasks of groups, and what was done."""
    members = customers(spark, d).select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("user"))
    tasks = table(spark, d, "part").where("p_size <= 12").select(F.substring("p_brand", 7, 10).cast("int").alias("group"), F.col("p_partkey").alias("task"))
    done = orders(spark, d).where("o_orderstatus = 'F'").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("task")).distinct()
    return members, tasks, done


@query(f"""
WITH {_GROUPS}, s AS (SELECT m.g, coalesce(CASE WHEN d.u IS NOT NULL THEN 'DONE' END, 'ASSIGNED') AS status FROM m JOIN t ON t.g = m.g LEFT JOIN d ON d.u = m.u AND d.t = t.t)
SELECT g AS "group", status, count(*) AS n FROM s GROUP BY 1, 2
""")
def assignment_status(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of every member of a group, assigned unless they are done."""
    return joins.statuses(*groups(spark, d), "group", "DONE", "ASSIGNED")


@query(f"""
WITH {_GROUPS}, n AS (SELECT g, count(*) AS members FROM m GROUP BY 1), k AS (SELECT g, count(*) AS tasks FROM t GROUP BY 1), c AS (SELECT m.g, count(*) AS completed FROM d JOIN m ON m.u = d.u JOIN t ON t.g = m.g AND t.t = d.t GROUP BY 1)
SELECT n.g AS "group", members, members * coalesce(tasks, 0) AS expected, coalesce(completed, 0) AS completed, CASE WHEN members * coalesce(tasks, 0) > 0 THEN floor(CAST(coalesce(completed, 0) AS DOUBLE) / (members * tasks) * 100 * 10 + 0.5) / 10 ELSE 0.0 END AS rate
FROM n LEFT JOIN k ON k.g = n.g LEFT JOIN c ON c.g = n.g
""")
def group_expectation(spark: SparkSession, d: str) -> DataFrame:
    """How many completions each group is expected to have, and has."""
    return joins.expectation(*groups(spark, d), "group")


@query("""
WITH o AS (SELECT s_nationkey AS "user", s_suppkey AS id FROM supplier), m AS (SELECT DISTINCT c_nationkey AS "user", CAST(c_custkey % 10 + 1 AS BIGINT) AS id FROM customer WHERE c_acctbal > 8000),
k AS (SELECT "user", id FROM o UNION SELECT m."user", m.id FROM m JOIN o ON o.id = m.id)
SELECT "user", id FROM k WHERE "user" < 12
""")
def own_or_member(spark: SparkSession, d: str) -> DataFrame:
    """What each user owns or is a member of."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("owner"))
    members = customers(spark, d).where("c_acctbal > 8000").select(F.col("c_nationkey").alias("user"), (F.col("c_custkey") % 10 + 1).alias("id")).distinct()
    users = table(spark, d, "nation").select(F.col("n_nationkey").alias("user")).where("user < 12")
    return joins.mine(rows, "id", "owner", members, users).select("user", "id")


@query("""
WITH c AS (SELECT user_id, unnest(generate_series(DATE '2023-02-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS day FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)),
n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT c.user_id, count(*) AS days, count(*) FILTER (WHERE n IS NULL) AS empty, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM c LEFT JOIN n ON n.user_id = c.user_id AND n.day = c.day GROUP BY 1
""")
def year_calendar(spark: SparkSession, d: str) -> DataFrame:
    """A year of days for each user, empty ones included."""
    days = table(spark, d, "events").where("user_id is not null").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    cells = joins.calendar_cells(days, "user_id", "n", "2024-01-31")
    return cells.groupBy("user_id").agg(F.count("*").alias("days"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("total"))


@query(f"""
WITH u AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), s AS (SELECT user_id, unnest({SKILLS}) AS skill FROM u), n AS (SELECT user_id, event_type AS skill, floor(avg(value) * 10000 + 0.5) / 10000 AS confidence, count(*) AS evidence FROM events GROUP BY 1, 2)
SELECT s.user_id, s.skill, coalesce(confidence, 0.0) AS confidence, coalesce(evidence, 0) AS evidence FROM s LEFT JOIN n ON n.user_id = s.user_id AND n.skill = s.skill
""")
def skill_table(spark: SparkSession, d: str) -> DataFrame:
    """Every skill of every user, zero where there is no evidence."""
    n = table(spark, d, "events").where("user_id is not null").groupBy("user_id", F.col("event_type").alias("skill")).agg(rnd(F.avg("value"), 4).alias("confidence"), F.count("*").alias("evidence"))
    return joins.with_dimension(n, ["user_id"], "skill", SKILLS, {"confidence": F.lit(0.0), "evidence": F.lit(0)})


@query("""
WITH d AS (SELECT o_custkey, count(*) AS due FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1), s AS (SELECT o_custkey, count(*) AS devices FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey, due, devices FROM customer JOIN d ON d.o_custkey = c_custkey JOIN s ON s.o_custkey = c_custkey WHERE c_acctbal > 0 AND NOT (CAST(c_nationkey % 24 AS INTEGER) >= 22 OR CAST(c_nationkey % 24 AS INTEGER) < 7)
""")
def reminders_due(spark: SparkSession, d: str) -> DataFrame:
    """Users with due cards, a device, reminders turned on, and a local hour outside of quiet hours."""
    o = orders(spark, d)
    due = o.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp_ntz"))).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("due"))
    devices = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("devices"))
    send = policy.send_now(F.col("c_acctbal") > 0, F.col("c_nationkey") % 24, F.lit(22), F.lit(7), F.lit(None).cast("int"))
    return customers(spark, d).where(send).select("c_custkey").join(due, "c_custkey").join(devices, "c_custkey")


@query("""
SELECT p_brand, count(l_orderkey) AS total, count(l_orderkey) FILTER (WHERE l_returnflag = 'N') AS published FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1
""")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows under each tag, of all and of those that are published; counted by part before the tags meet them."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "N").alias("published"))
    return table(spark, d, "part").select("p_partkey", "p_brand").join(n, "p_partkey", "left").groupBy("p_brand").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("published"), F.lit(0)).alias("published"))


@query("""
WITH c AS (SELECT c_custkey, unnest(['Brand#' || (c_custkey % 40), 'Brand#' || c_nationkey, 'Brand#1']) AS word, unnest([1, 2, 3]) AS position FROM customer), b AS (SELECT p_brand AS word, count(*) AS n FROM part GROUP BY 1),
f AS (SELECT c_custkey, CAST(min(position) AS INTEGER) AS position, arg_min(n, position) AS n FROM c JOIN b ON b.word = c.word GROUP BY 1)
SELECT customer.c_custkey, position, n FROM customer LEFT JOIN f ON f.c_custkey = customer.c_custkey
""")
def first_found(spark: SparkSession, d: str) -> DataFrame:
    """The first of three names in order that the table has."""
    name = lambda c: F.concat(F.lit("Brand#"), c.cast("string"))
    rows = customers(spark, d).select("c_custkey", F.array(name(F.col("c_custkey") % 40), name(F.col("c_nationkey")), F.lit("Brand#1")).alias("names"))
    known = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return joins.first_found(rows, "c_custkey", "names", known, "p_brand", ["n"])


@query("""
WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark WHERE item_id < 5), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS t FROM documents),
p AS (SELECT doc_id, unnest(t) AS w FROM t)
SELECT p.doc_id, count(*) AS n FROM p JOIN s ON s.w = p.w GROUP BY 1
""")
def word_exposures(spark: SparkSession, d: str) -> DataFrame:
    """How many saved words each text has."""
    words = table(spark, d, "benchmark").where("item_id < 5").select(F.explode(text.matches(F.lower("text"), "[a-z]+")).alias("w"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return joins.present(words, docs, "w", "doc_id", text.matches(F.lower("text"), "[a-z]+")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT o_orderkey, list_distinct(list(l_partkey)) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1), e AS (SELECT unnest(items) AS p FROM l), n AS (SELECT p, count(*) AS n FROM e GROUP BY 1)
SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN n ON p = p_partkey WHERE p_size > 25
""")
def list_containment(spark: SparkSession, d: str) -> DataFrame:
    """In how many lists each candidate is."""
    lists = orders(spark, d).where("o_orderstatus = 'P'").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.collect_list("l_partkey").alias("items"))
    return joins.contained(lists, "items", table(spark, d, "part").where("p_size > 25"), "p_partkey")


@query("""
WITH p AS (SELECT conv_id, list_filter(list_transform(string_split_regex(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '\\n'), lambda x: trim(x)), lambda x: x <> '') AS a,
  list_filter(list_transform(string_split_regex(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'user'), '\\n'), lambda x: trim(x)), lambda x: x <> '') AS b FROM conversations GROUP BY 1),
z AS (SELECT conv_id, unnest(range(greatest(coalesce(len(a), 0), coalesce(len(b), 0)))) AS place, a, b FROM p)
SELECT conv_id, CAST(place AS INTEGER) AS place, a[place + 1] IS NULL AS no_a, b[place + 1] IS NULL AS no_b FROM z
""".replace("\\\\n", "\\n"))
def paragraph_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of two texts side by side, by place."""
    said = lambda who: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(who, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    user = F.col("role") == "user"
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    both = table(spark, d, "conversations").groupBy("conv_id").agg(said(user).alias("a"), said(~user).alias("b")).select("conv_id", lines("a").alias("a"), lines("b").alias("b"))
    return joins.zipped(both, "conv_id", "a", "b").select("conv_id", "place", F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b"))


@query("""
WITH a AS (SELECT user_id, event_id, value AS s, value + 12 AS e FROM events WHERE event_type = 'view' AND user_id IS NOT NULL), b AS (SELECT user_id, event_id, value AS s, value + 5 AS e FROM events WHERE event_type = 'click' AND user_id IS NOT NULL)
SELECT a.user_id, count(*) AS pairs, floor(sum(least(a.e, b.e) - greatest(a.s, b.s)) * 1000 + 0.5) / 1000 AS shared FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e GROUP BY 1
""")
def range_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping ranges of each user, and how much they share."""
    e = table(spark, d, "events").where("user_id is not null")
    span = lambda kind, size: e.where(F.col("event_type") == kind).select("user_id", "event_id", F.col("value").alias("start"), (F.col("value") + size).alias("end"))
    both = joins.overlapping(span("view", 12), span("click", 5), ["user_id"], 20)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    return both.groupBy("user_id").agg(F.count("*").alias("pairs"), rnd(F.sum(shared), 3).alias("shared"))


@query()
def speech_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each text's words by those of its lower-cased copy without every seventh, in buckets."""
    words = text.matches("text", "[A-Za-z]+")
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", words.alias("a")).select("doc_id", "a", F.filter("a", lambda x, i: i % 7 != 3).alias("b"))
    made = joins.aligned(rows, "doc_id", "a", "b")
    return made.groupBy(joins.coverage_bucket(F.col("coverage")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("matched").alias("matched"))


@query("""
WITH s AS (SELECT o_custkey, unnest(list(o_orderkey ORDER BY o_orderkey)) AS item, unnest(range(count(*))) AS position, o_custkey % 3 AS next FROM orders GROUP BY 1), r AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
f AS (SELECT o_custkey, min(position) AS position, arg_min(item, position) AS item FROM s JOIN r ON item = o_orderkey WHERE position >= next GROUP BY 1)
SELECT k.o_custkey, CAST(f.position AS INTEGER) AS position, f.item FROM (SELECT DISTINCT o_custkey FROM orders) k LEFT JOIN f ON f.o_custkey = k.o_custkey
""")
def next_in_series(spark: SparkSession, d: str) -> DataFrame:
    """The first readable item of each list at or after the reader's place."""
    o = orders(spark, d)
    lists = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("items")).withColumn("next", F.col("o_custkey") % 3)
    return joins.next_readable(lists, "o_custkey", "items", "next", o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item")), "item")


@query("""
WITH t AS (SELECT doc_id, text FROM documents WHERE length(text) >= 60)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 20 WHEN 1 THEN strpos(text, substr(text, 11, 30)) - 1 WHEN 2 THEN strpos(text, substr(text, 21, 12)) - 1 ELSE -1 END AS place FROM t
""")
def anchors_found(spark: SparkSession, d: str) -> DataFrame:
    """Where quotations are after their texts or offsets have changed; a changed offset is past the text's end, where no quotation can be by chance."""
    rows = table(spark, d, "documents").where("length(text) >= 60")
    kind = F.col("doc_id") % 4
    sub = lambda a, n: F.substring("text", a, n)
    rows = rows.select("doc_id", "text", F.when(kind == 0, sub(21, 12)).when(kind == 1, sub(15, 26)).when(kind == 2, sub(21, 12)).otherwise("\u0001 none of this").alias("quote"), F.when(kind == 0, 20).otherwise(F.length("text")).alias("start"), F.when(kind == 1, sub(11, 4)).otherwise("").alias("prefix"), F.lit("").alias("suffix"))
    place = joins.relocate("text", "quote", "start", "prefix", "suffix")
    return rows.select("doc_id", F.when(kind == 1, F.when(place >= 0, place - 4)).otherwise(place).alias("place"))


@query("""
SELECT * FROM (SELECT p_partkey, coalesce(n, 0) AS n, coalesce(n, 0) >= 20 AS completed FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
""")
def listing_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress for the items of one listing page."""
    head = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey")
    made = joins.page_counts(head, table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "n")
    return made.withColumn("completed", F.col("n") >= 20)


@query("""
WITH s AS (SELECT p_brand, count(*) AS items FROM part WHERE p_size > 5 GROUP BY 1), e AS (SELECT 'Brand#' || c_nationkey AS p_brand, max(c_acctbal) AS since FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT s.p_brand, items, CASE WHEN since IS NULL THEN 'open' ELSE 'enrolled' END AS state FROM s LEFT JOIN e ON e.p_brand = s.p_brand
""")
def series_cards(spark: SparkSession, d: str) -> DataFrame:
    """Public series with a reader's enrolment."""
    series = table(spark, d, "part").where("p_size > 5").groupBy("p_brand").agg(F.count("*").alias("items"))
    enrolled = customers(spark, d).where("c_acctbal > 9000").select(F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string")).alias("p_brand")).distinct().withColumn("state", F.lit("enrolled"))
    return joins.with_default(series, enrolled, ["p_brand"], {"state": F.lit("open")})


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN p_size > 10 AND p_brand <> 'Brand#3' THEN p_name END AS title FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_orderkey < 500
""")
def word_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the sources of saved words, where the reader may see them."""
    rows = table(spark, d, "lineitem").where("l_orderkey < 500").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    seen = table(spark, d, "part").where((F.col("p_size") > 10) & (F.col("p_brand") != "Brand#3")).select("p_partkey", F.col("p_name").alias("title"))
    return rows.join(seen, "p_partkey", "left").select("l_orderkey", "l_linenumber", "title")


@query("""
WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c)
SELECT value, n FROM r WHERE k <= 3 UNION ALL SELECT 'other', CAST(sum(n) AS BIGINT) FROM r WHERE k > 3 HAVING sum(n) > 0
""")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest types, and all others as one."""
    return joins.spilled(table(spark, d, "part"), "p_type", 3)


@query("""
SELECT c_custkey, count(o_orderkey) AS orders, CAST(floor(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') + 0.5) AS BIGINT) AS average, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def member_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, a rounded mean that skips what isn't finished, and the last date of each member."""
    sums = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), joins.average_rounded(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("average"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))
    made = customers(spark, d).select("c_custkey").join(sums, "c_custkey", "left")
    return made.withColumns({"orders": F.coalesce("orders", F.lit(0)), "open": F.coalesce("open", F.lit(0))})


@query("""
WITH e AS (SELECT o_orderkey, o_totalprice, 0 AS part FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY part, o_totalprice DESC, o_orderkey) AS INTEGER) AS position FROM e QUALIFY position <= 30
""")
def picks_with_extra(spark: SparkSession, d: str) -> DataFrame:
    """Extra candidates before the usual ones; a candidate of both parts is listed twice."""
    p = orders(spark, d).where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return joins.prepended(p.where("o_orderpriority = '1-URGENT'"), p, [F.desc("o_totalprice"), F.col("o_orderkey")], 30).select("o_orderkey", "position")


@query("""
SELECT (SELECT count(*) FROM customer) AS members, (SELECT count(*) FROM orders) AS articles, count(*) FILTER (WHERE o_orderstatus = 'F') AS published, count(*) FILTER (WHERE o_orderstatus = 'P') AS drafts, CAST(floor(avg(o_totalprice) + 0.5) AS BIGINT) AS average, max(o_totalprice) AS most FROM orders
""")
def admin_overview(spark: SparkSession, d: str) -> DataFrame:
    """Scalar counts of an overview, one pass for each table."""
    state = lambda s: F.count_if(F.col("o_orderstatus") == s)
    o = orders(spark, d).agg(F.count("*").alias("articles"), state("F").alias("published"), state("P").alias("drafts"), joins.average_rounded("o_totalprice").alias("average"), F.max("o_totalprice").alias("most"))
    return customers(spark, d).agg(F.count("*").alias("members")).join(F.broadcast(o))


@query("""
SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7') ORDER BY o_totalprice DESC, o_orderkey LIMIT 40
""")
def admin_text_filter(spark: SparkSession, d: str) -> DataFrame:
    """An administrator's listing filtered by free text."""
    people = customers(spark, d).where(policy.text_filter(["c_name", "c_mktsegment"], " 7 ")).select(F.col("c_custkey").alias("o_custkey"))
    return relational.with_some(orders(spark, d), people, ["o_custkey"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_totalprice")
