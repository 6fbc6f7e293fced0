"""Queries on rules of single rows: who may read what, local days, readability, prompts made safe, measures of a reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import dates, levels, policy, safety, text
from marginalia.functions import math as m
from marginalia.plans.registry import query
from marginalia.sources.tables import table


@query("""
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 'PRIVATE' ELSE 'PUBLIC' END AS visibility, CASE WHEN o_orderstatus = 'F' THEN 'published' ELSE 'draft' END AS status,
  CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS owner_id, o_custkey - o_custkey % 2 AS reader, o_orderkey % 7 = 0 AS grouped, ['admin', 'teacher', 'reader', NULL][o_orderkey % 4 + 1] AS role FROM orders),
b AS (SELECT *, visibility = 'PUBLIC' AND status = 'published' AND owner_id IS NULL AS listable FROM a), c AS (SELECT *, listable OR (visibility = 'PRIVATE' AND owner_id = reader) AS readable FROM b)
SELECT o_orderkey, listable, readable, coalesce(owner_id = reader, FALSE) AS editable, coalesce(owner_id = reader AND visibility = 'PRIVATE', FALSE) AS manageable, readable AND status = 'published' AS for_model,
  CASE WHEN role = 'admin' THEN 'all' WHEN role = 'teacher' AND grouped THEN 'group' WHEN owner_id = reader THEN 'own' ELSE 'none' END AS scope FROM c
""")
def access_rules(spark: SparkSession, d: str) -> DataFrame:
    """What the rules of access say on every order as an article and a reader of it."""
    pick = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") < "3", "PRIVATE").otherwise("PUBLIC").alias("visibility"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("status"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("owner_id"), (F.col("o_custkey") - F.col("o_custkey") % 2).alias("reader"), (F.col("o_orderkey") % 7 == 0).alias("grouped"),
        F.when(pick == 0, "admin").when(pick == 1, "teacher").when(pick == 2, "reader").alias("role"),
    )
    reader = F.col("reader")
    return rows.select(
        "o_orderkey", policy.public_listable().alias("listable"), policy.readable(reader).alias("readable"), policy.editable(reader).alias("editable"), policy.manageable(reader).alias("manageable"),
        policy.model_readable(reader).alias("for_model"), policy.access_scope("role", F.col("owner_id") == reader, "grouped").alias("scope"),
    )


@query("""
WITH z AS (SELECT event_id, ts, CASE user_id % 5 WHEN 0 THEN 540 WHEN 1 THEN -300 WHEN 2 THEN 330 END AS profile, CASE WHEN event_id % 2 = 0 THEN 60 END AS request FROM events),
l AS (SELECT *, ts + to_minutes(coalesce(profile, 0)) AS here, ts + to_minutes(coalesce(profile, request, 0)) AS session, 1706659200 - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM z)
SELECT event_id, CAST(here AS DATE) AS day, CAST(hour(here) AS INTEGER) AS hour, CAST(epoch(CAST(CAST(here AS DATE) AS TIMESTAMP)) AS BIGINT) - coalesce(profile, 0) * 60 AS day_start, CAST(session AS DATE) AS session_day, ts < TIMESTAMP '2024-01-21' AS stale,
  CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'Yesterday' WHEN s < 604800 THEN (s // 86400) || ' days ago' ELSE strftime(ts, '%b %-d') END AS ago,
  strftime(ts, '%b %-d, %Y') AS short FROM l
""")
def local_days(spark: SparkSession, d: str) -> DataFrame:
    """Day, hour and start of day of every event where its user is, by the user's zone, for a session also by the request's; unknown zones are UTC."""
    user = F.col("user_id") % 5
    zone = F.when(user == 0, "Asia/Tokyo").when(user == 1, "America/New_York").when(user == 2, "Asia/Kolkata").when(user == 3, "Nowhere/Town")
    rows = table(spark, d, "events").select("event_id", "ts", zone.alias("profile"), F.when(F.col("event_id") % 2 == 0, "Europe/Berlin").alias("request"))
    return rows.select(
        "event_id", dates.local_date("ts", "profile").alias("day"), dates.local_hour("ts", "profile").alias("hour"), F.unix_timestamp(dates.local_day_start("ts", "profile")).alias("day_start"),
        dates.session_date("ts", "profile", "request").alias("session_day"), dates.is_stale("ts", F.lit("2024-01-31").cast("timestamp_ntz"), 10).alias("stale"),
        dates.relative_time("ts", F.lit("2024-01-31").cast("timestamp_ntz")).alias("ago"), dates.short_date("ts").alias("short"),
    )


_SYLLABLES = r"CASE WHEN length(x) = 0 THEN 0 WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(x, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END"


def _scaled(x: str, low: int, high: int) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(100.0, greatest(0.0, ({x} - {low}) / {high - low} * 100)) END"


@query(rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+(?:''[A-Za-z]+)?') AS w, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS DOUBLE) AS ns FROM documents),
y AS (SELECT *, list_transform(list_transform(w, lambda v: replace(lower(v), '''', '')), lambda x: {_SYLLABLES}) AS y FROM w),
c AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS nw, ns, coalesce(list_sum(y), 0) AS ny, len(list_filter(y, lambda n: n >= 3)) AS nc, coalesce(list_sum(list_transform(w, lambda x: length(replace(x, '''', '')))), 0) AS nl, len(list_filter(w, lambda x: length(x) > 6)) AS nb FROM y),
r AS (SELECT doc_id, CASE WHEN nw >= 20 AND ns > 0 THEN 206.835 - 1.015 * (nw / ns) - 84.6 * (ny / nw) END AS ease, CASE WHEN nw >= 20 AND ns > 0 THEN 0.39 * (nw / ns) + 11.8 * (ny / nw) - 15.59 END AS grade,
  CASE WHEN nw >= 20 AND ns > 0 THEN 4.71 * (nl / nw) + 0.5 * (nw / ns) - 21.43 END AS ari, CASE WHEN nw >= 20 AND ns > 0 THEN 0.0588 * (nl / nw * 100) - 0.296 * (ns / nw * 100) - 15.8 END AS coleman,
  CASE WHEN nw >= 30 AND ns > 0 THEN 1.043 * sqrt(nc * (30.0 / ns)) + 3.1291 END AS smog, CASE WHEN nw >= 20 AND ns > 0 THEN nw / ns + 100.0 * nb / nw END AS lix FROM c)
SELECT doc_id, round(ease, 3) AS ease, round(grade, 3) AS grade, round(coleman, 3) AS coleman, round(smog, 3) AS smog,
  round(coalesce(list_avg([CASE WHEN ease IS NOT NULL THEN 100 - least(100.0, greatest(0.0, ease)) END, {_scaled("grade", 2, 16)}, {_scaled("ari", 2, 16)}, {_scaled("coleman", 2, 16)}, {_scaled("smog", 2, 16)}, {_scaled("lix", 20, 60)}]), 35.0), 3) AS blend FROM r
""")
def readability_scores(spark: SparkSession, d: str) -> DataFrame:
    """Reading ease, grade, the Coleman and Liau index and SMOG of every document, and the mean of all measures that apply."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.select("doc_id", *[c.alias(k) for k, c in text.readability_counts("text").items()])
    made = {"ease": text.flesch_ease(), "grade": text.flesch_kincaid(), "coleman": text.coleman_liau(), "smog": text.smog(), "blend": text.readability()}
    return counts.select("doc_id", *[F.round(c, 3).alias(k) for k, c in made.items()])


def _neutral_sql() -> str:
    out = "substr(said, 1, 20000)"
    for pattern, stand_in in safety.INJECTION:
        out = f"regexp_replace({out}, '{pattern}', '{stand_in}', 'g')"
    return out


@query(f"""
WITH t AS (SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS said FROM conversations GROUP BY 1),
n AS (SELECT conv_id, {_neutral_sql()} AS safe FROM t)
SELECT conv_id, length(safe) AS chars, md5('<chat>' || chr(10) || safe || chr(10) || '</chat>') AS wrapped_md5 FROM n
""")
def neutralised_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as untrusted content of a prompt: speakers' marks and injected orders taken out, the first 20,000 characters, wrapped."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))
    safe = rows.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", safety.neutralise(F.array_join(F.transform("t", line), "\n")).alias("safe"))
    return safe.select("conv_id", F.length("safe").cast("long").alias("chars"), F.md5(safety.wrap_untrusted("safe", "chat")).alias("wrapped_md5"))


_RATES, _USUAL = {"large": (0.01, 0.03), "small": (0.0005, 0.0015)}, (0.002, 0.006)


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS words, count(*) FILTER (WHERE l_quantity > 25) AS big FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey, lines, words, big, CAST(o_totalprice AS BIGINT) AS ms, CAST(big AS DOUBLE) / lines AS share, o_orderkey % 200 AS days, ['A1', 'A2', 'B1', 'B2', 'C1', 'C2'][o_orderkey % 6 + 1] AS chosen, ['Large', 'x-small-2', 'other', NULL][o_orderkey % 4 + 1] AS model FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN ms >= 5000 AND words > 0 THEN floor(least(600.0, greatest(50.0, words / (ms / 60000.0))) + 0.5) END AS pace, CASE WHEN words > 0 THEN big * 100.0 / words END AS density,
  CAST(floor(least(100.0, greatest(0.0, CAST(days AS DOUBLE) - 20)) + 0.5) AS INTEGER) AS percent, floor(least(100.0, greatest(0.0, CAST(days AS DOUBLE) - 20)) + 0.5) >= 95 AS finished,
  CAST(floor(share * 100 + 0.5) AS INTEGER) AS score, CAST(CASE WHEN share < 0.6 OR lines / 60.0 >= 0.1 THEN -1 WHEN share >= 0.8 AND lines / 60.0 < 0.05 THEN 1 ELSE 0 END AS INTEGER) AS placement,
  ['A1', 'A2', 'B1', 'B2', 'C1', 'C2'][greatest(0, o_orderkey % 6 - CASE WHEN share < 0.25 THEN 2 WHEN share < 0.5 THEN 1 ELSE 0 END) + 1] AS level, CASE WHEN days > 90 THEN 1 - (1 - share) * 0.5 ELSE share END AS confidence,
  CASE WHEN lines <= 3 THEN lines ELSE least(lines, 5) END AS reviews,
  floor((words / 1000.0 * CASE coalesce(model, '') WHEN 'Large' THEN 0.01 WHEN 'x-small-2' THEN 0.0005 ELSE 0.002 END + lines / 1000.0 * CASE coalesce(model, '') WHEN 'Large' THEN 0.03 WHEN 'x-small-2' THEN 0.0015 ELSE 0.006 END) * 1000000 + 0.5) / 1000000 AS cost FROM r
""")
def reading_measures(spark: SparkSession, d: str) -> DataFrame:
    """Pace, look-ups, progress, scores, placement, decayed confidence, reviews due and model cost of orders as readings."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.rint(F.sum("l_quantity")).cast("long").alias("words"), F.count_if(F.col("l_quantity") > 25).alias("big"))
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").join(lines, key == F.col("l_orderkey")).select(
        "o_orderkey", "lines", "words", "big", F.rint("o_totalprice").cast("long").alias("ms"), (F.col("big") / F.col("lines")).alias("share"), (key % 200).alias("days"),
        F.get(F.array(*map(F.lit, m.LEVELS)), (key % 6).cast("int")).alias("chosen"), F.when(key % 4 == 0, "Large").when(key % 4 == 1, "x-small-2").when(key % 4 == 2, "other").alias("model"),
    )
    percent = m.progress_percent(F.col("days") - 20)
    return rows.select(
        "o_orderkey", m.words_per_minute("words", "ms").cast("double").alias("pace"), m.lookup_density("big", "words").alias("density"), percent.alias("percent"), m.finished(percent).alias("finished"),
        m.count_score("big", "lines").alias("score"), m.placement("share", F.col("lines") / 60.0).alias("placement"), m.onboarding_level("big", "lines", "chosen").alias("level"),
        m.stale_confidence("share", "days").alias("confidence"), levels.review_needed("lines").alias("reviews"), m.model_cost("model", "words", "lines", _RATES, _USUAL).alias("cost"),
    )
