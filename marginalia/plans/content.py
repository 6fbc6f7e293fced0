"""Queries on documents, pages and conversations: search, readability, quality, safety, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import html, policy, safety, text
from marginalia.functions.math import rnd
from marginalia.operators import documents as ops
from marginalia.operators import sequences
from marginalia.plans.registry import query
from marginalia.sources.tables import table

QUERY, TERMS = "and the", ["and", "the"]
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _score(col: str, w: int) -> str:
    return f"CASE WHEN contains(lower({col}), '{QUERY}') THEN {2 * w} ELSE 0 END + " + " + ".join(f"CASE WHEN contains(lower({col}), '{t}') THEN {w} ELSE 0 END" for t in TERMS)


@query(f"""
WITH s AS (SELECT doc_id, CAST({_score("text", 10)} + {_score("source", 22)} AS DOUBLE) AS score FROM documents WHERE {" AND ".join(f"(contains(lower(text), '{t}') OR contains(lower(source), '{t}'))" for t in TERMS)})
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20
""")
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    found = docs(spark, d).where(policy.fields_match(["text", "source"], TERMS))
    return found.select("doc_id", policy.search_score({"content": "text", "source": "source"}, QUERY, TERMS).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?') AS w, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS n_sentences FROM documents),
c AS (SELECT doc_id, len(w) AS n_words, n_sentences, coalesce(list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')))), 0) AS n_letters, len(list_filter(w, lambda x: length(x) > 6)) AS n_long FROM w)
SELECT doc_id, CAST(n_words AS INTEGER) AS n_words, CAST(n_sentences AS INTEGER) AS n_sentences, CAST(n_letters AS INTEGER) AS n_letters, CAST(n_long AS INTEGER) AS n_long,
  CASE WHEN n_words >= 20 AND n_sentences > 0 THEN floor((4.71 * (CAST(n_letters AS DOUBLE) / n_words) + 0.5 * (CAST(n_words AS DOUBLE) / n_sentences) - 21.43) * 1000 + 0.5) / 1000 END AS ari,
  CASE WHEN n_words >= 20 AND n_sentences > 0 THEN floor((CAST(n_words AS DOUBLE) / n_sentences + 100.0 * n_long / n_words) * 1000 + 0.5) / 1000 END AS lix
FROM c
""")
def readability_metrics(spark: SparkSession, d: str) -> DataFrame:
    counts = text.readability_counts("text")
    rows = docs(spark, d).select("doc_id", *[counts[k].alias(k) for k in ("n_words", "n_sentences", "n_letters", "n_long")])
    return rows.select("*", rnd(text.automated_readability(), 3).alias("ari"), rnd(text.lix(), 3).alias("lix"))


@query(f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{3,}}') AS u FROM documents)
SELECT doc_id, CASE WHEN len(t) = 0 THEN 0.0 ELSE floor(CAST(len(list_filter(t, lambda x: x IN ({_STOP}))) AS DOUBLE) / len(t) * 10000 + 0.5) / 10000 END AS stopwords,
  CASE WHEN len(u) = 0 THEN 0.0 ELSE floor(CAST(len(list_filter(u, lambda x: x = upper(x))) AS DOUBLE) / len(u) * 10000 + 0.5) / 10000 END AS uppercase FROM t
""")
def word_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).withColumn("t", text.tokens("text"))
    return rows.select("doc_id", rnd(text.stopword_ratio(F.col("t")), 4).alias("stopwords"), rnd(text.uppercase_ratio("text"), 4).alias("uppercase"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS t FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM t WHERE len(t) >= 30),
n AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2)
SELECT doc_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS trigrams, floor(CAST(sum(n) FILTER (WHERE n > 1) AS DOUBLE) / sum(n) * 10000 + 0.5) / 10000 AS repeated FROM n GROUP BY doc_id
""")
def trigram_repetition(spark: SparkSession, d: str) -> DataFrame:
    return ops.trigram_repetition(docs(spark, d))


def _hits(patterns: tuple[str, ...], one: str) -> str:
    return " + ".join(one.format("(?i)" + p.replace("'", "''")) for p in patterns)


_SOFT = [
    ("reject", "empty", "trim(text) = ''", 100),
    ("reject", "too_short", "n BETWEEN 1 AND 49", 50),
    ("reject", "short", "n BETWEEN 50 AND 999", 40),
    ("reject", "code", "code > 0.02", 60),
    ("warn", "garbage", "junk > 0.02", 25),
    ("warn", "boilerplate", "foot >= 3", 20),
    ("warn", "few_stopwords", "len(t) >= 30 AND stop < 0.2", 25),
    ("warn", "advertising", "len(t) >= 20 AND ads * CAST(100 AS DOUBLE) / greatest(n, 1) > 3", 25),
    ("warn", "few_sentences", "len(t) >= 40 AND (sentences < 2 OR CAST(n AS DOUBLE) / greatest(sentences, 1) < 5)", 20),
    ("soft", "brief", "n BETWEEN 50 AND 149", 10),
    ("soft", "shouting", "upper > 0.3 OR regexp_matches(text, '[!?]{3,}')", 5),
]
_SHARE = "CASE WHEN {1} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({0} AS DOUBLE) / {1} END"


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS n, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS sentences, regexp_extract_all(lower(text), '[a-z'']+') AS t, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS u,
  {_hits(text.AD_PATTERNS, "len(regexp_extract_all(text, '{}'))")} AS ads, {_hits(text.BOILERPLATE_PATTERNS, "CAST(regexp_matches(text, '{}') AS INTEGER)")} AS foot FROM d),
e AS (SELECT *, {_SHARE.format(f"len(list_filter(t, lambda x: x IN ({_STOP})))", "len(t)")} AS stop, {_SHARE.format("len(list_filter(u, lambda x: x = upper(x)))", "len(u)")} AS upper,
  {_SHARE.format(f"len(regexp_extract_all(text, '{text.GARBAGE}'))", "length(text)")} AS junk, {_SHARE.format("(len(regexp_extract_all(text, '[{};=]')) + len(regexp_extract_all(text, '=>')))", "length(text)")} AS code FROM c)
SELECT doc_id, CAST(greatest(0, 100 - ({" + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, _, c, p in _SOFT)})) AS INTEGER) AS score,
  CASE WHEN {" OR ".join(f"({c})" for k, _, c, _ in _SOFT if k == "reject")} THEN 'reject' WHEN {" OR ".join(f"({c})" for k, _, c, _ in _SOFT if k == "warn")} THEN 'warn' ELSE 'ok' END AS grade,
  concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{r}' END" for _, r, c, _ in _SOFT)}) AS reasons FROM e
""")
def quality_grade(spark: SparkSession, d: str) -> DataFrame:
    """Deductions and grade of every document."""
    return ops.quality(docs(spark, d)).select("doc_id", "score", "grade", F.array_join("reasons", ",").alias("reasons"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+', '[email]', 'g'), '\b[A-Za-z0-9_-]{24,}\b', '[token]', 'g') AS text FROM documents
""")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", safety.redact("text").alias("text"))


@query("SELECT conv_id, turn, " + " || ',' || ".join(f"CASE WHEN regexp_matches(text, '(?i){'|'.join(p)}') THEN '{k}' ELSE '' END" for k, p in safety.MODERATION.items()) + " AS flags FROM conversations")
def moderation_flags(spark: SparkSession, d: str) -> DataFrame:
    hits = safety.moderation("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(",", *[F.when(F.array_contains(hits, k), k).otherwise("") for k in safety.MODERATION]).alias("flags"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return ops.chunks(docs(spark, d), 500, 50)


@query("""
SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents
""")
def text_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.token_estimate("text").alias("tokens"), text.content_hash("text").alias("hash"))


@query("""
SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY lang
""")
def language_overview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query(r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host,
  nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '') AS title,
  CAST(len(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]*)["'']', 1)) AS INTEGER) AS links FROM pages
""")
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.host("url").alias("host"), html.title("html").alias("title"), F.size(html.links("html")).alias("links"))


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]*)["'']', 1)) AS href FROM pages)
SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, count(*) AS links, count(DISTINCT href) AS targets FROM l GROUP BY 1
""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select(html.host("url").alias("host"), F.explode(html.links("html")).alias("href"))
    return links.groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


@query(r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM pages
""")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(html.strip_tags("html").cast("binary")).alias("digest"))


@query("""
WITH s AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost FROM conversations),
r AS (SELECT conv_id, turn, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM s)
SELECT * FROM r WHERE spent <= 300
""")
def budgeted_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The newest turns of each conversation that fit a budget of tokens."""
    turns = table(spark, d, "conversations")
    return sequences.budgeted(turns, ["conv_id"], [F.desc("turn")], text.token_estimate("text"), 300).select("conv_id", "turn", "spent")


@query("""
SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn, count(*) FILTER (WHERE role = 'user') AS questions, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id
""")
def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("questions"), F.sum(F.length("text")).alias("chars"))


@query("""
SELECT quality, toxic, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3
""")
def label_matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations WHERE text IS NOT NULL),
c AS (SELECT conv_id, count(*) AS turns, string_agg(CASE WHEN n <= 20 THEN substr(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+', '[email]', 'g'), '\b[A-Za-z0-9_-]{24,}\b', '[token]', 'g'), 1, 200) END, chr(10) ORDER BY n) AS said FROM t GROUP BY 1)
SELECT conv_id, least(turns, 20) AS kept, md5(said) AS said_md5, '[redacted]' AS secret, '[truncated]' AS deep FROM c
""")
def stored_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of conversations, all turns in it, made fit to be stored: what is left of lists and texts, of a sensitive key and of a deep value."""
    said = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("said")))).alias("turns"))
    bag = F.to_json(F.struct("turns", F.struct(F.lit("x").alias("api_key")).alias("auth"), F.expr("named_struct('a', named_struct('b', named_struct('c', named_struct('d', turns[0]))))").alias("deep")))
    safe = said.select("conv_id", F.from_json(safety.safe_metadata(bag), "turns array<struct<said:string>>, auth map<string,string>, deep struct<a:struct<b:struct<c:struct<d:string>>>>").alias("m"))
    return safe.select("conv_id", F.size("m.turns").cast("long").alias("kept"), F.md5(F.array_join("m.turns.said", "\n")).alias("said_md5"), F.col("m.auth")["api_key"].alias("secret"), F.col("m.deep.a.b.c.d").alias("deep"))
