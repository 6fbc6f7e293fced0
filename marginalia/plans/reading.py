"""Queries on words and pages: extraction, clean-up, discovery, difficulty, cloze cards, practice, quality in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import blocks, html, lexical, markup, text
from marginalia.functions.math import rnd
from marginalia.operators import documents, extract, lexicon, routing
from marginalia.plans.registry import query
from marginalia.sources.tables import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS t FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM t WHERE len(t) >= 3),
n AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(max(n) AS INTEGER) AS most, floor(CAST(max(n) AS DOUBLE) / sum(n) * 10000 + 0.5) / 10000 AS ratio, max(n) >= 5 AND max(n) / sum(n) >= 0.08 AS repetitive FROM n GROUP BY doc_id
""")
def top_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """The commonest trigram's count and share of each text of three words or more."""
    rows = docs(spark, d).select("doc_id", text.tokens("text").alias("t")).where(F.size("t") >= 3)
    rows = rows.select("doc_id", documents.trigram_runs(F.col("t"))["most"].alias("most"), (F.size("t") - 2).alias("n"))
    share = F.col("most") / F.col("n")
    return rows.select("doc_id", "most", rnd(share, 4).alias("ratio"), ((F.col("most") >= 5) & (share >= 0.08)).alias("repetitive"))


def _count(p: str) -> str:
    return "len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))"


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE floor(CAST({_count("[{};=]")} + {_count("=>")} AS DOUBLE) / length(text) * 1000000 + 0.5) / 1000000 END AS density, CAST({" + ".join(_count(p) for p in extract.CODE_TOKENS)} AS INTEGER) AS hits FROM d
""")
def code_signals(spark: SparkSession, d: str) -> DataFrame:
    """How much each text looks like source code."""
    density, hits = extract.code_signal("text")
    return docs(spark, d).select("doc_id", rnd(density, 6).alias("density"), hits.alias("hits"))


@query(r"""
WITH s AS (SELECT page_id, url, html, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages),
i AS (SELECT page_id, len(list_filter(regexp_extract_all(html, '(?is)<(?:p|li|h[2-6])\b[^>]*>\s*(?:<[^>]+>\s*)*([1-9]\.?\s+[A-Z].*?)</(?:p|li|h[2-6])>', 1), lambda x: length(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) <= 180)) AS items,
  len(regexp_extract_all(text, '\b[1-9]\.?\s+[A-Z][^.!?]{5,120}')) AS plain,
  len(list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: length(x) BETWEEN 1 AND 120 AND regexp_matches(x, '^[A-Z0-9]') AND regexp_matches(x, '[a-z]'))) AS strong FROM s)
SELECT page_id, CAST(greatest(items, plain) AS INTEGER) AS numbered, CAST(strong AS INTEGER) AS strong, 0 AS outbound FROM i
""")
def digest_signals(spark: SparkSession, d: str) -> DataFrame:
    """Numbered items, bold headlines and links in brackets of each page."""
    signs = extract.digest_signal("html", "text", "url")
    return pages(spark, d).withColumn("text", html.strip_tags("html")).select("page_id", *[v.alias(k) for k, v in signs.items()])


@query(r"""
WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|template)\b.*?</(script|style|noscript|template)\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS html FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), '(?i)<(p|h[1-6])\b', '</p><\1', 'g') || '</p>' AS scope FROM c),
b AS (SELECT page_id, unnest(regexp_extract_all(scope, '(?is)<(?:p|h[2-6])\b[^>]*>(.*?)</(?:p|h[2-6])>', 1)) AS block FROM s),
t AS (SELECT page_id, trim(replace(replace(replace(replace(regexp_replace(block, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), E' \t\n\r') AS text FROM b)
SELECT page_id, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words FROM t WHERE text <> '' GROUP BY page_id
""")
def harvested_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The text blocks of each page's scope, from its tree: how many, and how long. The SQL is made for pages whose article holds headings and paragraphs only, closed or not."""
    rows = pages(spark, d).withColumn("tree", markup.tree("html"))
    rows = rows.select("page_id", "tree", F.explode(blocks.harvest("tree", F.array(blocks.scope("tree")), "url")).alias("e")).withColumn("t", blocks.text_of("tree", F.col("e")))
    return rows.groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum(F.col("e.chars").cast("long")).alias("chars"), F.sum(text.word_count("t").cast("long")).alias("words"))


@query()
def content_origins(spark: SparkSession, d: str) -> DataFrame:
    """Where each page's content comes from, how many words both ways give, and how long the chosen HTML is."""
    made = extract.content(pages(spark, d), own=html.json_text(html.json_ld("html"), "$.articleBody"), title=html.title("html"))
    return made.select("page_id", "origin", "harvest_words", "readable_words", F.length("content").alias("chars"))


@query()
def decluttered_pages(spark: SparkSession, d: str) -> DataFrame:
    """What looks like clutter on whole pages, what of it is removed, and the share of the text that stays."""
    made = extract.decluttered(pages(spark, d).withColumn("c", html.without_scripts("html")), "c")
    return made.select("page_id", "candidates", "removed", F.round("kept_share", 6).alias("kept_share"), F.md5("c").alias("digest"))


@query()
def sanitised_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page as allow-listed HTML: its length, elements and digest."""
    made = pages(spark, d).select("page_id", markup.sanitise("html", "url").alias("c"))
    return made.select("page_id", F.length("c").alias("chars"), F.regexp_count("c", F.lit("<[a-z]")).alias("elements"), F.md5("c").alias("digest"))


@query()
def extract_articles(spark: SparkSession, d: str) -> DataFrame:
    """The pages that are articles, with all fields."""
    made = extract.articles(pages(spark, d), categories={"sci": "science", "tech": "technology", "news": "world"})
    return made.select("page_id", "title", "author", "image", "published", "category", "words", "minutes", F.md5("body").alias("digest"), F.length("excerpt").alias("excerpt_chars"))


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]*)["'']', 1)) AS href FROM pages),
f AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END, '#.*$', '') AS link,
  regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM l)
SELECT min(page_id) AS page_id, link FROM f WHERE regexp_replace(lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') = host AND regexp_matches(link, '/[a-z]+$') GROUP BY link
""")
def discovered_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages to their own host that look like articles, each once."""
    return extract.discovered(pages(spark, d), pattern="/[a-z]+$")


@query(r"""
WITH p AS (SELECT c_nationkey AS seed, CAST(c_custkey % 5 AS INTEGER) AS page, CASE WHEN c_acctbal > 2000 THEN c_mktsegment || c_custkey % 3 END AS link FROM customer),
f AS (SELECT seed, link, min(page) AS page FROM p WHERE link IS NOT NULL GROUP BY 1, 2), a AS (SELECT DISTINCT seed, page FROM p),
n AS (SELECT a.seed, a.page, count(f.link) AS new FROM a LEFT JOIN f ON f.seed = a.seed AND f.page = a.page GROUP BY 1, 2),
w AS (SELECT *, sum(new) OVER v AS s, count(*) OVER v AS k FROM n WINDOW v AS (PARTITION BY seed ORDER BY page ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
t AS (SELECT seed, min(page) AS stop FROM w WHERE s = 0 AND k = 2 GROUP BY 1)
SELECT f.seed, f.page, f.link FROM f LEFT JOIN t ON t.seed = f.seed WHERE stop IS NULL OR f.page <= stop QUALIFY row_number() OVER (PARTITION BY f.seed ORDER BY f.page, f.link) <= 6
""")
def seed_crawl(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl of each seed's listing pages brings, up to its limit, and stopped by two pages without anything new."""
    listing = table(spark, d, "customer").select(F.col("c_nationkey").alias("seed"), (F.col("c_custkey") % 5).cast("int").alias("page"), F.when(F.col("c_acctbal") > 2000, F.concat("c_mktsegment", (F.col("c_custkey") % 3).cast("string"))).alias("link"))
    return extract.seed_crawl(listing, 6)


@query(r"""
WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(coalesce(text, ''), '(?:\r?\n){2,}'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN strlen(text) > 200000 THEN 'too_large' END AS refused, len(p) AS paragraphs FROM p
""")
def import_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of texts to import, and which are refused at once."""
    made = extract.imported(docs(spark, d), "doc_id")
    return made.select("doc_id", F.when(F.col("refused") != "too_short", F.col("refused")).alias("refused"), F.regexp_count("body", F.lit("<p>")).cast("long").alias("paragraphs"))


@query(r"""
WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '\n{2,}'), lambda s: regexp_replace(s, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda s: s <> '') AS p FROM conversations)
SELECT conv_id, turn, len(p) AS paragraphs, md5(array_to_string(p, '|')) AS digest FROM t
""")
def answer_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each turn."""
    rows = table(spark, d, "conversations").withColumn("p", lexical.text_paragraphs("text"))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("paragraphs"), F.md5(F.array_join("p", "|")).alias("digest"))


@query()
def answer_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Markdown blocks of each turn by type."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(lexical.blocks("text")).alias("b"))
    return rows.groupBy("conv_id", "turn", "b.type").agg(F.count("*").alias("blocks"), F.sum(F.size("b.lines")).alias("lines"))


@query(rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{lexical.TYPED_TOKEN.replace("'", "''")}') AS w FROM documents)
SELECT doc_id, len(w) AS tokens, md5(array_to_string(list_transform(w, lambda x: coalesce(nullif(regexp_replace(lower(trim(x)), '[^a-z0-9]', '', 'g'), ''), lower(trim(x)))), ' ')) AS keys FROM w
""")
def spoken_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Spoken tokens of each text and the keys to compare them by."""
    words = F.regexp_extract_all("text", F.lit(lexical.TYPED_TOKEN), F.lit(0))
    rows = docs(spark, d).withColumn("w", words)
    return rows.select("doc_id", F.size("w").cast("long").alias("tokens"), F.md5(F.array_join(F.transform("w", lexical.comparable), " ")).alias("keys"))


@query()
def practice_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each text that are fit for practice."""
    rows = docs(spark, d).withColumn("s", lexical.practice_sentences("text"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query()
def cloze_cards(spark: SparkSession, d: str) -> DataFrame:
    """A card for each document: the word 'then' or a form of it, blanked out of the first sentence that holds one; without such a sentence, what the first one gives."""
    said = F.coalesce(text.sentences("text"), F.array().cast("array<string>"))
    cards = F.transform(said, lambda s: lexical.cloze(F.lit("then"), s))
    rows = docs(spark, d).withColumn("cards", cards)
    good = F.get(F.filter("cards", lambda c: c["masked"].isNotNull() & (c["answer"].isNotNull())), F.lit(0))
    rows = rows.select("doc_id", F.coalesce(good, F.get("cards", F.lit(0)), lexical.cloze(F.lit("then"), F.lit(""))).alias("c"))
    return rows.select("doc_id", "c.masked", "c.answer", "c.reason")


@query()
def dictation_grades(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of each document as if it had been typed without every third word."""
    rows = docs(spark, d).select("doc_id", F.posexplode_outer(text.sentences("text")).alias("sentence", "r"))
    words = F.split("r", r"\s+")
    typed = F.array_join(F.transform(words, lambda w, i: F.when(i % 3 == 2, F.lit("")).otherwise(w)), " ")
    rows = rows.select(F.concat_ws(":", "doc_id", F.coalesce("sentence", F.lit(0))).alias("key"), F.coalesce("r", F.lit("")).alias("r"), F.coalesce(typed, F.lit("")).alias("t"))
    made = lexicon.dictation(rows, "key", "r", "t")
    at = F.split("key", ":")
    return made.select(at[0].cast("long").alias("doc_id"), at[1].cast("int").alias("sentence"), *[c for c in made.columns if c != "key"])


@query()
def difficulty_scores(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty, level and reading measure of every text, with bands from the corpus's own ranks."""
    rows = docs(spark, d)
    made = lexicon.difficulty(rows, lexicon.bands(lexicon.corpus_ranks(rows)))
    return made.select("doc_id", "score", "level", "lexile", "confidence", "vocabulary", rnd("readability", 2).alias("readability"), "syntax", "idiom", "length")


@query()
def article_grades(spark: SparkSession, d: str) -> DataFrame:
    """All checks of every page's quality."""
    p = pages(spark, d).withColumn("text", html.strip_tags(html.without_scripts("html"))).withColumn("words", text.word_count("text"))
    p = p.withColumns({"author": html.meta("html", "author"), "published": html.meta("html", "article:published_time"), "lang": F.regexp_extract("html", r'<html[^>]*\blang="([a-z]+)"', 1), "ad": F.lit(None).cast("double")})
    made = documents.grade(p.select("page_id", "text", "html", "url", "words", "author", "published", "lang", "ad"))
    return made.select("page_id", "score", "grade", F.array_join("failed", ",").alias("failed"), "recoverable")


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"
_RULES = f"""
SELECT rule, suffix, pattern, category FROM (
  SELECT DISTINCT 3 * length(h) AS rule, regexp_extract(h, '[^.]+\\.[^.]+$') AS suffix, NULL AS pattern, 'site' AS category FROM (SELECT {_HOST} AS h FROM pages) WHERE length(h) % 3 = 0
  UNION SELECT DISTINCT 3 * page_id + 1, {_HOST}, '/en/', 'english' FROM pages WHERE page_id % 5 = 0
  UNION SELECT DISTINCT 3 * page_id + 2, {_HOST}, '[0-9]{{3}}', 'numbered' FROM pages WHERE page_id % 7 = 0)"""


@query(f"""
WITH r AS ({_RULES}), p AS (SELECT page_id, url, {_HOST} AS h FROM pages),
m AS (SELECT page_id, rule, category, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC, rule) AS k FROM p JOIN r ON (h = suffix OR ends_with(h, '.' || suffix)) AND (pattern IS NULL OR regexp_matches(url, pattern)))
SELECT p.page_id, CAST(m.rule AS BIGINT) AS rule, m.category FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
""")
def page_routes(spark: SparkSession, d: str) -> DataFrame:
    """The rule that every page falls under, of rules for whole sites and for some addresses of some hosts."""
    p = pages(spark, d).select("page_id", "url", html.host("url").alias("h"))
    sites = p.where(F.length("h") % 3 == 0).select((3 * F.length("h")).cast("long").alias("rule"), F.regexp_extract("h", r"[^.]+\.[^.]+$", 0).alias("suffix"), F.lit(None).cast("string").alias("pattern"), F.lit("site").alias("category")).distinct()
    some = lambda n, k, pattern, name: p.where(F.col("page_id") % n == 0).select((3 * F.col("page_id") + k).alias("rule"), F.col("h").alias("suffix"), F.lit(pattern).alias("pattern"), F.lit(name).alias("category"))
    rules = sites.unionByName(some(5, 1, "/en/", "english")).unionByName(some(7, 2, "[0-9]{3}", "numbered"))
    return routing.routed(p, rules)


@query(r"""
WITH t AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?\n]+') AS s FROM documents), u AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS sentence FROM t),
w AS (SELECT doc_id, sentence, regexp_extract_all(s, '[A-Za-z'']+') AS w FROM u)
SELECT doc_id, CAST(sum(len(list_distinct(list_filter(w[2:], lambda x: regexp_matches(x, '^(?:[A-Z]{2,}|[A-Z][a-z]+(?:[A-Z][a-z]+)*)$'))))) AS BIGINT) AS names FROM w GROUP BY 1
""")
def name_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document's sentences that look like names, each counted once a sentence."""
    said = F.split("text", r"[.!?\n]+", -1)
    return docs(spark, d).select("doc_id", F.aggregate(F.transform(said, lambda s: F.size(lexical.proper_nouns(s)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("names"))
