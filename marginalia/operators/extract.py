"""Articles out of web pages: fields by precedence, bodies, links to crawl, imports, and their quality in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import blocks as b
from marginalia.functions import html as h
from marginalia.functions import markup as m
from marginalia.functions import text as tx
from marginalia.functions.dates import safe_timestamp
from marginalia.functions.math import reading_minutes
from marginalia.sources.tables import allowed_paths

MIN_WORDS = 50


#: The harvest is kept if it has more than so many times the words of the likeliest article; that one stands in for JSON-LD's text if it has images and this share of its words.
HARVEST_RATIO, IMAGE_RATIO = 1.5, 0.6


def content(pages: DataFrame, html: str = "html", url: str = "url", own: Column | None = None, title: Column | None = None) -> DataFrame:
    """Adds to pages where their content comes from (origin: json, harvest or readable), the content's HTML as `content`, and harvest_words and readable_words.

    The harvest is the blocks of the page's scope; the likeliest article those of the best-scored element and its siblings, which
    counts if the page has a title and it has 50 words. `own` is the page's JSON-LD text, if any.
    """
    own = F.lit(None).cast("string") if own is None else own
    rows = pages.withColumn("_tree", m.tree(h.without_scripts(html))).withColumn("_page", h.without_scripts(html))
    rows = rows.withColumn("_given", b.contributions("_tree"))
    rows = rows.withColumn("_scored", b.candidates("_tree", "_given"))
    rows = rows.withColumn("_harvest", b.harvest("_tree", F.array(b.scope("_tree")), url)).withColumn("_read", b.harvest("_tree", b.readable_scopes("_tree", "_scored"), url))
    words = lambda es: F.coalesce(tx.word_count(F.array_join(F.transform(es, lambda e: b.text_of("_tree", e)), "\n")), F.lit(0))
    rows = rows.withColumns({"harvest_words": words(F.col("_harvest")), "readable_words": words(F.col("_read")), "_own": F.nullif(F.trim(own), F.lit("")), "_titled": F.lit(True) if title is None else title.isNotNull()})
    usable = F.col("_titled") & (F.col("readable_words") >= MIN_WORDS)
    images = F.exists("_read", lambda e: (e["tag"] == "img") | F.exists(F.col("_tree")["elements"], lambda x: (x["tag"] == "img") & b.inside(x, e)))
    better = usable & images & (F.col("readable_words") >= tx.word_count("_own") * IMAGE_RATIO)
    origin = F.when(F.col("_own").isNotNull(), F.when(better, "readable").otherwise("json")).when(usable & (F.col("harvest_words") <= F.col("readable_words") * HARVEST_RATIO), "readable").otherwise("harvest")
    write = b.block_html("_page", url)
    made = F.array_join(F.transform(F.when(F.col("origin") == "readable", F.col("_read")).otherwise(F.col("_harvest")), write), "\n")
    told = F.array_join(F.transform(F.filter(F.transform(F.split("_own", r"\n{2,}"), F.trim), lambda p: p != ""), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit(" ")), F.lit("</p>"))), "\n")
    rows = rows.withColumn("origin", origin).withColumn("content", F.when(F.col("origin") == "json", told).otherwise(made))
    return rows.drop("_tree", "_page", "_given", "_scored", "_harvest", "_read", "_own", "_titled")


def decluttered(rows: DataFrame, html: str = "content", author: Column | None = None) -> DataFrame:
    """Takes clutter out of a column of HTML; adds candidates and removed (counts of elements) and kept_share (of the text's characters)."""
    author = F.lit(None).cast("string") if author is None else author
    rows = rows.withColumn("_tree", m.tree(html)).withColumn("_leaves", b.leaf_blocks("_tree"))
    rows = rows.withColumn("_found", b.clutter("_tree", "_leaves", author))
    rows = rows.withColumn("_gone", b.removals("_tree", "_found")).withColumn("_cut", b.emptied("_tree", "_gone"))
    whole = F.get("_tree.elements", F.lit(0))["chars"]
    share = F.when(whole == 0, 1.0).otherwise(1 - b.total(F.transform("_gone", lambda e: e["chars"])) / whole)
    rows = rows.withColumns({"candidates": F.size(F.array_distinct(F.transform("_found", lambda x: x["e"]["at"]))), "removed": F.size("_gone"), "kept_share": share, html: F.trim(b.without(html, "_cut"))})
    return rows.drop("_tree", "_leaves", "_found", "_gone", "_cut")


def articles(pages: DataFrame, key: str = "page_id", categories: dict[str, str] | None = None) -> DataFrame:
    """A row for each page that has a title and a body of 50 words: title, author, image, section, published, category, origin, body (HTML), text, words, minutes, excerpt.

    Fields come from JSON-LD first, then from meta tags, then from the page. The body is what `content` chooses, without clutter, sanitised.
    """
    rows = pages.withColumn("_ld", h.json_ld("html"))
    ld = F.col("_ld")
    rows = rows.select(
        key, "url", "html", "_ld",
        h.decode(F.coalesce(h.json_text(ld, "$.headline", "$.name"), h.meta("html", "og:title"), h.title("html"))).alias("title"),
        h.decode(F.coalesce(h.json_author(ld), h.meta("html", "author"), h.meta("html", "article:author"))).alias("author"),
        h.absolute("url", F.coalesce(h.json_image(ld), h.meta("html", "og:image"))).alias("image"),
        F.coalesce(h.json_text(ld, "$.articleSection"), h.meta("html", "article:section"), h.meta("html", "og:article:section"), h.meta("html", "parsely-section"), h.meta("html", "news_keywords")).alias("section"),
        safe_timestamp(F.coalesce(h.json_text(ld, "$.datePublished"), h.meta("html", "article:published_time"), h.meta("html", "datePublished"))).alias("published"),
        F.coalesce(h.json_text(ld, "$.description"), h.meta("html", "og:description"), h.meta("html", "description")).alias("_said"),
    )
    rows = content(rows.where("title is not null"), own=h.json_text(F.col("_ld"), "$.articleBody"), title=F.col("title"))
    rows = decluttered(rows.drop("html", "_ld"), author=F.col("author")).withColumn("body", F.trim(m.sanitise("content", "url")))
    rows = rows.withColumn("text", h.decode(h.strip_tags("body"))).withColumn("words", tx.word_count("text"))
    kept = rows.where(F.col("words") >= MIN_WORDS)
    return kept.withColumns({"minutes": reading_minutes("words"), "excerpt": F.coalesce("_said", tx.excerpt("text")), "category": h.section_category("section", categories or {})}).drop("_said", "content", "candidates", "removed", "kept_share", "harvest_words", "readable_words")


def discovered(pages: DataFrame, host: Column | None = None, pattern: str = "^https?://", rules: DataFrame | None = None, limit: int | None = None, key: str = "page_id") -> DataFrame:
    """Links of pages to crawl: key, link. Absolute, without a fragment, on the wanted host (the page's own by default), matching the pattern, each once for the page that is first; those that robots rules forbid left out; at most `limit` of each page (a crawl's limit is its feature)."""
    links = pages.select(key, "url", F.posexplode(h.links("html")).alias("_at", "_href"))
    full = links.select(key, "_at", F.regexp_replace(h.absolute("url", "_href"), "#.*$", "").alias("link"), (h.host("url") if host is None else host).alias("_host"))
    good = full.where((h.host("link") == F.col("_host")) & F.col("link").rlike(pattern))
    once = good.groupBy("link").agg(F.min(F.struct(F.col(key), F.col("_at"))).alias("_first")).select(F.col(f"_first.{key}").alias(key), F.col("_first._at").alias("_at"), "link")
    if rules is not None:
        paths = once.select(h.host("link").alias("host"), F.regexp_replace("link", "^https?://[^/]+", "").alias("path")).distinct()
        allowed = allowed_paths(paths, rules).where("allowed").select(F.col("host").alias("_h"), F.col("path").alias("_p"))
        once = once.join(allowed, (h.host("link") == F.col("_h")) & (F.regexp_replace("link", "^https?://[^/]+", "") == F.col("_p")), "left_semi")
    if limit is None:
        return once.select(key, "link")
    from marginalia.operators.sequences import newest

    return newest(once, [key], [F.col("_at"), F.col("link")], limit).select(key, "link")


def seed_crawl(listing: DataFrame, limit: int, empty_stop: int = 2) -> DataFrame:
    """listing: seed, page, link. New links of each seed's pages in order, until `empty_stop` pages in a row bring none, at most `limit` a seed: seed, page, link."""
    from pyspark.sql import Window

    first = listing.where(F.col("link").isNotNull()).groupBy("seed", "link").agg(F.min("page").alias("page"))
    fresh = listing.select("seed", "page").distinct().join(first.groupBy("seed", "page").agg(F.count("*").alias("new")), ["seed", "page"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    w = Window.partitionBy("seed").orderBy("page").rowsBetween(-(empty_stop - 1), 0)
    dry = fresh.withColumn("_dry", (F.sum("new").over(w) == 0) & (F.count("*").over(w) == empty_stop))
    stop = dry.where("_dry").groupBy("seed").agg(F.min("page").alias("_stop"))
    kept = first.join(stop, "seed", "left").where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
    from marginalia.operators.sequences import newest

    return newest(kept, ["seed"], [F.col("page"), F.col("link")], limit).select("seed", "page", "link")


def imported(df: DataFrame, key: str, text: str = "text", least: int = MIN_WORDS, most_bytes: int = 200_000) -> DataFrame:
    """Private imports: paragraphs as sanitised HTML, with words and minutes; rows whose text is blank, longer than most_bytes or of fewer words are refused (with the reason)."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?:\r?\n){2,}"), lambda x: F.trim(x)), lambda p: p != "")
    body = m.sanitise(F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "\n"))
    rows = df.withColumn("body", body).withColumn("words", tx.word_count(h.strip_tags("body")))
    refused = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "empty").when(F.octet_length(text) > most_bytes, "too_large").when(F.col("words") < least, "too_short")
    return rows.select(key, refused.alias("refused"), "body", "words", reading_minutes("words").alias("minutes"))


# Patterns of source code, of paywalls, and of digests.
CODE_TOKENS = (
    r"\bfunction\s*\(", r"=>", r"=\s*function\b", r"\bvar\s+[A-Za-z_$]", r"\b(?:let|const)\s+[A-Za-z_$]", r"\.prototype\b", r"\baddEventListener\b", r"\bNREUM\b",
    r"\b(?:typeof|undefined|null|return|else|catch|new)\b\s*[({\[]", r"\)\s*\{", r"\}\s*\)", r";\s*\}", r"\.(?:push|call|apply|bind|forEach|map)\s*\(",
)


def code_signal(c) -> tuple[Column, Column]:
    """Share of code symbols among a text's characters, and the number of code patterns in it. Texts without any of the patterns' marks are told by one pass."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    hits = reduce(Column.__add__, [F.regexp_count(t, F.lit(p)) for p in CODE_TOKENS])
    return tx.code_symbol_density(t), F.when(t.rlike(r"[=({\[]|\.prototype|addEventListener|NREUM|\b(?:var|let|const)\s|;\s*\}"), hits).otherwise(0)


def digest_signal(html, text, url) -> dict[str, Column]:
    """Signs of a digest: numbered items, short bold headlines, and links in brackets to other hosts."""
    c, t = F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    items = F.size(F.filter(F.regexp_extract_all(c, F.lit(r"(?is)<(?:p|li|h[2-6])\b[^>]*>\s*(?:<[^>]+>\s*)*([1-9]\.?\s+[A-Z].*?)</(?:p|li|h[2-6])>"), F.lit(1)), lambda x: F.length(h.strip_tags(x)) <= 180))
    plain = F.regexp_count(t, F.lit(r"\b[1-9]\.?\s+[A-Z][^.!?]{5,120}"))
    bold = F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>"), F.lit(1)), h.strip_tags)
    strong = F.size(F.filter(bold, lambda x: (F.length(x) > 0) & (F.length(x) <= 120) & x.rlike("^[A-Z0-9]") & x.rlike("[a-z]")))
    out = F.filter(F.regexp_extract_all(c, F.lit(r"""(?is)\(\s*<a\b[^>]*href=["'](https?://[^"']+)["'][^>]*>.{1,120}?</a>\s*\)"""), F.lit(1)), lambda x: h.host(x) != h.host(url))
    return {"numbered": F.greatest(items, plain), "strong": strong, "outbound": F.size(out)}
