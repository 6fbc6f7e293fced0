"""Expressions over raw HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.math import col

# The named entities that are decoded, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def decode(c) -> Column:
    """Numeric entities, decimal and hexadecimal, then the named ones. Each distinct numeric one is replaced once, inside the JVM."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("(?i)&#(?:x0*[0-9a-f]{1,5}|0*[0-9]{1,6});"), F.lit(0)))

    def char(e: Column) -> Column:
        body = F.regexp_replace(F.lower(e), "^&#|;$", "")
        code = F.when(body.startswith("x"), F.conv(F.substring(body, 2, 20), 16, 10)).otherwise(body).cast("int")
        good = (code > 0) & ((code < 0xD800) | (code > 0xDFFF))
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    out = F.aggregate(found, col(c), lambda text, e: F.replace(text, e, F.coalesce(char(e), e)))
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def strip_tags(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "<[^>]*>", " "), r"\s+", " "))


def without_scripts(c) -> Column:
    """Without scripts, styles, comments, event handlers and style attributes."""
    out = F.regexp_replace(col(c), r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(out, r"""(?i)\s(?:on[a-z]+|style)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "")


def title(c) -> Column:
    return F.nullif(strip_tags(F.regexp_extract(col(c), r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta(c, key: str) -> Column:
    """Content of a meta tag by name or property, whichever attribute comes first."""
    a = F.regexp_extract(col(c), rf"""(?is)<meta\b[^>]*(?:name|property)=["']{key}["'][^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(col(c), rf"""(?is)<meta\b[^>]*content=["']([^"']*)["'][^>]*(?:name|property)=["']{key}["']""", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def paragraphs(c) -> Column:
    """Texts of p elements that aren't blank, decoded."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: decode(strip_tags(x))), lambda x: x != "")


def links(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"""(?is)<a\b[^>]*href=["']([^"'#]*)["']"""), F.lit(1))


def absolute(base, href) -> Column:
    origin = F.regexp_extract(col(base), r"^(https?://[^/?#]+)", 1)
    return F.when(col(href).rlike("(?i)^https?://"), col(href)).when(col(href).startswith("//"), F.concat(F.lit("https:"), col(href))).when(col(href).startswith("/"), F.concat(origin, col(href))).otherwise(F.concat(F.regexp_replace(F.regexp_replace(col(base), r"[?#].*$", ""), r"[^/]*$", ""), col(href)))


def host(url) -> Column:
    """Lower-case host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(col(url), r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def link_density(c) -> Column:
    text = F.length(strip_tags(c))
    inside = F.length(F.array_join(F.transform(F.regexp_extract_all(col(c), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", " "))), " "))
    return F.when(text == 0, 0.0).otherwise(inside / text)


def json_ld(c) -> Column:
    """The first node of a page's JSON-LD blocks that is an article, as JSON text: blocks, arrays of nodes and graphs are looked through in order."""
    raw = F.regexp_extract_all(col(c), F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    none = F.array().cast("array<string>")
    listed = lambda x: F.coalesce(F.from_json(x, "array<string>"), none)
    nodes = lambda x: F.concat(F.array(x), F.when(F.trim(x).startswith("["), listed(x)).otherwise(none))
    graph = lambda x: F.concat(F.array(x), listed(F.get_json_object(x, "$.@graph")))
    every = F.flatten(F.transform(F.flatten(F.transform(raw, nodes)), graph))
    kinds = r"(?:^|[\"\[,])\s*(?:NewsArticle|Article|Report|BlogPosting|ReportageNewsArticle)\s*(?:$|[\"\],])"
    return F.get(F.filter(every, lambda n: F.coalesce(F.get_json_object(n, "$.@type"), F.lit("")).rlike(kinds)), F.lit(0))


def json_text(node, *paths: str) -> Column:
    """The first of some JSON paths that gives a text that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(col(node), p)), F.lit("")) for p in paths])


def json_author(node) -> Column:
    """The author of a JSON-LD node: a text, an object's name, or the names of a list, joined."""
    a = F.get_json_object(col(node), "$.author")
    one = lambda x: F.coalesce(F.when(F.trim(x).startswith("{"), F.get_json_object(x, "$.name")).otherwise(x), F.lit(""))
    many = F.array_join(F.filter(F.transform(F.coalesce(F.from_json(a, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(one(x))), lambda x: x != ""), ", ")
    return F.nullif(F.trim(F.when(F.trim(a).startswith("["), many).otherwise(one(a))), F.lit(""))


def json_image(node) -> Column:
    """The image of a JSON-LD node: a text, an object's url, or the first of a list."""
    i = F.get_json_object(col(node), "$.image")
    one = lambda x: F.when(F.trim(x).startswith("{"), F.get_json_object(x, "$.url")).otherwise(x)
    first = F.get(F.filter(F.transform(F.coalesce(F.from_json(i, "array<string>"), F.array().cast("array<string>")), one), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.lit(0))
    return F.nullif(F.trim(F.when(F.trim(i).startswith("["), first).otherwise(one(i))), F.lit(""))


def section_category(section, table: dict[str, str]) -> Column:
    """A category for the first of some keys that a section's name holds; null without one."""
    low = F.lower(F.coalesce(col(section), F.lit("")))
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in table.items()])


# The elements and attributes that sanitised articles may have, and words that mark an advertising block's class or id.
ALLOWED = "p br hr h1 h2 h3 h4 h5 h6 blockquote ul ol li strong b em i u s sup sub code pre a img figure figcaption table thead tbody tr th td".split()
AD_CLASS = r"\b(?:ad|ads|adsense|advert|advertisement|sponsor|sponsored|promo|promotion|newsletter|subscribe|signup|social|share|sharing|related|recommend|comment|cookie|consent|popup|modal|overlay|paywall|banner)\b"


def drop_blocks(c, tags: tuple[str, ...] = (), class_words: tuple[str, ...] = (), text_words: tuple[str, ...] = (), href_words: tuple[str, ...] = (), captions: bool = False) -> Column:
    """A source's cleanup rules: elements by name, containers by a word in class or id, short paragraphs (1000 characters) by a word in their text, links by a word in their address, captions."""
    import re

    out = col(c)
    either = lambda words: "|".join(map(re.escape, words))
    for t in tags:
        out = F.regexp_replace(out, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>|<{t}\b[^>]*/?>", "")
    if class_words:
        out = F.regexp_replace(out, rf"""(?is)<(div|section|aside|nav|header|footer|ul|figure|p)\b[^>]*(?:class|id|role|aria-label|data-[a-z-]+)\s*=\s*["'][^"']*(?:{either(class_words)})[^"']*["'][^>]*>.*?</\1\s*>""", "")
    if href_words:
        out = F.regexp_replace(out, rf"""(?is)<a\b[^>]*href=["'][^"']*(?:{either(href_words)})[^"']*["'][^>]*>.*?</a\s*>""", "")
    if captions:
        out = F.regexp_replace(out, r"(?is)<figcaption\b[^>]*>.*?</figcaption\s*>", "")
    if text_words:
        out = F.regexp_replace(out, rf"(?is)<(p|li)\b[^>]*>(?=(?:(?!</\1).){{0,1000}}</\1)(?:(?!</\1).)*?(?:{either(text_words)})(?:(?!</\1).)*</\1\s*>", "")
    return out


def merged_rules(*rules: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The union of cleanup rules, each word once, in order."""
    out: dict[str, tuple[str, ...]] = {}
    for r in rules:
        for k, words in r.items():
            out[k] = tuple(dict.fromkeys((*out.get(k, ()), *words)))
    return out


def reader_blocks(c) -> Column:
    """Texts of an article's blocks in order, decoded, blank ones left out; list items one by one."""
    parts = F.regexp_extract_all(col(c), F.lit(r"(?is)<(?:p|h[1-6]|li|blockquote|pre|figcaption)\b[^>]*>(?:(?!<(?:p|h[1-6]|li|blockquote|pre|figcaption)\b).)*"), F.lit(0))
    return F.filter(F.transform(parts, lambda x: decode(strip_tags(x))), lambda x: x != "")
