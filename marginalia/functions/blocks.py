"""What to take from a page's tree (see functions.markup): the content scope, its blocks, the likeliest article, and what is clutter.

A tree is one row's array, so everything here stays inside the row: no page is shuffled. Costs grow with an element
list times a short list made from it (blocks, links, candidates).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.html import absolute
from marginalia.functions.markup import FURNITURE
from marginalia.functions.math import col, let

# Elements that hold content, show that a container has some, and may be taken away as blocks.
HARVEST = "p h2 h3 h4 h5 h6 ul ol blockquote figure figcaption img iframe a".split()
CONTENT = "p h2 h3 h4 h5 h6 li blockquote".split()
CONTAINERS = "div section article main".split()
BLOCKS = "p div section aside ul ol figure blockquote nav header footer h1 h2 h3 h4 h5 h6".split()
MEDIA = "img figure video audio iframe svg".split()
VIDEO = r"(?i)^https?://(?:(?:[^/?#@]*\.)?(?:youtube|vimeo)\.com|(?:www\.)?youtu\.be)(?:[:/?#]|$)"
#: A container is the scope if it has this share of the page's paragraph text.
MOST_PROSE = 0.9


def inside(e: Column, of: Column) -> Column:
    return (e["at"] > of["at"]) & (e["at"] <= of["last"])


def tagged(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def text_of(tree, e: Column) -> Column:
    return F.substring(col(tree)["text"], e["start"] + 1, e["stop"] - e["start"])


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def source_of(page, e: Column) -> Column:
    """An element's own markup, closed where the page leaves it open."""
    own = F.substring(col(page), e["from"] + 1, e["to"] - e["from"])
    closed = e["tag"].isin("img", "br", "hr") | F.lower(F.right(own, F.lit(16))).rlike(r"</[a-z0-9]+\s*>$")
    return F.when(closed, own).otherwise(F.concat(own, F.lit("</"), e["tag"], F.lit(">")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def scope(tree) -> Column:
    """The first article that holds content, else the first main, else the first container with the most paragraph text if that is nine tenths of the body's, else the body, else the page."""
    es = col(tree)["elements"]
    holds = lambda e: F.exists(es, lambda x: inside(x, e) & ((x["tag"].isin(*CONTENT) & (x["chars"] > 0)) | x["tag"].isin("img", "figure")))
    named = lambda tag: F.get(F.filter(F.slice(tagged(es, tag), 1, 1), holds), F.lit(0))
    body = F.get(tagged(es, "body"), F.lit(0))
    first_most = lambda boxes: let(F.array_max(F.transform(boxes, lambda e: e["prose"])), lambda most: F.get(F.filter(boxes, lambda e: e["prose"] == most), F.lit(0)))
    largest = lambda whole: let(F.filter(tagged(es, *CONTAINERS), lambda e: inside(e, whole) & (e["prose"] > 0)), first_most)
    mostly = let(body, lambda whole: let(largest(whole), lambda e: F.when(e["prose"] >= MOST_PROSE * whole["prose"], e)))
    return F.coalesce(named("article"), named("main"), mostly, body, F.get(es, F.lit(0)))


def outermost(found: Column) -> Column:
    """Elements that no other of the list contains."""
    return let(found, lambda list_: F.filter(list_, lambda e: ~F.exists(list_, lambda o: inside(e, o))))


def harvest(tree, scopes: Column, url) -> Column:
    """The content elements inside any of some scopes, in order, each once: those with text or an image, images that are no furniture, supported videos."""
    es = col(tree)["elements"]

    def good(e: Column, media: Column) -> Column:
        image = (e["src"] != "") & ~absolute(url, e["src"]).rlike(FURNITURE)
        video = lambda c: absolute(url, c).rlike(VIDEO)
        plain = (e["chars"] > 0) | F.exists(media, lambda m: inside(m, e))
        return F.when(e["tag"] == "img", image).when(e["tag"] == "iframe", (e["src"] != "") & video(e["src"])).when(e["tag"] == "a", (e["href"] != "") & video(e["href"])).when(e["tag"] == "figcaption", e["chars"] > 0).otherwise(plain)

    of = lambda scopes: F.filter(tagged(es, *HARVEST), lambda e: F.exists(scopes, lambda s: inside(e, s)))
    return outermost(let(tagged(es, "img", "figure"), lambda media: F.filter(let(scopes, of), lambda e: good(e, media))))


def block_html(page, url) -> Callable[[Column], Column]:
    """How a harvested element is written: images in figures, captions as paragraphs, videos as links."""

    def write(e: Column) -> Column:
        link = lambda c, said: F.concat(F.lit('<figure><a href="'), absolute(url, c), F.lit('">'), said, F.lit("</a></figure>"))
        own = source_of(page, e)
        said = F.nullif(F.trim(F.regexp_replace(own, "<[^>]*>", " ")), F.lit(""))
        caption = F.concat(F.lit("<p>"), F.regexp_replace(own, r"(?i)^<figcaption\b[^>]*>|</figcaption\s*>$", ""), F.lit("</p>"))
        return F.when(e["tag"] == "img", F.concat(F.lit("<figure>"), own, F.lit("</figure>"))).when(e["tag"] == "iframe", link(e["src"], F.lit("Watch video"))).when(e["tag"] == "a", link(e["href"], F.coalesce(said, F.lit("Watch video")))).when(e["tag"] == "figcaption", caption).otherwise(own)

    return write


# Words in a class or id that speak for and against an article, and what an element's name is worth.
FOR = r"(?i)article|body|content|entry|hentry|main|page|post|text|blog|story"
AGAINST = r"(?i)-ad-|hidden|banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget"
WORTH = {5: ("div",), 3: ("pre", "td", "blockquote"), -3: ("address", "ol", "ul", "dl", "dd", "dt", "li", "form"), -5: ("h1", "h2", "h3", "h4", "h5", "h6", "th")}
#: Paragraphs of so many characters count; their score goes to five ancestors, divided by these.
LEAST_CHARS, DIVIDERS = 25, (1, 2, 6, 9, 12)


def links_share(e: Column, links: Column) -> Column:
    """The share of an element's characters (without white space) that is inside links."""
    return F.when(e["solid"] == 0, F.lit(0.0)).otherwise(total(F.transform(F.filter(links, lambda a: inside(a, e)), lambda a: a["solid"])) / e["solid"])


def contributions(tree) -> Column:
    """(at, score) for the ancestors of each paragraph: two, one a comma, one for each hundred characters up to three; in full to the parent and less the further up."""
    t, es = col(tree), col(tree)["elements"]
    own = F.filter(es, lambda e: e["tag"].isin("p", "td", "pre") & (e["chars"] >= LEAST_CHARS))
    up = lambda at: F.get(es, at)["parent"]

    def to_ancestors(p: Column) -> Column:
        score = F.lit(2.0) + F.regexp_count(text_of(t, p), F.lit(",")) + F.least(F.floor(p["chars"] / 100), F.lit(3))
        line = [p["parent"]]
        for _ in DIVIDERS[1:]:
            line.append(up(line[-1]))  # the root's parent is -1, of which get gives null
        return let(score, lambda s: F.array(*[F.struct(at.alias("at"), (s / d).alias("score")) for at, d in zip(line, DIVIDERS)]))

    return F.filter(F.flatten(F.transform(own, to_ancestors)), lambda c: c["at"] > 0)


def candidates(tree, given) -> Column:
    """(score, at, element) of every element that paragraphs gave a score: with its name's and its marks' worth, less its share of links."""
    es, given = col(tree)["elements"], col(given)

    def scored(at: Column, links: Column) -> Column:
        e = F.get(es, at)
        worth = reduce(lambda w, kv: w.when(e["tag"].isin(*kv[1]), kv[0]), list(WORTH.items())[1:], F.when(e["tag"].isin(*WORTH[5]), 5)).otherwise(0)
        marks = F.when(e["mark"].rlike(FOR), 25).otherwise(0) - F.when(e["mark"].rlike(AGAINST), 25).otherwise(0)
        sum_ = F.aggregate(F.filter(given, lambda c: c["at"] == at), F.lit(0.0), lambda a, c: a + c["score"])
        return F.struct(((sum_ + worth + marks) * (1 - links_share(e, links))).alias("score"), (-at).alias("at"), e.alias("element"))

    return let(tagged(es, "a"), lambda links: F.transform(F.array_distinct(F.transform(given, lambda c: c["at"])), lambda at: scored(at, links)))


def readable_scopes(tree, scored) -> Column:
    """The best candidate and those of its siblings that belong to the article: a fifth of its score (10 at least), or a long paragraph with few links. Empty without a candidate; ties go to the earlier element."""
    es, scored = col(tree)["elements"], col(scored)
    best = F.array_max(F.transform(scored, lambda c: F.struct(c["score"].alias("score"), c["at"].alias("at"))))

    def around(best: Column, links: Column) -> Column:
        """The elements beside the best one that belong to the article. A paragraph is harvested itself: its scope begins one element earlier."""
        top = F.get(es, -best["at"])
        good = F.filter(scored, lambda c: (c["element"]["parent"] == top["parent"]) & (c["score"] >= F.greatest(F.lit(10.0), best["score"] * 0.2)))
        prose = lambda e: (e["tag"] == "p") & (e["chars"] > 80) & (links_share(e, links) < 0.25)
        beside = F.filter(es, lambda e: (e["parent"] == top["parent"]))
        siblings = let(good, lambda g: F.filter(beside, lambda e: (e["at"] == top["at"]) | F.exists(g, lambda c: c["element"]["at"] == e["at"]) | prose(e)))
        return F.transform(siblings, lambda e: F.when(e["tag"] == "p", e.withField("at", e["at"] - 1)).otherwise(e))

    none = F.filter(es, lambda e: F.lit(False))
    return let(best, lambda b: F.when(b.isNull(), none).otherwise(let(tagged(es, "a"), lambda links: around(b, links))))


# Patterns of marks, labels, calls to subscribe, credits, dates and bylines.
CLUTTER_MARK = r"(?i)\b(ad|ads|adsense|advert|advertisement|sponsor|sponsored|promo|promotion|newsletter|subscribe|signup|sign-?up|social|share|sharing|related|recommend|recommended|comment|comments|disqus|cookie|consent|popup|modal|overlay|paywall|banner|trending|read-?more|more-?from|up-?next|you-?may-?also|author-?bio|byline|newsletter-?cta)\b"
LABEL = (
    r"(?i)^(related(\s+(articles|stories|posts|reading|content))?|more\s+(from|stories|in|on|articles)|more\s+like\s+this|also\s+read|read\s+(more|next)|recommended(\s+(for\s+you|stories|articles|reading))?|what\s+to\s+read\s+next|you\s+(may|might)\s+also\s+(like|enjoy|read)|up\s+next|newsletter|subscribe|sign\s?up"
    r"|share\s+this(\s+article)?|follow\s+us(\s+on)?|comments?|trending|latest\s+(stories|articles|news)|sponsored|advert(isement)?|around\s+the\s+web|from\s+around\s+the\s+web|most\s+(popular|read)|in\s+this\s+series|explore\s+more)\b"
)
CALLS = (
    r"^(subscribe\s+(now|today|to\s+(our|the)\s+(?:[a-z0-9-]+\s+){0,3}newsletter|for\s+(our|the)\s+(?:[a-z0-9-]+\s+){0,3}newsletter)|share\s+this\s+(article|story)|follow\s+us|follow\s+me|read\s+(more|next)|also\s+read|more\s+from|more\s+like\s+this|related\s+(stories|articles|reading)|recommended\s+(for\s+you|stories|articles|reading)|you\s+may\s+also\s+like|what\s+to\s+read\s+next|up\s+next|advertisement|sponsored|support\s+our\s+(work|journalism)|become\s+a\s+subscriber|already\s+a\s+subscriber|create\s+a\s+free\s+account|view\s+comments|leave\s+a\s+comment)\b",
    r"^(subscribe|sign\s?up|get|receive|join)\b(?=[^.!?]{0,180}\bnewsletters?\b)(?=[^.!?]{0,180}\b(in\s+your\s+inbox|inbox|e-?mail|delivered?|delivery|sign\s?up|subscribe|subscription|subscriber)\b)",
    r"^(?:the\s+)?latest\b(?=[^.!?]{0,120}\b(in\s+your\s+inbox|inbox|e-?mail|delivered?|delivery|sign\s?up|subscribe|subscription|subscriber)\b)",
    r"^get\s+(the\s+)?latest(\s+(stories|articles|news|updates?|headlines|alerts?))?\b(?=[^.!?]{0,180}\b(in\s+your\s+inbox|inbox|e-?mail|delivered?\s+(to|straight|directly)|sign\s?up|subscribe|subscription)\b)",
    r"^sign\s?up\b(?=[^.!?]{0,160}\b(newsletters?|subscribers?|subscriptions?|account|membership|trial|offer|deal|promo|promotion|discount|sale|save|updates?|alerts?|inbox)\b)",
    r"^(stay\s+connected|get\s+the\s+latest\s+updates\s*(?:from)?|discover\s+special\s+offers|thank\s+you\s+for\s+submitting|it\s+looks\s+like\s+something\s+went\s+wrong)\b",
    r"^enjoying\s+.{1,80}\?\s+subscribe\s+to\s+our\s+free\s+newsletter\.?$",
    r"\barchive\s+page\b",
    r"^\d+\s+.*\b(most\s+popular|trending|recommended\s+for\s+you|you\s+may\s+also\s+like)\b",
)
VIDEO_LABEL = r"(?i)^(featured\s+video|watch:?|video)$"
BYLINE = r"(?:^(?:[Bb][Yy]|[Ww]ords by|[Ww]ritten by|[Ss]tory by|[Rr]eported by|[Pp]hotographs? by|[Ii]llustrations? by|[Ee]dited by|[Rr]eporting by)\s+[\p{Lu}@])"
AUTHOR_ROLE = r"\b(?:\p{Lu}\p{Ll}+|he|she|they)\s+(?:is|was)\s+(?:a|an|the)\s+(?:senior\s+|staff\s+|freelance\s+|contributing\s+|former\s+|award-winning\s+)*(?:writer|journalist|reporter|editor|contributor|columnist|correspondent|author|blogger|essayist|critic|broadcaster|producer)\b"
SOCIAL = r"(?i)(^|\s)@[a-z0-9_]{2,}\b|\bfollow\s+(me|us|her|him|them|@)|\b(twitter|x|instagram|threads|mastodon|facebook|bluesky|linkedin)\.com/|\bfind\s+(me|her|him|them)\s+on\b"
CREDITS = (
    r"(?is)^\(?\s*image\s+credits?\s*\)?$",
    r"(?is)^\(?\s*image\s+credits?\s*(?::|：|-|–|—)\s*\S.*$",
    r"(?is)^\(?\s*(?:courtesy\s+of|credits?\s*(?::|：|-|–|—)|(?:photo(?:graph)?|image|illustration)\s+(?:by|courtesy\s+of|credits?\s*(?::|：|-|–|—)))\s+\S.*$",
)
CLUTTER_IMAGE = r"(?i)\b(favicon|sprite|pixel|newsletter|promo|promotion|sign-?up|subscribe)\b"
DATE = r"(?i)^(?:(?:published|published on|posted|posted on|updated|last updated)\s*:?\s*)?(?:(?:mon|tue|wed|thu|fri|sat|sun)(?:day)?\s*,\s*)?(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?\s*,?\s+\d{4}(?:[\s,]+(?:at\s+)?\d{1,2}:\d{2}.*)?|\d{4}[-/]\d{1,2}[-/]\d{1,2})$"
MOST_REMOVED, LEAST_LEFT = 0.35, 300
CALL_CHARS, CREDIT_CHARS, LEAD_CHARS, LABEL_CHARS = 500, 240, 300, 40
LAST_SCANNED, FIRST_SCANNED = 8, 2


def name_key(c) -> Column:
    """A name in lower case without anything but letters, digits and single spaces; null stays null."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(col(c), r"(?U)\s+", " ")), "[^a-z0-9 ]+", ""))


def is_call(text: Column) -> Column:
    """Short texts that call to subscribe, share or read on."""
    plain = F.lower(trimmed(F.regexp_replace(text, r"(?U)\s+", " ")))
    return F.length(plain).between(1, CALL_CHARS) & reduce(Column.__or__, [plain.rlike(p) for p in CALLS])


def is_credit(text: Column) -> Column:
    return F.length(text).between(1, CREDIT_CHARS) & reduce(Column.__or__, [text.rlike(p) for p in CREDITS])


def _author_line(text: Column, name: Column) -> Column:
    return F.coalesce((F.length(text) <= 120) & (name != "") & (name_key(F.regexp_replace(text, r"(?i)^by\s+", "")) == name), F.lit(False))


def byline(text: Column, name: Column) -> Column:
    """2 for a line of the known author, 1 for other bylines, else 0."""
    key = name_key(text)
    known = F.coalesce((name != "") & (F.length(text) <= 400) & key.startswith(name) & text.rlike(r"(?i)\b(reports?|writes?|covers?|is|was|contributes?|serves?)\b"), F.lit(False))
    likely = text.rlike(BYLINE) | text.rlike(AUTHOR_ROLE) | text.rlike(r"(?i)\bis the author of\b") | text.rlike(SOCIAL) | text.rlike("(?i)^read more (from|by)\\b") | text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    return F.when(_author_line(text, name) | known, 2).when(likely, 1).otherwise(0)


def leading(text: Column, name: Column) -> Column:
    """Whether a short first block is a line of credits or about the author."""
    about = F.coalesce((name != "") & name_key(text).contains(name) & (text.rlike(AUTHOR_ROLE) | text.rlike(r"(?i)\bis the author of\b") | text.rlike(SOCIAL)), F.lit(False))
    return (F.length(text) <= LEAD_CHARS) & (text.rlike(r"(?i)^credits\b") | text.rlike(BYLINE) | about)


def _scan(leaves: Column, most: int, verdict: Callable[[Column], Column], going: Callable[[Column], Column]) -> Column:
    """The leaves that a verdict above zero falls on, from the first to where it is zero and the scan isn't going on; as (leaf, sure)."""
    start = F.struct(F.lit(True).alias("on"), F.filter(F.transform(leaves, lambda x: F.struct(x.alias("leaf"), F.lit(0).alias("sure"))), lambda x: F.lit(False)).alias("out"))

    def step(state: Column, x: Column) -> Column:
        v = verdict(x)
        out = F.when(state["on"] & (v > 0), F.array_append(state["out"], F.struct(x.alias("leaf"), v.alias("sure")))).otherwise(state["out"])
        return F.struct((state["on"] & ((v > 0) | going(x))).alias("on"), out.alias("out"))

    return F.aggregate(F.slice(leaves, 1, most), start, step)["out"]


def leaf_blocks(tree) -> Column:
    """Blocks without a block inside: the element and its trimmed text."""
    leaves = let(tagged(col(tree)["elements"], *BLOCKS), lambda blocks: F.filter(blocks, lambda e: ~F.exists(blocks, lambda b: inside(b, e))))
    return F.transform(leaves, lambda e: F.struct(e.alias("e"), trimmed(text_of(tree, e)).alias("text")))


def clutter(tree, leaves, author) -> Column:
    """(element, sure 1 or 2) of everything that looks like clutter: marks, labels with the list after them, link lists, images, calls, video labels, credits, first and last bylines."""
    es, leaves = col(tree)["elements"], col(leaves)
    found = lambda list_, sure: F.transform(list_, lambda e: F.struct(e.alias("e"), F.lit(sure).alias("sure")))

    def by_marks(media: Column, links: Column) -> Column:
        bare = lambda e: ~F.exists(media, lambda m: inside(m, e))
        marked = F.filter(tagged(es, *BLOCKS), lambda e: (e["mark"] != "") & e["mark"].rlike(CLUTTER_MARK))
        labels = F.filter(tagged(es, "h1", "h2", "h3", "h4", "h5", "h6", "p", "strong", "b"), lambda e: e["chars"].between(1, LABEL_CHARS) & trimmed(text_of(tree, e)).rlike(LABEL))
        after = lambda e: F.get(F.filter(F.slice(es, e["last"] + 2, 1), lambda x: x["parent"] == e["parent"]), F.lit(0))
        follow = lambda list_: F.filter(F.transform(list_, after), lambda e: e.isNotNull() & e["tag"].isin("ul", "ol", "nav", "div", "section", "aside"))
        dense = F.filter(tagged(es, "ul", "ol", "nav", "section", "div"), lambda e: (F.size(F.filter(links, lambda a: inside(a, e))) >= 2) & (links_share(e, links) > 0.6))
        images = F.filter(tagged(es, "img"), lambda e: F.concat_ws(" ", e["alt"], e["src"], e["mark"]).rlike(CLUTTER_IMAGE))
        alone = lambda e: F.size(F.filter(F.slice(es, e["at"] + 2, e["last"] - e["at"]), lambda x: x["tag"].isin("img", "video", "audio", "iframe"))) == 1
        frames = lambda list_: F.filter(F.transform(list_, lambda i: F.get(es, i["parent"])), lambda e: e["tag"].isin("p", "figure", "div") & (e["chars"] == 0) & alone(e))
        by_text = lambda test: F.transform(F.filter(leaves, test), lambda x: x["e"])
        labelled = by_text(lambda x: (x["e"]["tag"] == "p") & x["text"].rlike(VIDEO_LABEL) & bare(x["e"]) & ~F.exists(links, lambda a: inside(a, x["e"])))
        credits = F.concat(F.filter(tagged(es, "figcaption"), lambda e: is_credit(trimmed(text_of(tree, e)))), by_text(lambda x: is_credit(x["text"]) & bare(x["e"])))
        with_lists = let(labels, lambda list_: F.concat(found(list_, 1), found(follow(list_), 1)))
        with_frames = let(images, lambda list_: F.concat(found(list_, 2), found(frames(list_), 2)))
        return F.concat(found(marked, 2), with_lists, found(dense, 1), with_frames, found(by_text(lambda x: is_call(x["text"])), 2), found(labelled, 2), found(credits, 2))

    def by_names(spoken: Column, name: Column) -> Column:
        padding = lambda x: F.coalesce(x["e"]["mark"].rlike(CLUTTER_MARK), F.lit(False)) | is_call(x["text"])
        first = _scan(spoken, FIRST_SCANNED, lambda x: F.when(_author_line(x["text"], name) | leading(x["text"], name), 2).otherwise(0), padding)
        date = F.filter(F.slice(spoken, 2, 1), lambda x: x["text"].rlike(DATE) & _author_line(F.get(spoken, F.lit(0))["text"], name))
        last = _scan(F.reverse(spoken), LAST_SCANNED, lambda x: byline(x["text"], name), lambda x: padding(x) | (F.length(x["text"]) <= 60))
        scanned = lambda list_: F.transform(list_, lambda s: F.struct(s["leaf"]["e"].alias("e"), s["sure"].alias("sure")))
        return F.concat(scanned(first), found(F.transform(date, lambda x: x["e"]), 2), scanned(last))

    marks = let(tagged(es, *MEDIA), lambda media: let(tagged(es, "a"), lambda links: by_marks(media, links)))
    names = let(F.filter(leaves, lambda x: x["text"] != ""), lambda spoken: let(name_key(author), lambda name: by_names(spoken, name)))
    return F.concat(marks, names)


def removals(tree, found) -> Column:
    """What of the clutter goes, as elements: all of it if that is 35 % of the text at most, else the sure ones if they are or if 300 characters stay, else none. What contains another covers it."""
    found, whole = col(found), F.get(col(tree)["elements"], F.lit(0))["chars"]
    chosen = lambda list_: F.array_distinct(outermost(F.transform(list_, lambda x: x["e"])))
    size = lambda list_: total(F.transform(list_, lambda e: e["chars"]))

    def pick(every: Column, sure: Column) -> Column:
        none = F.filter(every, lambda e: F.lit(False))
        return F.when(size(every) <= whole * MOST_REMOVED, every).when((size(sure) <= whole * MOST_REMOVED) | (whole - size(sure) >= LEAST_LEFT), sure).otherwise(none)

    return let(chosen(found), lambda every: let(chosen(F.filter(found, lambda x: x["sure"] == 2)), lambda sure: pick(every, sure)))


def emptied(tree, gone) -> Column:
    """The outermost of the removed elements and the blocks that hold nothing without them."""
    es, gone = col(tree)["elements"], col(gone)
    left = lambda e: e["solid"] - total(F.transform(F.filter(gone, lambda g: inside(g, e)), lambda g: g["solid"]))
    media = F.filter(tagged(es, *MEDIA), lambda m: ~F.exists(gone, lambda g: (g["at"] == m["at"]) | inside(m, g)))
    blank = let(media, lambda kept: F.filter(tagged(es, *BLOCKS), lambda e: (left(e) == 0) & ~F.exists(kept, lambda m: inside(m, e))))
    return F.array_distinct(outermost(F.concat(gone, blank)))


def without(page, gone) -> Column:
    """A page's markup without some elements, none of which contains another."""
    cuts = F.array_sort(F.transform(col(gone), lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"))))
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["to"]))
    ends = F.concat(F.transform(cuts, lambda c: c["from"]), F.array(F.length(col(page))))
    return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(col(page), a + 1, b - a)), "")
