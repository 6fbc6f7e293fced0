"""Page trees, content scopes, clutter and the sanitiser."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from marginalia.functions import blocks, markup
from marginalia.functions.html import ALLOWED
from marginalia.operators import extract
from marginalia.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def harvested(spark, *pages, url="https://s.org/a/b"):
    """The texts (or the sources of images) of the blocks that each page gives."""
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").withColumn("t", markup.tree("html"))
    rows = rows.withColumn("e", blocks.harvest("t", F.array(blocks.scope("t")), F.lit(url)))
    rows = rows.select("i", F.transform("e", lambda e: F.when(e["tag"] == "img", e["src"]).otherwise(blocks.trimmed(blocks.text_of("t", e)))).alias("b"))
    return [r["b"] for r in rows.orderBy("i").collect()]


HARVESTS = [
    ("<article><p>one</p></article><p>out</p><article>2</article>", ["one"]),
    ("<article><div><article><p>in</p></article></div><p>after</p></article><p>no</p>", ["in", "after"]),
    ("<article> </article><main><p>m</p></main><p>no</p>", ["m"]),
    ("<body><div><p>rail</p></div><div class=story><section><p>" + "long text " * 20 + "</p></section></div></body>", ["long text " * 19 + "long text"]),
    ("<body><div><p>left one</p></div><div><p>right one</p></div></body>", ["left one", "right one"]),
    ("<article><p>open<p>second<ul><li>a<li>b</ul>", ["open", "second", "ab"]),
    ("<article><p><b>bold <i>never closed<p>next</b></p></article>", ["bold never closed", "next"]),
    ("<article><p></p><h1>title</h1><h2>head</h2><blockquote><p>said</p></blockquote></article>", ["head", "said"]),
    ("<article><figure><img src='/photo.jpg'><figcaption>cap</figcaption></figure><img src='/logo.png'><img src='/p.jpg'></article>", ["cap", "/p.jpg"]),
    ("<article><img src='data:x' data-src='/real.jpg'><p>t</p></article>", ["/real.jpg", "t"]),
    ("<article><p>t</p><iframe src='https://www.youtube.com/embed/x'></iframe><iframe src='https://evil.com/youtube.com'></iframe></article>", ["t", ""]),
    ("<p>fragment", ["fragment"]),
    ("<script>var p='<p>no</p>'</script><style>p{}</style><p>yes</p>", ["yes"]),
    ("", []),
    (None, []),
]


def test_harvest(spark):
    assert harvested(spark, *[p for p, _ in HARVESTS]) == [w for _, w in HARVESTS]


class Plain(HTMLParser):
    """The standard library's own reading of clean HTML: it must be balanced, and hold only what is allowed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        assert tag in ALLOWED and (tag in markup.VOID or not self.open.append(tag))
        for k, v in attrs:
            assert k in (*markup.KEPT.get(tag, ()), *(("rel", "target") if tag == "a" else ()))
            if k in ("href", "src"):
                assert not re.match(r"(?i)[a-z][a-z0-9+.-]*:", re.sub(r"[\x00-\x20]", "", v)) or re.match(r"(?i)(https?|mailto):", re.sub(r"[\x00-\x20]", "", v)), v

    def handle_startendtag(self, tag, attrs):
        assert tag in markup.VOID
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        self.text.append(data)


def assert_clean(dirty):
    clean = markup.clean(dirty)
    assert markup.clean(clean) == clean, dirty
    reader = Plain()
    reader.feed(clean)
    reader.close()
    assert not reader.open
    return clean


@pytest.mark.parametrize(
    "dirty,wanted",
    [
        ("<p>a</p><<svg>script>alert(1)</<svg>script>", "<p>a</p>&lt;script&gt;alert(1)script&gt;"),
        ("<img src=x onerror=alert(1) ", ""),
        ('<div class="ad-box"><div>x</div>keep out</div>kept', "kept"),
        ("<p>Keep</p><script>alert(1)</script><style>.x{}</style>", "<p>Keep</p>"),
        ('<div class="advertisement">BUY</div><p>Real</p>', "<p>Real</p>"),
        ("<div><span>Hello</span> world</div>", "Hello world"),
        ('<a href="https://x.com">l</a>', '<a href="https://x.com" rel="noopener noreferrer nofollow" target="_blank">l</a>'),
        ('<a href="javascript:alert(1)">x</a>', '<a rel="noopener noreferrer nofollow" target="_blank">x</a>'),
        ('<a href=" java&#10;script:alert(1)">x</a>', '<a rel="noopener noreferrer nofollow" target="_blank">x</a>'),
        ("<marquee>Spin</marquee><p>ok</p>", "Spin<p>ok</p>"),
        ('<p style="x" onclick="y">t</p><td colspan="2" width=3>c</td>', '<p>t</p><td colspan="2">c</td>'),
        ("<img src='x\" onerror=\"alert(1)'>", '<img src="x&quot; onerror=&quot;alert(1)" />'),
        ("<ul><li>1<li>2</ul>", "<ul><li>1</li><li>2</li></ul>"),
        ("a < b && c > d", "a &lt; b &amp;&amp; c &gt; d"),
        ("<noscript><p title='</noscript><img src=x onerror=alert(1)>'></noscript>", '<img src="x" />\'&gt;'),
    ],
)
def test_sanitise(dirty, wanted):
    assert assert_clean(dirty) == wanted


def test_sanitise_of_anything():
    """Random mixtures of markup: always balanced, allowed, and a fixed point."""
    r = random.Random(7)
    bits = ["<", ">", "</", "<!--", "-->", "<script>", "</script>", "<p>", "</p>", "<b>", "</b>", "<div class='ad'>", "</div>", "<table><tr><td>", "</table>", "<a href='", "javascript:x", "https://a.b/", "'>", '"', "'", " onerror=x ", "<img src=", "&lt;", "&#60;", "&", "text ", "<svg/onload=x>", "<iframe src='x'>", "</iframe>", "<textarea>", "</textarea>", "<li>", "<ul>", "</ul>", "\x00", "<?php", "<![CDATA[", "é", "<style>", "<P ID=x>", "</SCRIPT >"]
    for _ in range(3000):
        assert_clean("".join(r.choice(bits) for _ in range(r.randrange(1, 14))))


def test_null_and_base(spark):
    df = spark.createDataFrame([(None,), ("",), ('<img src="/a.jpg"><img src="/logo.png"><img data-src="b.jpg" src="data:x">',)], "x string")
    assert [r[0] for r in df.select(markup.sanitise("x", F.lit("https://s.org/d/"))).collect()] == [None, "", '<img src="https://s.org/a.jpg" /><img src="https://s.org/d/b.jpg" />']


def plain_tree(page):
    """Texts, lengths and paragraph lengths of elements, by walking the events without offsets."""
    parts, stack, rows = [], [["#page", [], -1]], [["#page", [], -1]]
    rows = [stack[0]]
    for name, what, _, _ in markup._events(page):
        if name in ("", "#"):
            if name == "" or stack[-1][0] not in markup.SILENT:
                text = what if name else markup.unescape(what)
                parts.append(text)
                for e in stack:
                    e[1].append(text)
        elif name[0] == "/":
            assert stack.pop()[0] == name[1:]
        else:
            rows.append([name, [], rows.index(stack[-1]) if stack[-1] in rows else 0])
            if name not in markup.VOID:
                stack.append(rows[-1])
    return [(n, "".join(t)) for n, t, _ in rows]


def test_tree_ranges(spark):
    """Every element's range of the text, its lengths and its paragraphs' length against texts gathered one by one."""
    r = random.Random(3)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", " ", "\n", "word ", "two words", "<img src=a>", "<ul><li>", "<script>x</script>", "&amp;", "é　"]
    for _ in range(300):
        page = "".join(r.choice(bits) for _ in range(r.randrange(1, 40)))
        text, elements = markup.parse(page)
        plain = plain_tree(page)
        assert len(plain) == len(elements)
        for (name, own), e in zip(plain, elements):
            assert (e[3], text[e[10] : e[11]], e[12], e[13]) == (name, own, len(own.strip()), len(re.sub(r"\s", "", own)))
            assert e[14] == sum(o[12] for o in elements[e[0] + 1 : e[1] + 1] if o[3] == "p") and all(o[2] >= e[0] for o in elements[e[0] + 1 : e[1] + 1])


BODY = ["<p>Deep work needs quiet hours and a plan that is kept through the week, said the people who were asked about their habits.</p>", "<p>Others found that short walks between long sittings helped them more than any plan, which surprised nobody in the group.</p>", "<p>In the end the study shows that what is kept up for months matters more than what is done on a single good morning.</p>"]


def left(spark, *cases):
    """What is left besides the body of each (page, author)."""
    rows = extract.decluttered(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, content string, author string"), author=F.col("author")).orderBy("i").collect()
    assert all(b in r["content"] for r in rows for b in BODY)
    return [r["content"].replace("".join(BODY), "").strip() for r in rows]


def test_declutter(spark):
    cases = [
        ("", "<p>By Jane Doe. Jane is a senior writer at Example. Follow @jane.</p>", None, ""),
        ("", "<p>Jane Doe reports on science from Berlin.</p>", "Jane Doe", ""),
        ("", "<p>Jane Doe reports on science from Berlin.</p>", None, "<p>Jane Doe reports on science from Berlin.</p>"),
        ("", '<h3>Related</h3><ul><li><a href="/a">One story</a></li><li><a href="/b">Two story</a></li></ul>', None, ""),
        ("", '<div class="newsletter"><div><p>Join us</p></div></div>', None, ""),
        ("", "<p>Subscribe to our weekly newsletter for more of this.</p><p>By Jane Doe</p>", None, ""),
        ("<p>Credits: someone</p>", "<p>Image credit: A. Person</p>", None, ""),
        ("<p>Jane Doe</p><p>January 5, 2024</p>", "", "Jane Doe", ""),
        ("", '<figure><img src="/newsletter-promo.png"></figure>', None, ""),
        ("", '<nav><a href="/a">first link text</a> <a href="/b">second link</a></nav>', None, ""),
    ]
    assert left(spark, *[(x + "".join(BODY) + y, author) for x, y, author, _ in cases]) == [w for *_, w in cases]


def test_declutter_budget(spark):
    """More than 35 % of the text goes only if it is sure and 300 characters stay; a removed parent counts its children once."""
    ad = '<div class="ad"><p class="promo">' + "buy now " * 60 + "</p></div>"
    assert left(spark, ("".join(BODY) + ad, None)) == [""]
    short = "<p>Short text.</p>"
    row = extract.decluttered(spark.createDataFrame([(short + ad,)], "content string")).first()
    assert row["content"] == short + ad and row["removed"] == 0 and row["candidates"] == 2 and row["kept_share"] == 1.0
    unsure = '<ul>' + "".join(f'<li><a href="/{i}">a longer link text {i}</a></li>' for i in range(30)) + "</ul>"
    assert unsure in left(spark, ("".join(BODY) + unsure, None))[0]


def test_origins(spark):
    words = lambda n, w: " ".join(f"{w}{i}," for i in range(n))
    page = lambda body: f"<html><head><title>T</title></head><body>{body}</body></html>"
    story = f'<div class="story"><p>{words(60, "a")}</p><p>{words(60, "b")}</p></div>'
    rows = [
        (0, page(f"<nav><p>{words(20, 'n')}</p></nav>{story}<aside><p>rail</p></aside>"), None),
        (1, page(f"<main><p>{words(20, 's')}</p></main>"), None),  # too short for an article
        (2, page(f"<main>{story}" + "".join(f"<div><div><div><p>{words(40, 'd')}</p></div></div></div>" for _ in range(9)) + "</main>"), None),
        (3, page(story), "Told as text.\n\nTwice."),
        (4, page(f'<div class="story"><p>{words(60, "a")}</p><img src="/photo.jpg"></div>'), words(80, "j")),
        (5, page(f'<div class="story"><p>{words(60, "a")}</p><img src="/photo.jpg"></div>'), words(200, "j")),
    ]
    df = extract.content(spark.createDataFrame([(i, "https://s.org/x", h, o) for i, h, o in rows], "i int, url string, html string, own string"), own=F.col("own"), title=F.lit("T"))
    got = {r["i"]: r for r in df.collect()}
    assert [got[i]["origin"] for i in range(6)] == ["readable", "harvest", "harvest", "json", "readable", "json"]
    assert "n1," not in got[0]["content"] and "rail" not in got[0]["content"] and got[0]["readable_words"] == 120
    assert got[3]["content"] == "<p>Told as text.</p>\n<p>Twice.</p>" and "photo.jpg" in got[4]["content"]


def test_page_queries(spark):
    """Each page gives a row; what is clean stays clean; nothing that was removed is still there."""
    n = spark.read.parquet(f"{SF}/pages.parquet").count()
    for name in ("content_origins", "decluttered_pages", "sanitised_pages"):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == n and len({r["page_id"] for r in rows}) == n
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["sanitised_pages"](spark, SF).collect():
        clean = markup.clean(pages[r["page_id"]]["html"], pages[r["page_id"]]["url"])
        assert len(clean) == r["chars"] and assert_clean(clean) == clean
    assert all(0.65 <= r["kept_share"] <= 1 for r in QUERIES["decluttered_pages"](spark, SF).collect())


def test_routing(spark):
    from marginalia.operators import routing

    rules = spark.createDataFrame([(1, "s.org", None, "any"), (2, "s.org", "/news/", "news"), (3, "a.s.org", "/x", "sub"), (4, "t.org", "^$", "never")], "rule int, suffix string, pattern string, category string")
    rows = [(1, "https://s.org/"), (2, "https://www.s.org/news/1"), (3, "https://a.s.org/x"), (4, "https://a.s.org/y"), (5, "https://t.org/"), (6, "https://notss.org/"), (7, None), (8, "https://B.A.S.ORG/x")]
    found = routing.routed(spark.createDataFrame(rows, "page_id int, url string"), rules)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "any"), (2, 1, "any"), (3, 3, "sub"), (4, 1, "any"), (5, None, None), (6, None, None), (7, None, None), (8, 3, "sub")]
    assert routing.routed(spark.createDataFrame(rows, "page_id int, url string"), rules.limit(0)).where("rule is not null").count() == 0
