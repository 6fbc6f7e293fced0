"""Pages read into element trees, and an allow-list sanitiser, both from one tokeniser, in Arrow batches.

A page's tree is an array of elements in document order, so that an element's descendants follow it up to `last`, and the
page's text, of which each element is a range. What is chosen from a tree is left to column expressions (see functions.blocks).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

from marginalia.functions.html import AD_CLASS, ALLOWED
from marginalia.functions.math import col

# Elements without an end, elements whose content is no markup, elements that end an open paragraph, and what a new one of some elements ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
ENDS_P = frozenset("address article aside blockquote center details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select",))}
WALLS = frozenset("td th caption table button body html".split())
SILENT = frozenset("script style noscript template".split())
DROPPED = frozenset("style script textarea noscript iframe template".split())
SCHEMES = {"a": ("http", "https", "mailto"), "img": ("http", "https")}
KEPT = {"a": ("href", "title"), "img": ("src", "alt", "title"), "th": ("colspan", "rowspan"), "td": ("colspan", "rowspan")}
STRUCTURE = frozenset("div section article aside header footer nav main span".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>") for name in RAW}
_AD = re.compile(f"(?i){AD_CLASS}")
_SCHEME = re.compile(r"(?i)([a-z][a-z0-9.+-]*):")
_WORDS = re.compile(r"\S+")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return out


def _tokens(page: str) -> Iterator[tuple[str, str | dict | None, int, int]]:
    """Start tags (name, attributes), end tags ('/name', None), texts ('', text) and raw contents ('#', text) with their places. A tag that the page's end cuts off is dropped."""
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            yield "", page[at:], at, n
            return
        if begin > at:
            yield "", page[at:begin], at, begin
        nxt = page[begin + 1 : begin + 2]
        if nxt in "!?":
            comment = page.startswith("<!--", begin)
            end = page.find("-->" if comment else ">", begin + (4 if comment else 2))
            if not nxt or end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        found = _TAG.match(page, begin) if nxt == "/" or nxt.isalpha() else None
        if not found:
            if nxt == "/" and not page[begin + 2 : begin + 3].isalpha():
                end = page.find(">", begin)
                if end < 0:
                    return
                at = end + 1
                continue
            if nxt.isascii() and (nxt == "/" or nxt.isalpha()):
                return
            yield "", "<", begin, begin + 1
            at = begin + 1
            continue
        at, name = found.end(), found[2].lower()
        if found[1]:
            yield "/" + name, None, begin, at
            continue
        yield name, _attributes(found[3]), begin, at
        if name in RAW:
            end = _END[name].search(page, at)
            stop, after = (end.start(), end.end()) if end else (n, n)
            yield "#", page[at:stop], at, stop
            yield "/" + name, None, stop, after
            at = after


def _events(page: str) -> Iterator[tuple[str, str | dict | None, int, int]]:
    """Tokens in which every start tag but those of void elements has its end, in order: missing ends are put in, stray ones left out."""
    stack: list[str] = []
    count: Counter[str] = Counter()  # of open elements by name, so that a look up the stack is taken only where it can find something

    def pop() -> str:
        count[stack[-1]] -= 1
        return "/" + stack.pop()

    def upto(depth: int, at: int) -> Iterator[tuple[str, None, int, int]]:
        while len(stack) > depth:
            yield pop(), None, at, at

    def nearest(names: tuple | list, walls: frozenset | tuple) -> int:
        if not any(count[n] for n in names):
            return -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                return k
            if stack[k] in walls:
                break
        return -1

    at = 0
    for name, what, begin, at in _tokens(page):
        if name in ("", "#"):
            yield name, what, begin, at
        elif name[0] == "/":
            own = name[1:]
            k = nearest((own,), () if own in ENDS_P or own in WALLS or own in ("tr", "thead", "tbody") else ENDS_P | WALLS)
            if k >= 0:
                yield from upto(k + 1, begin)
                yield pop(), None, begin, at
        else:
            if name in ENDS_P:
                k = nearest(("p",), WALLS)
                if k >= 0:
                    yield from upto(k, begin)
            if name in SIBLINGS:
                same, walls = SIBLINGS[name]
                while (k := nearest(same.split(), walls)) >= 0:
                    yield from upto(k, begin)
            yield name, what, begin, at
            if name not in VOID:
                stack.append(name)
                count[name] += 1
    yield from upto(0, at)


ELEMENT = pa.struct([("at", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("mark", pa.string()), ("src", pa.string()), ("href", pa.string()), ("alt", pa.string()), *((c, pa.int32()) for c in ("from", "to", "start", "stop", "chars", "solid", "prose"))])
TREE = pa.struct([("text", pa.string()), ("elements", pa.list_(ELEMENT))])
# The attributes in which an image's address may wait, and sources that stand in for it.
LAZY = ("data-src", "data-original", "data-lazy-src")
STAND_IN = re.compile(r"(?i)^data:|placeholder|blank|1x1|spacer|loading")
# Fixed value: addresses of images that are a site's furniture.
FURNITURE = r"(?i)^data:|(?:^|[/_.\-])(?:logo|sprite|icon|avatar|placeholder|pixel|1x1|blank|spacer|tracking|button|badge)(?:[/_.\-]|$)|\.svg(?:$|\?)"


def _source(attributes: dict[str, str]) -> str:
    own, lazy = attributes.get("src", "").strip(), next((attributes[k].strip() for k in LAZY if k in attributes), "")
    return lazy if lazy and (not own or STAND_IN.search(own)) else own


def parse(page: str) -> tuple[str, list[list]]:
    """The page's text and its elements: number, last descendant, parent, tag, mark (class, id, role, label), src, href, alt, source range, text range, length of the trimmed text, characters that aren't white space, and the trimmed lengths of all p elements inside, summed."""
    parts: list[str] = []
    elements: list[list] = [[0, 0, -1, "#page", "", "", "", "", 0, len(page), 0, 0, 0, 0, 0]]
    stack, length = [0], 0
    for name, what, begin, end in _events(page):
        if name in ("", "#"):
            if name == "" or elements[stack[-1]][3] not in SILENT:
                text = what if name else unescape(what)
                parts.append(text)
                length += len(text)
        elif name[0] == "/":
            element = elements[stack.pop()]
            element[1], element[9], element[11] = len(elements) - 1, end, length
        else:
            k = len(elements)
            mark = " ".join(filter(None, (what.get(a) for a in ("class", "id", "role", "aria-label", "data-ad"))))
            elements.append([k, k, stack[-1], name, mark, _source(what) if name in ("img", "iframe") else "", what.get("href", ""), what.get("alt", "") if name == "img" else "", begin, end, length, length, 0, 0, 0])
            if name not in VOID:
                stack.append(k)
    elements[0][1], elements[0][11] = len(elements) - 1, length
    text = "".join(parts)
    runs = [m.span() for m in _WORDS.finditer(text)]
    starts, ends, before = [a for a, _ in runs], [b for _, b in runs], [0]
    for a, b in runs:
        before.append(before[-1] + b - a)

    def solid(at: int) -> int:
        """Characters before `at` that aren't white space."""
        k = bisect_left(starts, at)
        return before[k] - (max(0, ends[k - 1] - at) if k else 0)

    prose = [0]
    for e in elements:
        i, j = bisect_left(ends, e[10] + 1), bisect_left(starts, e[11]) - 1
        e[12] = max(0, min(ends[j], e[11]) - max(starts[i], e[10])) if i <= j else 0
        e[13] = solid(e[11]) - solid(e[10])
        prose.append(prose[-1] + (e[12] if e[3] == "p" else 0))
    for e in elements:
        e[14] = prose[e[1] + 1] - prose[e[0] + 1]
    return text, elements


#: Pages of a batch are parsed so many at a time: an element is a few Python objects until it is in Arrow's form, and a batch has up to 10,000 pages.
PAGES = 64


def _trees(pages: pa.Array) -> pa.Array:
    texts, rows, offsets = [], [], [0]
    for page in pages.to_pylist():
        text, elements = parse(page or "")
        texts.append(text)
        rows += elements
        offsets.append(len(rows))
    columns = list(zip(*rows)) if rows else [[] for _ in ELEMENT]
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ELEMENT)], fields=list(ELEMENT))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["text", "elements"])


@F.arrow_udf(from_arrow_type(TREE))
def _tree(pages: pa.Array) -> pa.Array:
    return pa.concat_arrays([_trees(pages.slice(i, PAGES)) for i in range(0, len(pages), PAGES)] or [_trees(pages)])


def tree(page) -> Column:
    """text and elements of a page; null and empty pages have a root without text. Marked as not deterministic, so that filters above don't copy it and all that is made from it."""
    return _tree.asNondeterministic()(col(page))


def _safe(tag: str, address: str) -> bool:
    """Whether a link or an image may have this address: a known scheme, or none. Control characters and white space can't hide one."""
    found = _SCHEME.match(re.sub(r"[\x00-\x20]+", "", re.sub(r"<!--.*?-->", "", address, flags=re.S)))
    return not found or found[1].lower() in SCHEMES[tag]


def _image(what: dict[str, str], base: str) -> dict[str, str] | None:
    """An image's attributes with its absolute address; None for a site's furniture."""
    try:
        address = urljoin(base, _source(what))
    except ValueError:
        address = ""
    return None if not address or re.search(FURNITURE, address) else what | {"src": address}


def clean(page: str, base: str | None = None) -> str:
    """Allow-listed HTML, written from what was parsed and nothing else. With a base, images get absolute addresses and a site's furniture goes.

    Scripts and the like go with their content, as do elements whose class, id or data-ad names an advertisement; other
    unknown elements leave their content. Links, images and table cells keep their known attributes (addresses with a known
    scheme or none), every text is escaped, every element is closed. Clean HTML stays as it is.
    """
    out: list[str] = []
    deep = 0  # of open elements since the one that was dropped
    for name, what, _, _ in _events(page):
        if deep:
            deep += -1 if name[:1] == "/" else 1 if name not in VOID and name not in ("", "#") else 0
        elif name in ("", "#"):
            out.append(escape(unescape(what) if name == "" else what, quote=False))
        elif name[0] == "/":
            if name[1:] in ALLOWED:
                out.append(f"<{name}>")
        elif name in DROPPED or ((name in ALLOWED or name in STRUCTURE) and _AD.search(" ".join(what.get(a, "") for a in ("class", "id", "data-ad")))):
            deep = name not in VOID
        elif name in ALLOWED:
            if name == "img" and base and not (what := _image(what, base)):
                continue
            kept = [(a, what[a]) for a in KEPT.get(name, ()) if a in what and (a not in ("href", "src") or _safe(name, what[a]))]
            kept += [("rel", "noopener noreferrer nofollow"), ("target", "_blank")] * (name == "a")
            out.append(f"<{name}{''.join(f' {a}="{escape(v)}"' for a, v in kept)}{' />' if name in VOID else '>'}")
    return "".join(out)


@F.arrow_udf(StringType())
def _cleaned(pages: pa.Array, bases: pa.Array) -> pa.Array:
    return pa.array([clean(p.as_py(), b.as_py()) if p.is_valid else None for p, b in zip(pages, bases)], pa.string())


def sanitise(page, base=None) -> Column:
    """Allow-listed HTML (see clean); null stays null."""
    return _cleaned.asNondeterministic()(col(page), F.lit(None).cast("string") if base is None else col(base))
