"""Word forms: base-form candidates, light stems, cloze cards, practice sentences, typed tokens, markdown blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.math import col, let

# The suffix rules in order. Each has the ending, the least length of a word, and what may stand for it:
# letters cut, letters added. UNDOUBLE cuts one letter more where the stem ends in a doubled letter, and gives nothing elsewhere.
UNDOUBLE = None
SUFFIXES = (
    ("ies", 5, ((3, "y"),)),
    ("ves", 5, ((3, "f"), (3, "fe"))),
    ("es", 4, ((1, ""), (2, ""))),
    ("s", 3, ((1, ""),)),
    ("ying", 6, ((4, "ie"),)),
    ("ing", 5, ((3, UNDOUBLE), (3, "e"), (3, ""))),
    ("ied", 5, ((3, "y"),)),
    ("ed", 4, ((2, UNDOUBLE), (1, ""), (2, ""))),
    ("er", 5, ((2, UNDOUBLE), (2, ""), (1, ""))),
    ("est", 6, ((3, UNDOUBLE), (3, ""), (2, ""))),
    ("ly", 5, ((2, ""),)),
)
#: Endings after which -es as a whole comes off first.
SIBILANT = r"(ches|shes|sses|xes|zes|oes)$"


def _cut(w: Column, n: int, add: str | None) -> Column:
    stem = F.substring(w, F.lit(1), F.length(w) - n)
    if add is UNDOUBLE:
        doubled = stem.rlike(r"(.)\1$")
        return F.when(doubled, F.substring(stem, F.lit(1), F.length(stem) - 1))
    return F.concat(stem, F.lit(add)) if add else stem


def base_forms(word) -> Column:
    """A clean word and the base forms it may come from, in order, each once."""
    w = col(word)
    out = [w]
    for ending, least, makes in SUFFIXES:
        fits = w.endswith(ending) & (F.length(w) >= least)
        if ending == "s":
            fits = fits & ~w.endswith("ss")
        forms = [_cut(w, n, add) for n, add in makes]
        if ending == "es":
            late = w.rlike(SIBILANT)
            forms = [F.when(late, forms[1]).otherwise(forms[0]), F.when(late, forms[0]).otherwise(forms[1])]
        out += [F.when(fits, f) for f in forms]
    return F.array_distinct(F.filter(F.array_compact(F.array(*out)), lambda x: x != ""))


def clean_word(raw) -> Column:
    """Lower case, straight apostrophes, nothing but letters and apostrophes at the ends."""
    w = F.regexp_replace(F.lower(F.trim(col(raw))), "[‘’`]", "'")
    return F.regexp_replace(w, "^[^a-z']+|[^a-z']+$", "")


def candidates(raw, contractions: dict[str, str] | None = None, irregular: dict[str, list[str]] | None = None) -> Column:
    """Base forms to look up for a raw token, in order: of a contraction its expansion first; then without the possessive, the word, its irregular bases and its suffix forms. Empty without letters."""
    none = F.array().cast("array<string>")
    lookup = lambda table, key: F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)]), key), none)
    short = {k: F.array(F.lit(v), *map(F.lit, (irregular or {}).get(v, []))) for k, v in (contractions or {}).items()}
    odd = {k: F.array(*map(F.lit, v)) for k, v in (irregular or {}).items()}

    def of(w: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(w, "'s?$", ""), "'", "")
        forms = let(plain, lambda p: let(base_forms(p), lambda f: F.concat(F.slice(f, 1, 1), lookup(odd, p) if odd else none, F.slice(f, 2, 99))))
        made = F.concat(lookup(short, w), forms) if short else forms
        return F.when(w == "", none).otherwise(F.array_distinct(F.filter(made, lambda x: x != "")))

    return let(clean_word(raw), of)


def lemma(raw, contractions: dict[str, str] | None = None) -> Column:
    """The first candidate: a real surface form, so cases and possessives merge and inflections don't."""
    return F.coalesce(F.get(candidates(raw, contractions), F.lit(0)), F.lower(F.trim(col(raw))))


# The light stemmer's endings, tried in this order.
STEM_ENDINGS = ("ing", "ed", "es", "er", "est", "ly", "s")


def stem(word) -> Column:
    """Lower case without the first ending that leaves three letters; a doubled last letter becomes one."""
    w = F.lower(col(word))
    out = None
    for e in STEM_ENDINGS:
        cut = F.substring(w, F.lit(1), F.length(w) - len(e))
        one = F.when(cut.rlike(r"(.)\1$"), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)
        fits = w.endswith(e) & (F.length(w) - len(e) >= 3)
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out.otherwise(w)


def bare(token) -> Column:
    """A token without the marks around it."""
    return F.regexp_replace(col(token), r"^[^\w']+|[^\w']+$", "")


def cloze(word, example) -> Column:
    """masked and answer of an example with the first token that is a form of the word blanked out, marks around it kept; reason where there is none."""
    w, text = F.lower(col(word)), F.coalesce(col(example), F.lit(""))

    def fits(t: Column) -> Column:
        return let(F.lower(bare(t)), lambda low: t.rlike(r"\S") & ((low == w) | (stem(low) == stem(w)) | (low.startswith(w) & (F.length(low) - F.length(w) <= 3))))

    def card(parts: Column, at: Column, hit: Column, core: Column) -> Column:
        answer = F.coalesce(F.nullif(core, F.lit("")), col(word))
        blank = F.repeat(F.lit("_"), F.greatest(F.length(core), F.length(w)))
        shown = F.concat(F.regexp_extract(hit, r"^[^\w']*", 0), blank, F.when(core == "", F.lit("")).otherwise(F.regexp_extract(hit, r"[^\w']*$", 0)))
        masked = F.array_join(F.transform(parts, lambda p, i: F.when(i == at - 1, shown).otherwise(p)), "")
        reason = F.when(~text.rlike(r"\S"), "no_example").when(at == 0, "word_not_found")
        return F.struct(F.when(at > 0, masked).alias("masked"), F.when(at > 0, answer).alias("answer"), reason.alias("reason"))

    def of(parts: Column) -> Column:
        place = F.coalesce(F.array_position(F.transform(parts, fits), True), F.lit(0))
        return let(place, lambda at: let(F.get(parts, (at - 1).cast("int")), lambda hit: let(F.coalesce(bare(hit), F.lit("")), lambda core: card(parts, at, hit, core))))

    return let(F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0)), of)


def cloze_right(answer, given) -> Column:
    """Whether an answer is the expected one but for case, space and the marks around it."""
    clean = lambda c: F.lower(bare(F.trim(col(c))))
    return clean(answer) == clean(given)


def practice_sentences(text, least: int = 3, most: int = 300) -> Column:
    """Sentences to practise: cut after marks before a capital or quote, but not after an initial or a number; `least` words to `most` characters; paragraphs apart."""

    def split(p: Column) -> Column:
        pieces = F.split(p, r"(?<=[.!?])\s+(?=[A-Z\"'])")

        def step(s: Column, x: Column) -> Column:
            now = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
            last = F.regexp_replace(F.regexp_extract(now, r"(\S+)$", 1), r"[.!?]+$", "")
            goes_on = ((F.length(last) <= 2) & last.rlike("^[A-Z]")) | now.rlike(r"\d.$")
            return F.struct(F.when(goes_on, s["done"]).otherwise(F.concat(s["done"], F.array(now))).alias("done"), F.when(goes_on, now).otherwise("").alias("open"))

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        return F.aggregate(pieces, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))

    paragraphs = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\n{2,}"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    every = F.flatten(F.transform(F.filter(paragraphs, lambda p: p != ""), split))
    return F.filter(every, lambda s: (F.regexp_count(s, F.lit(r"\S+")) >= least) & (F.length(s) <= most))


# The parts of a spoken token, and the token itself: initials, ordinals, numbers and ranges, and words with their connectors.
DIGITS = r"[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?"
NUMBER = rf"(?:[$])?{DIGITS}(?:[:/∶]{DIGITS})*%?"
TYPED_TOKEN = rf"[A-Za-z](?:[.][A-Za-z])+[.]?|[0-9]+(?:st|nd|rd|th)|{NUMBER}(?:[-‐‑‒–—−]{NUMBER})*|[A-Za-z0-9]+(?:[-'ʼʻ‛′’‐‑][A-Za-z0-9]+)*"


def comparable(c) -> Column:
    """Letters and digits in lower case; a text without any is itself in lower case."""
    t = F.trim(col(c))
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(t), "[^a-z0-9]", ""), F.lit("")), F.lower(t))


def typed_tokens(text) -> Column:
    """Spoken tokens with start, end (exclusive) and a key to compare them by."""
    t = F.coalesce(col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(TYPED_TOKEN), F.lit(0))
    start = F.struct(F.array().cast("array<struct<start:int,end:int,value:string,key:string>>").alias("done"), F.lit(1).alias("at"))

    def step(s: Column, w: Column) -> Column:
        found = F.call_function("locate", w, t, s["at"])
        made = F.struct((found - 1).alias("start"), (found - 1 + F.length(w)).alias("end"), w.alias("value"), comparable(w).alias("key"))
        return F.struct(F.concat(s["done"], F.array(made)).alias("done"), (found + F.length(w)).alias("at"))

    return F.aggregate(words, start, step, lambda s: s["done"])


def blocks(text) -> Column:
    """Blocks of light markdown, apart by blank lines: type (ul, ol or paragraph) and lines, list marks removed."""
    every = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\n{2,}"), lambda b: F.filter(F.split(b, "\n"), lambda x: x.rlike(r"\S")))

    def one(lines: Column) -> Column:
        ul, ol = F.forall(lines, lambda x: x.rlike(r"^[-•]\s+")), F.forall(lines, lambda x: x.rlike(r"^\d+\.\s+"))
        kind = F.when(ul, "ul").when(ol, "ol").otherwise("paragraph")
        return F.struct(kind.alias("type"), F.transform(lines, lambda x: F.when(ul, F.regexp_replace(x, r"^[-•]\s+", "")).when(ol, F.regexp_replace(x, r"^\d+\.\s+", "")).otherwise(x)).alias("lines"))

    return F.transform(F.filter(every, lambda b: F.size(b) > 0), one)


def inline(text) -> Column:
    """Runs of a line: type (bold, code or text) and value."""
    t = F.coalesce(col(text), F.lit(""))
    runs = F.regexp_extract_all(t, F.lit(r"\*\*[^*]+\*\*|`[^`]+`|(?:(?!\*\*[^*]+\*\*|`[^`]+`)[\s\S])+"), F.lit(0))
    bold, code = (lambda x: x.rlike(r"^\*\*[^*]+\*\*$")), (lambda x: x.rlike(r"^`[^`]+`$"))
    return F.transform(runs, lambda x: F.struct(F.when(bold(x), "bold").when(code(x), "code").otherwise("text").alias("type"), F.when(bold(x), F.regexp_replace(x, r"^\*\*|\*\*$", "")).when(code(x), F.regexp_replace(x, "^`|`$", "")).otherwise(x).alias("value")))


def html_paragraphs(html) -> Column:
    """Stretches of HTML that end with a block's closing tag, trimmed, without blank ones."""
    marked = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?i)(</(?:p|h[1-6]|blockquote|li|div|figure|section)>)\s*", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def text_paragraphs(text) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\n{2,}"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def card_front(text, most: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " ")), 1, most)


def namespace(scope, owner, organisation) -> Column:
    """The name space of a tag by its scope."""
    unknown = F.lit("unknown")
    return F.when(col(scope) == "PRIVATE", F.concat(F.lit("user:"), F.coalesce(col(owner).cast("string"), unknown))).when(col(scope) == "ORG", F.concat(F.lit("org:"), F.coalesce(col(organisation).cast("string"), unknown))).otherwise("public")


# Words in capitals, and words that begin with one.
PROPER = r"^(?:[A-Z]{2,}|[A-Z][a-z]+(?:[A-Z][a-z]+)*)$"


def proper_nouns(sentence) -> Column:
    """Words of a sentence that look like names by their capitals, the first word left out, each once in order."""
    words = F.regexp_extract_all(F.coalesce(col(sentence), F.lit("")), F.lit(r"[A-Za-z']+"), F.lit(0))
    return F.array_distinct(F.filter(F.slice(words, 2, 100_000_000), lambda w: w.rlike(PROPER)))
