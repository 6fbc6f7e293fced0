"""Moderation, redaction and validation of text and property bags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.math import col

# Patterns of each moderation category, without regard to case.
MODERATION = {
    "self_harm": (
        r"\bhow\s+(?:can|do|to)\s+i?\s*(?:kill|hurt|harm)\s+myself\b",
        r"\bways?\s+to\s+(?:commit\s+suicide|end\s+my\s+life|kill\s+myself)\b",
        r"\b(?:best|easiest|painless)\s+way\s+to\s+(?:die|kill\s+myself|commit\s+suicide)\b",
    ),
    "sexual_minors": (
        r"\b(?:child|minor|underage|preteen|pre-teen)\s+(?:porn|sex|nude|nudes|sexual)\b",
        r"\bsexual(?:ly)?\s+(?:explicit\s+)?(?:content|acts?)\s+(?:with|involving)\s+(?:a\s+)?(?:child|minor|kid)\b",
    ),
    "violence_threat": (
        r"\bhow\s+(?:can|do|to)\s+i?\s*(?:kill|murder|attack|poison)\s+(?:someone|a\s+person|people|him|her|them)\b",
        r"\bhelp\s+me\s+(?:kill|murder|attack|poison)\b",
        r"\bplan(?:ning)?\s+(?:a\s+)?(?:mass\s+shooting|terror(?:ist)?\s+attack)\b",
    ),
    "weapons": (
        r"\bhow\s+(?:can|do|to)\s+i?\s*(?:make|build|construct|assemble)\s+(?:a\s+)?(?:bomb|explosive|ied|nerve\s+agent|bioweapon)\b",
        r"\b(?:instructions?|recipe|steps?)\s+(?:for|to)\s+(?:making|building)\s+(?:a\s+)?(?:bomb|explosive|chemical\s+weapon)\b",
    ),
    "hate": (r"\b(?:kill|exterminate|gas|lynch)\s+(?:all\s+)?(?:the\s+)?(?:jews|muslims|blacks|gays|immigrants)\b",),
}

# Injection markers and what stands for them, in order.
INJECTION = (
    (r"(?i)<\|im_(?:start|end)\|>", "[…]"),
    (r"(?i)(?:<<?/?(?:SYS|INST)>>?|\[/?\s*(?:SYS|INST)\s*\])", "[…]"),
    (r"(?im)^[ \t]*(system|user|assistant)\s*:\s*", ""),
    (r"(?i)\bignore\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions?|prompts?|rules?|constraints?)\b", "[…]"),
    (r"(?i)</?\s*(?:system|instruction|prompt)\s*>", "[…]"),
)
# What counts as an address and as a token when texts are redacted.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
# A word boundary between ASCII characters, in every version of Java: older ones count letters of all languages in \b, but not in \w.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
LONG_TOKEN = _EDGE + r"[A-Za-z0-9_-]{24,}" + _EDGE
# Fixed value: keys whose values may hold private content.
SENSITIVE_KEY = r"(?i)(authorization|body|completion|content|cookie|credential|definition|email|example|explanation|key|pass|phrase|prompt|pwd|response|secret|select|sentence|session|text|token|translation|url)"


def moderation(c) -> Column:
    """The categories that a text trips, in order."""
    return F.array_compact(F.array(*[F.when(col(c).rlike("(?i)" + "|".join(p)), F.lit(k)) for k, p in MODERATION.items()]))


def neutralise(c, most: int = 20_000) -> Column:
    out = F.substring(col(c), 1, most)
    for pattern, stand_in in INJECTION:
        out = F.regexp_replace(out, pattern, stand_in)
    return out


def wrap_untrusted(c, label: str = "article") -> Column:
    return F.concat(F.lit(f"<{label}>\n"), col(c), F.lit(f"\n</{label}>"))


def redact(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), EMAIL, "[email]"), LONG_TOKEN, "[token]")


def clean_properties(c, keys: int = 25, chars: int = 200) -> Column:
    """A flat JSON object as a map: without sensitive keys, the first so many keys, values cut; _v is the schema version."""
    bag = F.map_filter(F.from_json(col(c), "map<string,string>"), lambda k, _: ~k.rlike(SENSITIVE_KEY) & (k != "_v"))
    entries = F.slice(F.map_entries(F.coalesce(bag, F.create_map().cast("map<string,string>"))), 1, keys)
    cut = F.transform(entries, lambda e: F.struct(F.substring(e["key"], 1, 60).alias("key"), F.substring(e["value"], 1, chars).alias("value")))
    return F.map_concat(F.create_map(F.lit("_v"), F.lit("1")), F.map_from_entries(cut))


def mask_map(c) -> Column:
    """Values of sensitive keys masked, others redacted."""
    return F.transform_values(col(c), lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit("[redacted]")).otherwise(redact(v)))


def json_array(c) -> Column:
    """The outermost JSON array of a model's answer, without code fences."""
    return F.nullif(F.regexp_extract(F.regexp_replace(col(c), r"```(?:json)?", ""), r"(?s)\[.*\]", 0), F.lit(""))


def vocabulary_rows(c) -> Column:
    """Valid rows of an answer's array, each word once without regard to case, in order."""
    rows = F.filter(F.from_json(json_array(c), "array<struct<word:string,explanation:string>>"), lambda r: F.length(F.trim(r["word"])) > 0)
    names = F.transform(rows, lambda r: F.lower(F.trim(r["word"])))
    return F.filter(rows, lambda r, i: F.array_position(names, F.lower(F.trim(r["word"]))) == i + 1)


def quiz_rows(c) -> Column:
    """Valid questions: a text, two options at least, and an answer among them."""
    rows = F.from_json(json_array(c), "array<struct<question:string,options:array<string>,answer:int>>")
    return F.filter(rows, lambda r: (F.length(F.trim(r["question"])) > 0) & (F.size(r["options"]) >= 2) & (r["answer"] >= 0) & (r["answer"] < F.size(r["options"])))


def string_array(c) -> Column:
    """A JSON array of strings; anything else is empty."""
    return F.filter(F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def valid_anchor(start, end, quote) -> Column:
    return (col(start) >= 0) & (col(end) > col(start)) & (F.length(col(quote)) > 0)


def known_flags(c, known: list[str], most: int = 20) -> Column:
    return F.slice(F.array_intersect(col(c), F.array(*map(F.lit, known))), 1, most)


def bounded_metadata(c, keys: int = 25, chars: int = 200, depth: int = 3) -> Column:
    """A JSON object as a map with dotted paths, down to a depth: sensitive keys masked at every level, texts redacted and cut, so many keys at most. Lists and what lies deeper stay as JSON text."""
    level = F.map_entries(F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>")))
    entries = F.transform(level, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    for _ in range(depth - 1):

        def open_up(e: Column) -> Column:
            inner = F.map_entries(F.from_json(e["value"], "map<string,string>"))
            deeper = F.transform(inner, lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
            return F.when(e["value"].startswith("{") & ~e["key"].rlike(SENSITIVE_KEY), F.coalesce(deeper, none)).otherwise(F.array(e))

        entries = F.flatten(F.transform(entries, open_up))
    cut = F.transform(F.slice(entries, 1, keys), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"].rlike(SENSITIVE_KEY), "[redacted]").otherwise(F.substring(redact(e["value"]), 1, chars)).alias("value")))
    return F.map_from_entries(cut)


def safe_metadata(c, keys: int = 25, items: int = 20, chars: int = 200, depth: int = 3) -> Column:
    """A JSON object of any shape as JSON that may be stored: a walk over a variant from the outside in, put together from the inside out.

    Each object keeps its first `keys` keys (in the order of their names), each list its first `items` values; values of sensitive
    keys are masked, texts redacted and cut; a value more than `depth` levels below a value of the top object is "[truncated]".
    Numbers, booleans and nulls stay. Anything but a valid object (repeated keys are invalid) gives {}.
    """
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")

    def members(v: Column, level: int) -> Column:
        entry = lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["key"].rlike(SENSITIVE_KEY), F.lit('"[redacted]"')).otherwise(value(e["value"], level)))
        pairs = F.array_sort(F.map_entries(v.cast("map<string,variant>")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.slice(pairs, 1, keys), entry), ","), F.lit("}"))

    def value(v: Column, level: int) -> Column:
        if level > depth:
            return F.lit('"[truncated]"')
        kind = F.schema_of_variant(v)
        listed = F.concat(F.lit("["), F.array_join(F.transform(F.slice(v.cast("array<variant>"), 1, items), lambda x: value(x, level + 1)), ","), F.lit("]"))
        text = quoted(F.substring(redact(v.cast("string")), 1, chars))
        return F.when(F.is_variant_null(v), F.lit("null")).when(kind == "STRING", text).when(kind.startswith("OBJECT"), members(v, level + 1)).when(kind.startswith("ARRAY"), listed).otherwise(F.to_json(v))

    bag = F.try_parse_json(col(c))
    return F.when(F.schema_of_variant(bag).startswith("OBJECT"), members(bag, 0)).otherwise("{}")


def tag_rows(c, most: int = 10) -> Column:
    """Valid tags of an answer's array: names that have a slug, each slug once, in order, the first `most`."""
    from marginalia.functions.text import slug

    names = F.filter(F.coalesce(F.from_json(json_array(c), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (slug(x) != ""))
    slugs = F.transform(names, lambda x: slug(x))
    return F.slice(F.filter(F.transform(names, lambda x: F.struct(F.trim(x).alias("name"), slug(x).alias("slug"))), lambda x, i: F.array_position(slugs, x["slug"]) == i + 1), 1, most)


# Signs of a leaked prompt in an answer.
LEAKS = {
    "prompt-disclosure": r"(?i)\bmy (system )?prompt (is|reads|says|contains)\b",
    "role-override-echo": r"(?i)\byou are now (unrestricted|DAN|a different AI)\b",
    "instruction-echo": r"(?i)\bignore (all |previous |prior )?(instructions|rules|constraints)\b",
    "script-tag": r"(?i)<script[\s>]",
}


def failed_checks(answer, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """The safety checks that an answer fails: empty, HTML, flagged, leaks, expected terms that are missing, forbidden patterns."""
    t = F.trim(F.coalesce(col(answer), F.lit("")))
    low = F.lower(t)
    rules = {"non-empty": t == "", "no-html": t.rlike(r"</?[a-zA-Z][^>]*>"), "not-flagged": F.size(moderation(t)) > 0}
    rules |= {f"no-leakage:{k}": t.rlike(p) for k, p in LEAKS.items()} | {f"no-leakage:{p}": t.rlike(f"(?i){p}") for p in exclude}
    rules |= {f"includes:{w}": ~low.contains(w.lower()) for w in include}
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def quiz_score(answers, keys) -> Column:
    """correct and total of submitted answers (array of index and selected) against the right choices (array): null unless every question is answered exactly once."""
    a, k = col(answers), col(keys)
    exact = (F.size(k) > 0) & (F.size(a) == F.size(k)) & (F.size(F.array_distinct(F.transform(a, lambda x: x["index"]))) == F.size(k)) & F.forall(a, lambda x: (x["index"] >= 0) & (x["index"] < F.size(k)))
    right = F.size(F.filter(a, lambda x: F.get(k, x["index"]) == x["selected"]))
    return F.when(exact, F.struct(right.alias("correct"), F.size(k).alias("total")))
