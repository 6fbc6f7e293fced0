"""An English stemmer as rules: the same steps as column expressions and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.math import col

# Words that a search passes over, and words with a stem of their own.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}

# Beginnings after which the first region starts (written as one capital while a word is worked on), and words that keep their ending.
PREFIXES = {"gener": "G", "commun": "M", "arsen": "A"}
STAYING = "inning|outing|canning|herring|earring|proceed|exceed|succeed"

_V, _C = "[aeiouy]", "[^aeiouyGMA]"
_FIRST, _SECOND = f"(?:[GMA]|{_C}*{_V}+{_C})", f"(?:[GMA]|{_C}*{_V}+{_C}){_C}*{_V}+{_C}"
ANY, R1, R2, VOWEL = ".*", f"{_FIRST}.*", f"{_SECOND}.*", ".*[aeiouyGMA].*"


def _behind(region: str, letters: str) -> str:
    """What stands before an ending that is in a region, if it ends in one of some letters (which may stand right before the region)."""
    return f"(?:{region}.*{letters}|{region[: -len(_C)]}{letters})"


_SHORT = f"(?:.*{_C}{_V}[^aeiouywxY]|{_V}{_C})"

#: Steps of (ending, what stands before it, its replacement). Of a step's endings the first that a word has decides, and is replaced if what stands before it matches.
STEPS: tuple[tuple[tuple[str, str, str], ...], ...] = (
    (("sses", ANY, "ss"), ("(?:ied|ies)", "..+", "i"), ("(?:ied|ies)", ANY, "ie"), ("(?:us|ss)", "", ""), ("s", f".*{_V}.+", "")),
    (("(?:eedly|eed)", R1, "ee"), ("(?:eedly|eed)", "", ""), ("(?:ingly|edly|ing|ed)", VOWEL, "#")),
    (("(?:at|bl|iz)#", ANY, "$&e"), ("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)#", ANY, "$1"), ("#", f"(?:{_C}*{_V}{_C}|{_V}{_C})", "?e"), ("#", ANY, "")),
    (("[yY]", f".+{_C}", "i"),),
    tuple((e, R1, r) for e, r in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")))
    + (("ogi", _behind(f"{_C}*{_V}+{_C}", "l"), "og"), ("li", _behind(f"{_C}*{_V}+{_C}", "[cdeghkmnrt]"), "")),
    (*((e, R1, r) for e, r in (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))), ("ative", R2, "")),
    (*((e, R2, "") for e in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize")), ("ion", _behind(_SECOND, "[st]"), ""), *((e, R2, "") for e in ("al", "er", "ic"))),
    (("e", R2, ""), ("l", _behind(_SECOND, "l"), "")),
)


def _rules() -> list[list[tuple[str, str, str]]]:
    """Steps as (pattern of the words it decides, pattern of those it changes, replacement), with $1 for what stands before the ending."""
    out = []
    for step in STEPS:
        rules = []
        for ending, before, new in step:
            if new == "$&e":  # the ending without its mark, and an e
                rules.append((f"^.*{ending}$", f"^(.*{ending[:-1]})#$", "$1e"))
            elif new == "$1":  # a doubled letter becomes one
                rules += [(f"^.*{d}#$", f"^(.*{d[0]}){d[0]}#$", "$1") for d in ending[3:-2].split("|")]
            elif new == "?e":  # a short word gets an e
                rules.append((f"^{before}#$", f"^(.*[^aeiouywxY])#$", "$1e"))
            else:
                rules.append((f"^.*{ending}$" if before != "..+" else f"^..+{ending}$", f"^({before}){ending}$", f"$1{new}"))
        out.append(rules)
    out[1].insert(0, (f"^(?:{STAYING})$", "^(\\b)\\B$", "$1"))
    # An e also goes after R1 where no short syllable stands before it.
    out[-1].insert(1, (f"^{_SHORT}e$", "^(\\b)\\B$", "$1"))
    out[-1].insert(2, ("^.*e$", f"^({R1})e$", "$1"))
    out[-1][0] = (f"^{R2}e$", f"^({R2})e$", "$1")
    return out


RULES = _rules()


def stem(word) -> Column:
    """The stem of a lower-case word; words of one or two letters stay."""
    w = F.regexp_replace(F.regexp_replace(col(word), "^y", "Y"), "([aeiou])y", "$1Y")
    for prefix, sign in PREFIXES.items():
        w = F.regexp_replace(w, f"^{prefix}", sign)

    def step(rules: list[tuple[str, str, str]]) -> Callable[[Column], Column]:
        def decide(x: Column) -> Column:
            (test, change, new), *rest = rules
            chain = F.when(x.rlike(test), F.regexp_replace(x, change, new))
            for test, change, new in rest:
                chain = chain.when(x.rlike(test), F.regexp_replace(x, change, new))
            return chain.otherwise(x)

        return decide

    for rules in RULES:  # each step sees the word before it as a variable, so that the expression grows by one step only
        w = F.get(F.transform(F.array(w), step(rules)), F.lit(0))
    for prefix, sign in PREFIXES.items():
        w = F.regexp_replace(w, f"^{sign}", prefix)
    own = F.create_map(*[F.lit(x) for kv in EXCEPTIONS.items() for x in kv])
    return F.when(F.length(col(word)) <= 2, col(word)).otherwise(F.coalesce(F.try_element_at(own, col(word)), F.lower(w)))


def stem_sql(words: str) -> str:
    """DuckDB's query of (word, stem) for a table of distinct words with a column word."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sql = f"SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w FROM {words}"
    for prefix, sign in PREFIXES.items():
        sql = f"SELECT word, regexp_replace(w, '^{prefix}', '{sign}') AS w FROM ({sql})"
    for rules in RULES:
        cases = " ".join(f"WHEN regexp_matches(w, {quoted(t)}) THEN regexp_replace(w, {quoted(c)}, {quoted(n.replace('$1', chr(92) + '1'))})" for t, c, n in rules)
        sql = f"SELECT word, CASE {cases} ELSE w END AS w FROM ({sql})"
    for prefix, sign in PREFIXES.items():
        sql = f"SELECT word, regexp_replace(w, '^{sign}', '{prefix}') AS w FROM ({sql})"
    own = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in EXCEPTIONS.items())
    return f"SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE CASE word {own} ELSE lower(w) END END AS stem FROM ({sql})"
