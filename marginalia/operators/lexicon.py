"""Word frequency bands by a table of ranks, and the difficulty of texts that follows from them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexical, text
from marginalia.functions.math import clamp, rnd
from marginalia.sources.tables import shared_folder

# Penalties of the bands, and of a rare word that looks like a name.
PENALTY = {"top1k": 2, "top2k": 12, "top3k": 24, "top5k": 38, "top10k": 58, "academic": 72, "rare": 85}
NAME_PENALTY = 24
# Fixed value: endings of technical words.
TECHNICAL = "(tion|sion|ment|ity|ism|ology|graphy|ative|atory|genic|metric|lysis|cracy)$"
LEVEL_CUTS = (15, 30, 48, 65, 82)


def bands(ranks: DataFrame) -> DataFrame:
    """word and band of a table with word and rank (from 1; null for words of the academic list)."""
    r = F.col("rank")
    band = F.when(r.isNull(), "academic").when(r <= 1000, "top1k").when(r <= 2000, "top2k").when(r <= 3000, "top3k").when(r <= 5000, "top5k").otherwise("top10k")
    return ranks.select("word", band.alias("band"))


def corpus_ranks(docs: DataFrame, most: int = 10_000) -> DataFrame:
    """The commonest words of a corpus with their ranks, for use where no licensed list is at hand; the list's length is the feature."""
    n = docs.select(F.explode(text.matches(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    head = n.orderBy(F.desc("n"), "word").limit(most)
    from pyspark.sql import Window

    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word"))).select("word", "rank")


def word_bands(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, lemma and band of each distinct raw word: that of its first candidate that is known, else rare. known: word, band."""
    tried = words.select("word").distinct().select("word", F.posexplode_outer(lexical.candidates("word")).alias("_at", "_form"))
    found = tried.join(known.select(F.col("word").alias("_form"), "band"), "_form", "left").groupBy("word")
    return found.agg(F.min_by("_form", "_at").alias("lemma"), F.coalesce(F.min_by("band", F.when(F.col("band").isNotNull(), F.col("_at"))), F.lit("rare")).alias("band"))


#: Bytes of text whose words are counted in one task.
DEALT_BYTES = 16 << 20


def vocabulary(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """vocabulary (0 to 100), technical (words) and n_words of each text.

    Each distinct word is looked up once, and its band is written to the shared folder. Texts are dealt by their key, so that a
    text's words are counted, given their bands and summed where the text is, and only texts are shuffled; where the distinct words are too
    many for a broadcast, the counts of words meet them in a shuffle. The score is 0.7 of the mean penalty of the words and
    0.3 of that of the lemmas, each at its highest; 50 without words.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "bands")
    word_bands(docs.select(F.explode(text.words("text")).alias("word")), known).write.parquet(path)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.where(F.col(key).isNotNull()).select(key, "text").repartition(1 + size // DEALT_BYTES, key)
    sentences = dealt.select(key, F.explode(F.transform(text.sentences("text"), text.words)).alias("_w"))
    places = sentences.select(key, F.posexplode("_w").alias("_i", "word"))
    counts = places.groupBy(key, "word", (F.col("_i") > 0).alias("_later")).agg(F.count("*").alias("n"))
    name = F.col("_later") & F.col("word").rlike("^(?:[A-Z]{2,}|[A-Z][a-z]+(?:[A-Z][a-z]+)*)$")
    scored = counts.join(spark.read.parquet(path), "word").where(F.col("lemma").isNotNull()).withColumn("name", name)
    penalty = F.create_map(*[x for k, v in PENALTY.items() for x in (F.lit(k), F.lit(v))])
    scored = scored.withColumn("_p", F.when((F.col("band") == "rare") & F.col("name"), NAME_PENALTY).otherwise(F.element_at(penalty, F.col("band"))))
    hard = ~F.col("name") & ((F.col("band") == "academic") | ((F.col("band") == "rare") & F.col("lemma").rlike(TECHNICAL)))
    lemmas = scored.groupBy(key, "lemma").agg(F.max("_p").alias("_top"), F.sum(F.col("_p") * F.col("n")).alias("_sum"), F.sum("n").alias("n"), F.sum(F.when(hard, F.col("n")).otherwise(0)).alias("technical"))
    made = lemmas.groupBy(key).agg((F.sum("_sum") / F.sum("n")).alias("_tokens"), F.avg("_top").alias("_lemmas"), F.sum("technical").alias("technical"), F.sum("n").alias("n_words"))
    every = docs.select(key).distinct().join(made, key, "left")
    return every.select(key, F.coalesce(rnd(0.7 * F.col("_tokens") + 0.3 * F.col("_lemmas"), 1), F.lit(50.0)).alias("vocabulary"), F.coalesce("technical", F.lit(0)).alias("technical"), F.coalesce("n_words", F.lit(0)).alias("_n"))


def confidence_of(words, sentences, score):
    """high, medium or low by a text's size and how far its score is from a cut between levels."""
    near = F.least(*[F.abs(score - c) for c in LEVEL_CUTS])
    return F.when((words < 120) | (sentences < 4), "low").when((words >= 500) & (sentences >= 12) & (near >= 4), "high").otherwise("medium")


def difficulty(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """score (0 to 100), level, lexile and confidence of each text, with the five measures they follow from."""
    counts = text.readability_counts("text")
    rows = docs.select(key, "text", *[v.alias(k) for k, v in counts.items()], F.size(text.sentences("text")).alias("_sentences"))
    rows = rows.withColumns({"readability": text.readability(), "syntax": text.syntax("text"), "_idioms": text.idiom_density("text"), "length": rnd(text.length_score(), 1)})
    rows = rows.drop("text").join(vocabulary(docs, known, key), key)
    n = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.withColumn("idiom", F.when(F.col("n_words") == 0, 0.0).otherwise(rnd(clamp(F.col("_idioms") * 1800 + F.col("technical") / n * 550, 0, 100), 1)))
    score = rnd(0.45 * F.col("vocabulary") + 0.25 * F.col("readability") + 0.2 * F.col("syntax") + 0.05 * F.col("idiom") + 0.05 * F.col("length"))
    rows = rows.withColumn("score", score)
    lexile = clamp(rnd((200 + 14 * (0.45 * F.col("readability") + 0.4 * F.col("vocabulary") + 0.15 * F.col("syntax"))) / 10) * 10, 200, 1600)
    return rows.select(key, "score", text.cefr("score").alias("level"), lexile.alias("lexile"), confidence_of(F.col("n_words"), F.col("_sentences"), F.col("score")).alias("confidence"), "vocabulary", "readability", "syntax", "idiom", "length", "n_words")


@lru_cache(maxsize=1 << 17)
def _typed_key(x: str) -> str:
    """What counts of a typed word: lower case, letters, digits, underscores, and apostrophes and hyphens inside."""
    return "".join(c for c in x.lower() if c.isalnum() or c in "_'-").strip("'-")


def _deltas(masks: list[int], width: int, more: int, less: int) -> Iterator[tuple[int, int, int, int]]:
    """Of each row of the table of edit distances, by the bits of the columns (Myers): where it is one more and one less than the column before, and than the row above."""
    full = (1 << width) - 1
    for m in masks:
        d = (((m & more) + more) ^ more) | m | less
        up, down = less | (full & ~(d | more)), more & d
        right, left = (up << 1 | 1) & full, down << 1 & full
        more, less = left | (full & ~(d | right)), right & d
        yield more, less, up, down


def word_diff(reference: list[str], typed: list[str]) -> list[tuple[str, str]]:
    """Labels of an alignment of two word lists with fewest edits: (word, correct, wrong, missing or extra). Later words are matched first, extras before substitutions before gaps.

    A row of the table of distances is a few integers of one bit a typed word. The alignment is read from the end; of the rows above, one in some is
    kept, and those between are worked out again as it comes to them.
    """
    a, b = ([w for w in ((x, _typed_key(x)) for x in words) if w[1]] for words in (reference, typed))
    width, step = len(b), isqrt(len(a)) + 1
    places: dict[str, int] = {}
    for j, (_, y) in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    masks = [places.get(x, 0) for _, x in a]
    kept, state = [], ((1 << width) - 1, 0)
    for at in range(0, len(a), step):
        kept.append(state)
        for more, less, _, _ in _deltas(masks[at : at + step], width, *state):
            state = more, less
    out, i, j, at, rows = [], len(a), len(b), len(a), []
    while i or j:
        if not i:
            j -= 1
            out.append((b[j][0], "extra"))
            continue
        if i <= at:
            at = (i - 1) // step * step
            above = kept[at // step]
            rows = [(*above, 0, 0), *_deltas(masks[at:i], width, *above)]
        bit = j - 1
        if j and masks[i - 1] >> bit & 1:
            i, j = i - 1, j - 1
            out.append((a[i][0], "correct"))
            continue
        if not j:
            i -= 1
            out.append((a[i][0], "missing"))
            continue
        # Costs of the neighbours, less that of the diagonal one.
        above, row = rows[i - 1 - at], rows[i - at]
        delete = (above[0] >> bit & 1) - (above[1] >> bit & 1)
        insert = (row[2] >> bit - 1 & 1) - (row[3] >> bit - 1 & 1) if bit else 1
        if insert <= min(delete, 0):
            j -= 1
            out.append((b[j][0], "extra"))
        elif delete >= 0:
            i, j = i - 1, j - 1
            out.append((a[i][0], "wrong"))
        else:
            i -= 1
            out.append((a[i][0], "missing"))
    return out[::-1]


def diff_counts(reference: list[str], typed: list[str]) -> tuple[int, int, int, int]:
    """How many words are correct, wrong, missing and extra. If one list is the other with words left out, every alignment with fewest edits has the same counts, and none is looked for."""
    a, b = ([k for k in map(_typed_key, words) if k] for words in (reference, typed))
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    rest = iter(long)
    if all(w in rest for w in short):
        return len(short), 0, len(a) - len(short), len(b) - len(short)
    labels = Counter(label for _, label in word_diff(reference, typed))
    return labels["correct"], labels["wrong"], labels["missing"], labels["extra"]


def dictation(df: DataFrame, key: str, reference: str, typed: str) -> DataFrame:
    """key, accuracy (whole percent) and counts of correct, wrong, missing and extra words of each dictation. The alignment is worked out in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, ref, given in frame.itertuples(index=False, name=None):
                n = diff_counts((ref or "").split(), (given or "").split())
                total = sum(n[:3])
                rows.append((k, 100 if not total else int(n[0] / total * 100 + 0.5), *n))
            yield pd.DataFrame(rows, columns=[key, "accuracy", "correct", "wrong", "missing", "extra"])

    return df.select(key, reference, typed).mapInPandas(run, f"{key} {kind}, accuracy int, correct int, wrong int, missing int, extra int")
