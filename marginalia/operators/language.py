"""Languages told by ranked trigrams: a text's most frequent trigrams against those of each language, by how far out of place they are."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from marginalia.functions.math import col
from marginalia.functions.text import word_count

#: Trigrams in a profile, which is also how far out of place a trigram counts that a language's profile doesn't have.
PROFILE = 300
#: Shorter texts are left undetermined.
LEAST_CHARS, LEAST_WORDS = 200, 30
UNKNOWN = "und"
ANSWER = StructType([StructField("language", StringType()), StructField("distance", LongType())])


def letters(c) -> Column:
    """A text for trigrams: in lower case, one space for all that is no letter, and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[\\x00-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def counted(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, gram and n. A row's trigrams are counted in its task before they are shuffled."""
    plain = rows.select(key, letters(text).alias("_plain"))
    # Three walks, each over every third place: a substring by its place would be looked for from the text's start each time.
    walks = [F.regexp_extract_all(F.substring("_plain", k, 2_147_483_647), F.lit("(?s)..."), F.lit(0)) for k in (1, 2, 3)]
    grams = plain.select(key, F.explode(F.concat(*walks)).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, key: str, most: int = PROFILE) -> DataFrame:
    """key, gram and place: each key's most frequent trigrams from 0, ties in order of the trigram."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("place", place).where(F.col("place") < most).select(key, "gram", "place")


def profiles(labelled: DataFrame, label: str = "lang", text: str = "text", most: int = PROFILE) -> DataFrame:
    """The profile of every language: label, gram, place; at most `most` rows a language."""
    return ranked(counted(labelled.where(F.col(label).isNotNull()), label, text), label, most)


def top_trigrams(plain: str, most: int = PROFILE) -> list[str]:
    """The most frequent trigrams of prepared letters, ties in order of the trigram."""
    counts = Counter(map("".join, zip(plain, plain[1:], plain[2:])))
    return sorted(counts, key=lambda g: (-counts[g], g.encode()))[:most]


def _nearest(known: dict[str, dict[str, int]], most: int) -> Callable[[Column], Column]:
    names = sorted(known)

    @F.arrow_udf(ANSWER)
    def told(texts: pa.Array) -> pa.Array:
        out = []
        for plain in texts.to_pylist():
            best = (None, UNKNOWN)
            if plain is not None and names:
                own = top_trigrams(plain, most)
                best = min((sum(abs(known[n][g] - i) if g in known[n] else most for i, g in enumerate(own)), n) for n in names)
            out.append({"language": best[1], "distance": best[0]})
        return pa.array(out, pa.struct([("language", pa.string()), ("distance", pa.int64())]))

    return told


def identify(docs: DataFrame, known: DataFrame, text: str = "text", label: str = "lang", most: int = PROFILE) -> DataFrame:
    """Adds language and distance to every row of docs, in one pass without a shuffle.

    The nearest profile by the sum of how far each of a text's own top trigrams is out of place; ties go to the first
    name. Texts of fewer than 200 characters or 30 words, null ones included, are undetermined, with a null distance, as is every text without
    profiles. The profiles (`most` rows a language) go to every task.
    """
    places: dict[str, dict[str, int]] = {}
    for row in known.select(label, "gram", "place").collect():
        places.setdefault(row[0], {})[row[1]] = row[2]
    plain = F.coalesce(F.col(text), F.lit(""))
    fit = (F.length(plain) >= LEAST_CHARS) & (word_count(plain) >= LEAST_WORDS)
    return docs.withColumn("_told", _nearest(places, most)(F.when(fit, letters(text)))).withColumns({"language": F.col("_told.language"), "distance": F.col("_told.distance")}).drop("_told")
