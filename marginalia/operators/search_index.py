"""A positional inverted index in files, and ranked search that reads only the postings of its words.

An index is two Parquet tables in a folder. `words`: each distinct word of the corpus and its stem. `postings`: word, document and
the word's places in it. Both are cut into bucket folders by a hash of the stem or word, so a search lists and reads the
buckets of its few words. Stop words have no postings but count as places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.math import col
from marginalia.functions.stems import STOP_WORDS, stem
from marginalia.functions.text import matches
from marginalia.operators.ranking import cover_rank

WORD = "[a-z]+"
#: Files of a bucket of postings: a frequent word's documents are dealt over so many.
PARTS = 4
#: Bytes of text whose places are gathered in one task.
DEALT_BYTES = 16 << 20


def bucket(c, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col(c)), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """A written index: its folder and its number of buckets."""

    path: str
    buckets: int

    def words(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/words")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")

    def terms(self, spark: SparkSession, query: str) -> dict[str, list[str]]:
        """The stems of a query's words, stop words left out, in order, each with the corpus's words of that stem. As many rows as such words come to the driver."""
        asked = spark.createDataFrame([(query,)], "q string").select(F.posexplode(matches(F.lower("q"), WORD)).alias("at", "word"))
        rows = asked.where(~F.col("word").isin(*STOP_WORDS)).select("at", stem("word").alias("stem")).orderBy("at").collect()
        stems = list(dict.fromkeys(r["stem"] for r in rows))
        if not stems:
            return {}
        near = sorted({r[0] for r in spark.createDataFrame([(s,) for s in stems], "s string").select(bucket("s", self.buckets)).collect()})
        known = self.words(spark).where(F.col("bucket").isin(near) & F.col("stem").isin(stems)).select("stem", "word").collect()
        return {s: sorted(r["word"] for r in known if r["stem"] == s) for s in stems}

    def search(self, spark: SparkSession, query: str) -> DataFrame:
        """doc_id and rank of the documents that hold every word of the query in any form, by the density of the stretches that hold them all. No rows for a query of stop words, or if a word is in no document."""
        terms = self.terms(spark, query)
        if not terms or not all(terms.values()):
            return spark.createDataFrame([], self.postings(spark).select("doc_id", F.lit(0.0).alias("rank")).schema)
        words = [w for found in terms.values() for w in found]
        near = sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(bucket("w", self.buckets)).collect()})
        hits = self.postings(spark).where(F.col("bucket").isin(near) & F.col("word").isin(words))
        as_stem = F.create_map(*[F.lit(x) for s, found in terms.items() for w in found for x in (w, s)])
        places = F.transform("places", lambda p: F.struct(p.alias("i"), F.element_at(as_stem, F.col("word")).alias("w")))
        held = hits.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list(places))).alias("places"), F.count_distinct(F.element_at(as_stem, F.col("word"))).alias("n"))
        return held.where(F.col("n") == len(terms)).select("doc_id", cover_rank("places", list(terms)).alias("rank"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, word and the word's places. Texts are dealt by their key, so a document's places are gathered where it is and no token is shuffled."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    dealt = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t")).repartition(1 + size // DEALT_BYTES, "doc_id")
    tokens = dealt.select("doc_id", F.posexplode(matches("_t", WORD)).alias("place", "word"))
    return tokens.where(~F.col("word").isin(*STOP_WORDS)).groupBy("doc_id", "word").agg(F.array_sort(F.collect_list("place")).alias("places"))


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = 64) -> SearchIndex:
    """Writes the index of a table of texts. Null and empty texts have no postings; a row's places are counted from 0; rows that share a key are one document, its places those of all of them."""
    posted = postings(docs, key, text).withColumn("bucket", bucket("word", buckets))
    posted.repartition(buckets * PARTS, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).sortWithinPartitions("bucket", "word", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings")
    index = SearchIndex(path, buckets)
    distinct = index.postings(docs.sparkSession).select("word").distinct().select("word", stem("word").alias("stem"))
    distinct.withColumn("bucket", bucket("stem", buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").parquet(f"{path}/words")
    return index
