"""The operators as filters and edits that keep the columns of documents, for the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontamination, jaccard_join, line_dedup, packing, quality
from marginalia.llm.common import materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it learns from the labels of the documents given.

    A null or empty text is scored as a text without words; a null doc_id has no label but is scored; repeated rows are
    kept or dropped together; an empty table gives no rows, and without labels all documents stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that an earlier document has; n_chars follows the text. One of which nothing but white space is left is a copy and goes; rows that lost no line stay, blank ones included."""
    edited = line_dedup.dedup(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
    return edited.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else edited


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity 0.8 or more), by id and then by a hash of the text.

    Rows are told apart by id and text: of two that share an id, one that is like no other stays. Of rows that repeat both
    id and text one stays; a null id is never grouped away, a text without words never grouped; an empty table gives no rows.
    """
    groups = materialise(jaccard_join.classes(docs, words=5, num=80, den=100), "groups")
    gone = groups.where("not leads").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    mark = "_text"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(gone, (marked["doc_id"].cast("long") == gone["_id"]) & (marked[mark] == gone["_key"]), "left_anti")
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no ten-word window of the benchmark.

    Null and empty texts stay, as does a row with a null doc_id; of rows that share an id only those go that hold a window; an empty table
    gives no rows, and an empty benchmark drops none.
    """
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a packed sequence (see packing.pack); null and empty texts are an end token alone; an empty table gives no rows."""
    return packing.pack(docs)
