"""Naive Bayes over tokens: training is one count, scoring one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train(docs: DataFrame, label: str, tokens: Column, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Log probabilities (label, token, logp; with unseen as logp of a token that the label never has) and labels (label, prior, unseen). Each token counts once a document; null labels are passed over."""
    rows = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.array_distinct(tokens).alias("_t"))
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    all_docs = n.agg(F.sum("n").alias("all"))
    counts = rows.select("label", F.explode("_t").alias("token")).groupBy("label", "token").agg(F.count("*").alias("c"))
    labels = n.join(F.broadcast(all_docs)).select("label", F.log(F.col("n") / F.col("all")).alias("prior"), F.log(smoothing / (F.col("n") + 2 * smoothing)).alias("unseen"), "n")
    model = counts.join(F.broadcast(labels), "label").select("label", "token", (F.log((F.col("c") + smoothing) / (F.col("n") + 2 * smoothing)) - F.col("unseen")).alias("gain"))
    return model, labels.drop("n")


def predict(docs: DataFrame, key: str, tokens: Column, model: DataFrame, labels: DataFrame, least: int = 0) -> DataFrame:
    """key, label and confidence (its share of the probability) of every document; the label is null with fewer than `least` tokens.

    A document's score of a label is its prior, the unseen term for each distinct token, and what the tokens that the
    label knows gain over that; only those are joined. Labels are few and are broadcast; ties go to the first by name.
    """
    rows = docs.select(key, F.array_distinct(tokens).alias("_t"), F.size(tokens).alias("_n"))
    gains = rows.select(key, F.explode("_t").alias("token")).join(model, "token").groupBy(key, "label").agg(F.sum("gain").alias("gain"))
    every = rows.select(key, "_n", F.size("_t").alias("_d")).join(F.broadcast(labels)).join(gains, [key, "label"], "left")
    scored = every.withColumn("_s", F.col("prior") + F.col("unseen") * F.col("_d") + F.coalesce("gain", F.lit(0.0)))
    best = scored.groupBy(key).agg(F.max("_s").alias("_best"), F.first("_n").alias("_n"), F.collect_list(F.struct("label", "_s")).alias("_all"))
    top = F.array_min(F.transform(F.filter("_all", lambda x: x["_s"] == F.col("_best")), lambda x: x["label"]))
    share = 1 / F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.exp(x["_s"] - F.col("_best")))
    return best.select(key, F.when(F.col("_n") >= least, top).alias("label"), F.when(F.col("_n") >= least, share).otherwise(0.0).alias("confidence"))


def excerpts(docs: DataFrame, key: str, text: str, label: str, each: int, low: int = 22, high: int = 50, seed: str = "corpus") -> DataFrame:
    """A balanced training corpus: the first `high` words of each text of `low` words or more, equal ones (without case and space) once, `each` of every label in the order of a seeded hash."""
    from marginalia.operators.sequences import newest

    words = F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), 1, high)
    rows = docs.where(F.col(label).isNotNull()).select(key, label, F.array_join(words, " ").alias("excerpt"), F.size(words).alias("n")).where(F.col("n") >= low)
    once = rows.withColumn("_same", F.md5(F.lower("excerpt"))).groupBy("_same").agg(F.min_by(F.struct(key, label, "excerpt"), key).alias("_r")).select("_r.*")
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return newest(once, [label], [order, F.col(key)], each)
