"""Feeds, recommendations and search pages: candidates, scores and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import math as m
from marginalia.functions.policy import SOURCE_BOOSTS, search_score
from marginalia.operators.relational import page


def topic_interest(topics, category, tags) -> Column:
    """1 for a category among the topics, else 0.4 for a tag and 0.8 for more; 0.5 where there are no topics."""
    t = F.coalesce(m.col(topics), F.array().cast("array<string>"))
    n = F.size(F.array_intersect(m.col(tags), t))
    return F.when(F.size(t) == 0, 0.5).when(F.array_contains(t, m.col(category)), 1.0).when(n > 0, F.least(F.lit(0.8), 0.4 + (n - 1) * 0.4)).otherwise(0.0)


def feed_score(topics, category, tags, delta, age, in_progress) -> Column:
    """score and reason: 40 for the category, 10 a tag up to 20, level and freshness points, 15 less while it is being read."""
    t = F.coalesce(m.col(topics), F.array().cast("array<string>"))
    hit = F.coalesce(F.array_contains(t, m.col(category)), F.lit(False))
    tag = F.least(F.lit(20), 10 * F.size(F.array_intersect(m.col(tags), t)))
    level, fresh = m.level_points(delta), m.freshness_points(age)
    score = F.when(hit, 40).otherwise(0) + tag + level + fresh - F.when(m.col(in_progress), 15).otherwise(0)
    reason = F.when(hit, "category").when(tag > 0, "tags").when(m.col(delta) == 0, "level").when(fresh >= 7, "fresh").otherwise("other")
    return F.struct(score.alias("score"), reason.alias("reason"))


def with_candidates(people: DataFrame, items: DataFrame, order: list, most: int, alias: str = "candidates") -> DataFrame:
    """Every person with an array of the first `most` items: one short list, broadcast as one row. The limit is the feature."""
    head = items.orderBy(*order).limit(most).agg(F.collect_list(F.struct(*items.columns)).alias(alias))
    return people.join(F.broadcast(head))


def spare(n: int, taken: Column) -> Column:
    """How long a list must be so that n are left when `taken` of them are passed over; in few steps, so that lists can be shared."""
    return (n + F.pow(F.lit(4.0), F.greatest(F.lit(1.0), F.ceil(F.log(4.0, F.greatest(taken, F.lit(1))))))).cast("int")


def within_bounds(df: DataFrame, by: list[str], need: str, low: Column, high: Column) -> DataFrame:
    """The rows that can be among a key's first `need` by a score between low and high: those whose high reaches the need-th largest low. Scores are rounded, so a key has few lows, which are counted."""
    rows = df.withColumns({"_low": low, "_high": high})
    counts = rows.groupBy(*by, need, "_low").agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc("_low")))
    floor = counts.withColumn("_above", above).where(F.col("_above") >= F.col(need)).groupBy(*by).agg(F.max("_low").alias("_floor"))
    return rows.join(floor, by, "left").where(F.col("_floor").isNull() | (F.col("_high") >= F.col("_floor"))).drop("_low", "_high", "_floor")


def sourced(branches: dict[str, DataFrame], key: str) -> DataFrame:
    """The union of candidate branches: each key once, with the sorted names of the branches that found it."""
    rows = reduce(DataFrame.unionByName, (df.select(key, F.lit(name).alias("_source")) for name, df in branches.items()))
    return rows.groupBy(key).agg(F.sort_array(F.collect_set("_source")).alias("sources"))


def search_page(found: DataFrame, fields: dict[str, str], query: str, terms: list[str], owned: Column, recency: str, title: str, number: int, size: int) -> DataFrame:
    """One page of candidates (with sources): by weighted fields and boosts, then recency, then title; with position."""
    boost = reduce(Column.__add__, [F.when(F.array_contains("sources", s), SOURCE_BOOSTS[s]).otherwise(0) for s in ("highlight", "saved_word")])
    scored = found.withColumn("score", (search_score(fields, query, terms) + boost + F.when(owned, SOURCE_BOOSTS["owned"]).otherwise(0)).cast("double"))
    return page(scored, [F.desc("score"), F.col(recency).desc_nulls_last(), F.col(title)], number, size)


def cover_rank(places, terms: list[str]) -> Column:
    """The rank of places (i, w) of the terms in order of i: a tenth for each shortest stretch with all of them, over one more than the other words in it. 0 where a term is missing.

    One pass over the places: the stretch that ends at a place begins at the earliest of the terms' last places, and
    counts once that place has moved on.
    """
    k = len(terms)
    start = F.struct(*[F.lit(-1).alias(f"p{i}") for i in range(k)], F.lit(-1).alias("begin"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        last = [F.when(x["w"] == t, x["i"]).otherwise(s[f"p{i}"]) for i, t in enumerate(terms)]
        begin = F.least(*last) if k > 1 else last[0]
        new = (begin >= 0) & (begin > s["begin"])
        noise = x["i"] - begin - (k - 1)
        return F.struct(*[v.alias(f"p{i}") for i, v in enumerate(last)], F.when(new, begin).otherwise(s["begin"]).alias("begin"), (s["sum"] + F.when(new, F.lit(0.1) / (1 + noise)).otherwise(0.0)).alias("sum"))

    return F.aggregate(m.col(places), start, step, lambda s: s["sum"])


def cover_density(tokens, terms: list[str]) -> Column:
    """cover_rank of the terms' places among a text's tokens."""
    places = F.filter(F.transform(m.col(tokens), lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(*terms))
    return cover_rank(places, terms)
