"""Joins, set operations, listings and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_some(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def with_none(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def with_every(df: DataFrame, other: DataFrame, on: list[str], holds: Column) -> DataFrame:
    """Rows none of whose children breaks the condition; rows without children stay."""
    return with_none(df, other.where(~F.coalesce(holds, F.lit(False))), on)


def child_counts(df: DataFrame, other: DataFrame, on: list[str], alias: str = "children", where: Column | None = None) -> DataFrame:
    """Children are counted before the join, so each key is joined once."""
    counts = (other if where is None else other.where(where)).groupBy(*on).agg(F.count("*").alias(alias))
    return df.join(counts, on, "left").withColumn(alias, F.coalesce(alias, F.lit(0)))


def nested(df: DataFrame, other: DataFrame, on: list[str], columns: list[str], alias: str) -> DataFrame:
    """Children as a sorted array of structs."""
    kids = other.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(alias))
    empty = F.array().cast(kids.schema[alias].dataType)
    return df.join(kids, on, "left").withColumn(alias, F.coalesce(alias, empty))


def related(edges: DataFrame, anchors: DataFrame, item: str, through: str) -> DataFrame:
    """Items that share a neighbour with an anchor: other and shared (distinct neighbours), anchors themselves left out. anchors: column item."""
    pairs = edges.select(item, through).distinct()
    reach = pairs.join(anchors.select(item), item, "left_semi").select(through).distinct()
    near = pairs.join(reach, through, "left_semi").join(anchors.select(item), item, "left_anti")
    return near.groupBy(F.col(item).alias("other")).agg(F.count("*").alias("shared"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of a listing with its 1-based position; the limit is the feature, so only the head is sorted in full."""
    head = df.orderBy(*order).limit(number * size)
    place = F.row_number().over(Window.orderBy(*order))
    return head.withColumn("position", place).where(F.col("position") > (number - 1) * size)


def after(df: DataFrame, order_col: str, key: str, last_order: Column, last_key: Column, size: int) -> DataFrame:
    """Keyset pagination, newest first: a filter that reaches the scan instead of an offset."""
    more = (F.col(order_col) < last_order) | ((F.col(order_col) == last_order) & (F.col(key) > last_key))
    return df.where(more).orderBy(F.desc(order_col), key).limit(size)


def claim(jobs: DataFrame, ready: Column, order: list, n: int) -> DataFrame:
    """The next n jobs in order, with their rank."""
    return page(jobs.where(ready), order, 1, n)


def tiered(df: DataFrame, tiers: list[Column], order: list, n: int) -> DataFrame:
    """Fills n places from the first tier, then the next; a row belongs to its first tier."""
    tier = F.coalesce(*[F.when(t, i + 1) for i, t in enumerate(tiers)])
    return page(df.withColumn("tier", tier).where(F.col("tier").isNotNull()), [F.col("tier"), *order], 1, n)


def top_groups(df: DataFrame, by: list[str], measure: Column, least: Column, n: int, alias: str = "total") -> DataFrame:
    """The n keys of greatest measure among those for which `least` (an aggregate) holds."""
    return df.groupBy(*by).agg(measure.alias(alias), least.alias("_ok")).where("_ok").drop("_ok").orderBy(F.desc(alias), *by).limit(n)


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def merge_first(sources: list[DataFrame], key: str) -> DataFrame:
    """A union in which an earlier source's row wins."""
    out = None
    for i, df in enumerate(sources):
        one = df.withColumn("_source", F.lit(i))
        out = one if out is None else out.unionByName(one)
    columns = [c for c in out.columns if c not in (key, "_source")]
    top = out.groupBy(key).agg(F.min(F.struct("_source", *columns)).alias("_top"))
    return top.select(key, *[F.col(f"_top.{c}").alias(c) for c in columns], (F.col("_top._source") + 1).alias("source_rank"))


def page_with_total(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page with total, pages (one at least) and has_more; the count is one number, joined to the page's few rows."""
    n = df.agg(F.count("*").alias("total"))
    rows = page(df, order, number, size).join(F.broadcast(n))
    return rows.withColumns({"pages": F.greatest(F.lit(1), F.ceil(F.col("total") / size)), "has_more": F.col("total") > number * size})


def merge_progress(server: DataFrame, client: DataFrame, key: str, done_at: float = 95) -> DataFrame:
    """percent and completed of a key on two sides: the further place; completed if either says so or the place is far enough."""
    both = server.select(key, "percent", "completed").unionByName(client.select(key, "percent", "completed"))
    made = both.groupBy(key).agg(F.max(F.coalesce("percent", F.lit(0.0))).alias("percent"), F.bool_or(F.coalesce("completed", F.lit(False))).alias("completed"))
    return made.withColumn("completed", F.col("completed") | (F.col("percent") >= done_at))
