"""Writers and output formats; each returns rows or DataFrames, so that any Spark writer can take them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def csv_field(c: Column) -> Column:
    """RFC 4180: quoted only where a comma, quote or line end asks for it; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_rows(df: DataFrame) -> DataFrame:
    """One text row for each row; write with CRLF as the line separator."""
    return df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in df.columns]).alias("line"))


def long_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """section, key, label, value, extra of several reports in one long table; each report has key and value, and may have label and extra."""
    def one(name: str, df: DataFrame) -> DataFrame:
        text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit("")
        return df.select(F.lit(name).alias("section"), text("key").alias("key"), text("label").alias("label"), text("value").alias("value"), text("extra").alias("extra"))

    return reduce(DataFrame.unionByName, (one(n, d) for n, d in sections.items()))


def tab_rows(df: DataFrame, front: str, back: str, example: str) -> DataFrame:
    """Flashcards as tab-separated text, with tabs and line ends of the fields as spaces."""
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]+", " ")
    return df.select(F.concat_ws("\t", flat(front), F.concat_ws("<br>", flat(back), F.nullif(flat(example), F.lit("")))).alias("line"))


def exposition(counters: DataFrame) -> DataFrame:
    """Counters (name, labels map, value) in the Prometheus text format."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return counters.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key: order must be descending and total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key. new must hold a key once (see latest)."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def raise_only(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """A guarded update: a row changes only to a greater value."""
    both = old.select(key, value).unionByName(new.select(key, value))
    return both.groupBy(key).agg(F.max(value).alias(value))


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows that a delete leaves; a null predicate deletes nothing."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def erase(tables: dict[str, DataFrame], users: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given users."""
    return {name: df.join(users.select(key), key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def export_bundle(users: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a user with each child table's rows, ordered, as an array; a user's own rows are few."""
    out = users.select(key)
    for name, df in children.items():
        rest = [c for c in df.columns if c != key]
        out = out.join(df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
    return out


def skip_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Drafts whose source isn't stored yet, each source once."""
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def prune(df: DataFrame, time_col: str, now: Column, days: int) -> DataFrame:
    """Rows not older than so many days; on a table partitioned by day this drops whole partitions."""
    return df.where(F.col(time_col) >= now - F.make_dt_interval(F.lit(days)))
