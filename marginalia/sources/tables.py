"""Readers of tables and of semi-structured inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; columns and filters used above it are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def first_match(df: DataFrame, predicate, *order) -> DataFrame:
    """The first row in order that meets a predicate."""
    return df.where(predicate).orderBy(*order).limit(1)


def feed_links(df: DataFrame, xml_col: str) -> DataFrame:
    """Article addresses of RSS documents: links and permalink guids, without query and fragment, each once, in order (array column links)."""
    item = F.regexp_extract_all(xml_col, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))
    link = lambda x: F.regexp_extract(x, r"(?s)<link>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)", 1)
    guid = lambda x: F.when(~x.rlike(r"(?i)<guid[^>]*isPermaLink=.false."), F.regexp_extract(x, r"(?s)<guid[^>]*>\s*(?:<!\[CDATA\[)?\s*(https?://[^<\]\s]+)", 1))
    one = F.transform(item, lambda x: F.regexp_replace(F.coalesce(F.nullif(link(x), F.lit("")), guid(x), F.lit("")), r"[?#].*$", ""))
    return df.withColumn("links", F.array_distinct(F.filter(one, lambda x: x.rlike("^https?://"))))


def json_pages(df: DataFrame, body_col: str, link_path: str = "$.link", most_pages: int = 5, page_col: str = "page") -> DataFrame:
    """One row for each entry of paged JSON listings, of the first pages only: page, position, link."""
    rows = df.where(F.col(page_col) <= most_pages).select(page_col, F.posexplode(F.from_json(body_col, "array<string>")).alias("position", "entry"))
    return rows.select(page_col, "position", F.get_json_object("entry", link_path).alias("link")).where(F.col("link").isNotNull())


def robots_rules(df: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """host, allow, pattern and length of the rules that robots files state for every agent (User-agent: *)."""
    lines = df.select(F.col(host_col).alias("host"), F.posexplode(F.split(F.lower(text_col), r"\r?\n")).alias("n", "line"))
    field = F.regexp_extract("line", r"^\s*([a-z-]+)\s*:", 1)
    value = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*[a-z-]+\s*:", ""), "#.*$", ""))
    lines = lines.select("host", "n", field.alias("field"), value.alias("value"))
    agents = F.when(F.col("field") == "user-agent", F.col("value"))
    from pyspark.sql import Window

    order = Window.partitionBy("host").orderBy("n")
    tagged = lines.withColumn("agent", F.last(agents, ignorenulls=True).over(order))
    rules = tagged.where((F.col("agent") == "*") & F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), F.length("value").alias("length"))


def allowed_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (host, path) with allowed: the longest matching rule decides, allow before disallow; no match allows. Rules are few a host, so they are joined as a table."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+(){}\[\]^|\\?])", r"\\$1"), r"\*", ".*"))
    hit = paths.join(rules, "host").where(F.regexp_like(F.lower("path"), pattern))
    best = hit.groupBy("host", "path").agg(F.max(F.struct("length", "allow")).alias("best"))
    return paths.join(best, ["host", "path"], "left").select("host", "path", F.coalesce(F.col("best.allow"), F.lit(True)).alias("allowed"))


def lines_of_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each: path, content."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation datasets in JSON files: feature and one row for each case."""
    return spark.read.json(path, multiLine=True).select("feature", F.explode("cases").alias("case")).select("feature", "case.*")


def fixture_articles(spark: SparkSession, n: int = 720) -> DataFrame:
    """Synthetic listing rows: every 9th a draft without a date, categories and levels in turn."""
    i = F.col("id")
    level = F.element_at(F.array(*map(F.lit, ("A1", "A2", "B1", "B2", "C1", "C2"))), (i % 6 + 1).cast("int"))
    category = F.element_at(F.array(*map(F.lit, ("world", "science", "culture", "tech"))), (i % 4 + 1).cast("int"))
    draft = i % 9 == 0
    return spark.range(n).select(
        "id", F.concat(F.lit("Article "), i).alias("title"), category.alias("category"), level.alias("difficulty"),
        F.when(draft, "draft").otherwise("published").alias("status"), (F.lit(200) + i % 900).cast("int").alias("word_count"),
        F.when(~draft, F.timestamp_seconds(F.lit(1_767_225_600) - i * 3600)).alias("published_at"),
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, else under the context's checkpoint folder; a local master may do with a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='marginalia-')}")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
