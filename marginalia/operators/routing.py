"""Which source a page comes from: rules by host, told apart by address patterns, joined as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.html import host
from marginalia.functions.math import col


def suffixes(c) -> Column:
    """A host and its parents, without a lone last label: a.b.org gives a.b.org and b.org."""
    labels = F.split(col(c), r"\.")
    n = F.size(labels)
    many = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(n > 1, many).otherwise(F.array(col(c)))


def routed(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, rule and category of every page: that of the rule with the longest suffix of its host whose pattern its address matches; ties go to the smaller rule. Null without one.

    rules: rule, suffix, pattern (null: any address), category. A page is looked up once for each of its host's few suffixes, and a pattern is
    tried only for pages of its own host, once for all rules of a suffix that have it. Pages with equal keys share the best rule of all of them; a null url has none.
    """
    asked = pages.select(key, F.col(url).alias("_url"), F.explode(suffixes(host(url))).alias("suffix"))
    # Of the rules of one suffix and pattern only the smallest can be the best; else a host's pages would meet all of its rules.
    first = rules.groupBy("suffix", "pattern").agg(F.min_by(F.struct("rule", "category"), F.struct("rule", "category")).alias("_r")).select("suffix", "pattern", "_r.rule", "_r.category")
    hit = asked.join(first, "suffix").where(F.col("pattern").isNull() | F.regexp_like("_url", F.col("pattern")))
    # Most characters first, then the smallest rule.
    best = hit.groupBy(key).agg(F.min_by(F.struct("rule", "category"), F.struct(-F.length("suffix"), F.col("rule"))).alias("_best"))
    return pages.select(key).join(best, key, "left").select(key, "_best.rule", "_best.category")
