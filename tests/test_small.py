"""Alerts, payload fields, summaries by several keys and names in sentences: odd cases."""

from pyspark.sql import functions as F

from marginalia.functions import lexical
from marginalia.operators import analytics, jobs


def test_payload_fields(spark):
    rows = ['{"a": "x", "b": 1}', '{"a": null, "b": "y"}', '["a"]', "broken {", None, '{"a": {"b": "z"}}', '"a"', '{"a": ""}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string").orderBy("i")
    assert [tuple(r) for r in df.select(*jobs.payload_fields("p", "a", "b")).collect()] == [("x", None), (None, "y"), (None, None), (None, None), (None, None), (None, None), (None, None), ("", None)]


def test_alerts(spark):
    rows = [(1, "a", False), (2, "a", None), (3, "b", True), (4, "a", False), (5, None, False), (6, None, False), (7, None, False)]
    found = jobs.alerts(spark.createDataFrame(rows, "at int, print string, fatal boolean"), "print", ["at"], 3, F.col("fatal"))
    assert sorted((r["at"], r["occurrences"], r["alert"]) for r in found.collect()) == [(1, 1, False), (2, 2, False), (3, 1, True), (4, 3, True), (5, 1, False), (6, 2, False), (7, 3, True)]


def test_summary_by(spark):
    rows = [("x", "m", 1), (None, "m", 2), ("x", "n", None)]
    df = spark.createDataFrame(rows, "f string, m string, n int")
    made = sorted(tuple(r) for r in analytics.summary_by(df, ["f", "m"], ["n"], {"big": F.col("n") > 1}).collect())
    assert made == [("f", "unknown", 1, 2, 1), ("f", "x", 2, 1, 0), ("m", "m", 2, 3, 1), ("m", "n", 1, None, 0), ("total", "", 3, 3, 1)]
    assert analytics.summary_by(df.limit(0), ["f", "m"], ["n"], {}).count() == 0


def test_proper_nouns(spark):
    said = ["Anna met Bob and NASA in McDonald", "The end", "", None, "x Bob Bob iPhone A B-C"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(lexical.proper_nouns("s")).collect()] == [["Bob", "NASA", "McDonald"], [], [], [], ["Bob"]]
