"""The library's queries against DuckDB, and small golden cases of its operators."""

import datetime as dt
import importlib
import math
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.operators import analytics, documents, learning, relational, sequences
from marginalia.plans.catalogue import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(D):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{D}/{name}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, D), duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert plain([tuple(r) for r in ours.collect()], ours.columns) == plain(theirs.fetchall(), names)


def test_entry_without_the_subpackage(tmp_path):
    """The entry point works where the language-model folders and the pipeline are gone."""
    code = "import sys; sys.modules['marginalia.llm'] = None\nimport importlib.util as u\nold = u.find_spec\nu.find_spec = lambda n, *a: None if n == 'marginalia.llm' else old(n, *a)\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_sm2_state(spark):
    rows = [(u, i, g) for u, gs in {"a": "good good hard again easy".split(), "b": ["easy"], None: ["good"]}.items() for i, g in enumerate(gs)]
    found = {r[0]: tuple(r)[1:] for r in learning.schedule(spark.createDataFrame(rows, "user string, at int, grade string"), "user", ["at"], "grade").collect()}
    assert set(found) == {"a", "b"} and found["b"] == (1, 2.6, 1)
    state = (0, 2.5, 0)
    for g in "good good hard again easy".split():
        state = learning.review(state, g)
    assert found["a"] == pytest.approx(state)
    assert learning.review((6, 2.5, 2), "good") == (15, 2.5, 3) and learning.review((6, 1.3, 2), "again") == (1, 1.3, 0)


def test_funnel_golden(spark):
    stages = ["a", "b", "c", "d", "e"]
    rows = [(u, s) for s, n in zip(stages, (4, 3, 2, 1, 1)) for u in range(n)] + [(None, "a")]
    found = analytics.funnel(spark.createDataFrame(rows, "user_id int, event_type string"), stages).orderBy("stage").collect()
    assert [r["users"] for r in found] == [4, 3, 2, 1, 1] and found[0]["events"] == 5
    assert [r["from_start"] for r in found][:3] == [100.0, 75.0, 50.0] and found[2]["from_previous"] == 66.7


def test_retention_golden(spark):
    day = lambda d: dt.datetime(2026, 6, d)
    rows = [("A", day(1)), ("A", day(15)), ("B", day(1)), ("B", day(8)), ("C", day(15)), (None, day(1))]
    found = {(r["cohort"], r["week"]): (r["size"], r["percent"]) for r in analytics.retention(spark.createDataFrame(rows, "user_id string, ts timestamp"), "2026-06-22", 4).collect()}
    assert found[("2026-06-01", 0)] == (2, 100.0) and found[("2026-06-01", 1)] == (2, 50.0) and found[("2026-06-15", 1)] == (1, 0.0) and len(found) == 10


def test_average_fold_is_the_fold(spark):
    x = [1.0, 0.0, 0.35, 0.75, 1.0, 0.0]
    c = x[0]
    for v in x[1:]:
        c = c * 0.7 + v * 0.3
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, i int, v double")
    assert sequences.average_fold(df, ["k"], [F.desc("i")], F.col("v")).first()["confidence"] == pytest.approx(c, abs=1e-6)


def test_streaks_and_diversity(spark):
    days = spark.createDataFrame([("u", dt.date(2024, 1, d)) for d in (1, 2, 3, 5, 6)], "user_id string, day date")
    r = sequences.streaks(days, "2024-01-07").first()
    assert (r["longest"], r["current"], r["days"]) == (3, 2, 5)
    items = spark.createDataFrame([("u", i, s, c) for i, s, c in ((1, 50.0, "x"), (2, 49.0, "x"), (3, 48.0, "x"), (4, 40.0, "y"), (5, 39.0, None))], "u string, id int, s double, c string")
    top = sequences.diversify(items, ["u"], "s", "c", "id").orderBy(F.desc("effective"), "id").collect()
    assert [r["effective"] for r in top] == [50.0, 43.0, 40.0, 39.0, 36.0]


def test_relational_edges(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    kids = spark.createDataFrame([(1, True), (1, False), (2, True), (None, True)], "k int, ok boolean")
    assert [r[0] for r in relational.with_every(left, kids, ["k"], F.col("ok")).orderBy("k").collect()] == [2, 3]
    assert [tuple(r) for r in relational.child_counts(left, kids, ["k"]).orderBy("k").collect()] == [(1, 2), (2, 1), (3, 0)]


def test_chunks():
    sentences = ["a" * 400] * 5 + ["word " * 600] + ["b" * 3000]
    made = documents.chunk(sentences, 300, 50)
    assert all(-(-len(c) // 4) <= 300 + 10 for c in made) and "".join(made).count("b") == 3000
    assert documents.chunk([], 300, 50) == []


def test_quality_grades(spark):
    docs = spark.createDataFrame([(1, ""), (2, "The cat sat on the mat. " * 300), (3, "buy now!!! click here sale deal " * 60)], "doc_id int, text string")
    found = {r["doc_id"]: r for r in documents.quality(docs).collect()}
    assert found[1]["grade"] == "reject" and found[2]["grade"] == "ok" and found[2]["score"] == 100
    assert "advertising" in found[3]["reasons"] and "shouting" in found[3]["reasons"]


def test_streams_equal_batches(spark, tmp_path):
    from marginalia.streaming import events as ev

    rows = spark.read.parquet(f"{D}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    folder = str(tmp_path / "in")
    rows.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(folder)
    stream = ev.read(spark, folder)
    batch = rows.withColumn("ts", F.col("ts").cast("timestamp"))

    def drain(df, mode, name):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
        return spark.table(name)

    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(drain(ev.counters(stream, 3600, ["event_type"]), "complete", "counters"), ev.counters(batch, 3600, ["event_type"]))
    last = drain(ev.accepted(stream, "user_id", 86_400), "update", "accepted").groupBy("user_id").agg(F.max("accepted"))
    assert same(last, ev.accepted(batch, "user_id", 86_400))
    done = F.expr("event_type = 'purchase'")
    assert same(drain(ev.progress(stream.withColumn("d", done), "user_id", "value", "d"), "complete", "progress"), ev.progress(batch.withColumn("d", done), "user_id", "value", "d"))
