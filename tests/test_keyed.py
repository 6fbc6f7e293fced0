"""Keyed tables in buckets, and stored metadata, against plain code."""

import json
import os
import random
import re

from pyspark.sql import functions as F

from marginalia.functions import safety
from marginalia.sources.keyed import KeyedTable

FIELDS = "k long, v string, n int"


def files(path):
    return {os.path.join(a, f) for a, _, b in os.walk(path) for f in b if f.endswith(".parquet")}


def found(table, spark):
    return {r["k"]: (r["v"], r["n"]) for r in table.rows(spark).collect()}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), 16)
    rows = [(i, f"v{i}", i) for i in range(500)] + [(None, "none", 0), (3, "later", 900)]
    table.create(spark.createDataFrame(rows, FIELDS), ["n"])
    plain = {k: (v, n) for k, v, n in rows}
    assert found(table, spark) == plain and table.rows(spark).count() == 501
    before = files(table.path)
    changes = [(7, None, 70), (7, "old", 1), (1000, "new", 1), (None, "known", None)]
    asked = spark.createDataFrame(changes, FIELDS)
    touched = {r[0] for r in asked.select(F.pmod(F.xxhash64("k"), F.lit(16))).distinct().collect()}
    assert table.upsert(asked, ["n"]) == {"inserted": 1, "updated": 2, "refused": 0}
    plain |= {7: ("v7", 70), 1000: ("new", 1), None: ("known", 0)}
    assert found(table, spark) == plain
    in_touched = lambda f: int(re.search(r"bucket=(\d+)", f)[1]) in touched
    assert len(touched) <= 3 and {f for f in before if not in_touched(f)} == {f for f in files(table.path) if not in_touched(f)}
    assert not {f for f in before if in_touched(f)} & files(table.path)
    # the same changes once more give the same rows
    assert table.upsert(asked, ["n"])["inserted"] == 0 and found(table, spark) == plain


def test_guarded_updates(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), 8)
    table.create(spark.createDataFrame([(1, "open", 1), (2, "shut", 1), (3, None, 1)], FIELDS), ["n"])
    changes = spark.createDataFrame([(1, "taken", 2), (2, "taken", 2), (3, "taken", 2), (4, "taken", 2)], FIELDS)
    free = lambda old, new: old["v"] == "open"
    assert table.upsert(changes, ["n"], guard=free, insert=False) == {"inserted": 0, "updated": 1, "refused": 3}
    assert found(table, spark) == {1: ("taken", 2), 2: ("shut", 1), 3: (None, 1)}
    # who comes second is refused
    assert table.upsert(changes, ["n"], guard=free, insert=False)["updated"] == 0
    before = files(table.path)
    assert table.upsert(changes.limit(0), ["n"]) == {"inserted": 0, "updated": 0, "refused": 0} and files(table.path) == before


def test_keyed_table_of_two_keys_starts_empty(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("user", "word"), 4)
    words = "word string, user long, note string"
    table.create(spark.createDataFrame([("a", 0, "x")], words), ["note"])
    assert table.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("a", 0, None)], words), ["note"]) == {"inserted": 2, "updated": 1, "refused": 0}
    assert sorted(map(tuple, table.rows(spark).select("user", "word", "note").fillna("-").collect())) == [(0, "a", "x"), (1, "a", "x"), (1, "b", "-")]


def plain_metadata(text, keys=25, items=20, chars=200, depth=3):
    def cut(x):
        return re.sub(safety.LONG_TOKEN, "[token]", re.sub(safety.EMAIL, "[email]", x))[:chars]

    def members(x, level):
        return {k: "[redacted]" if re.search(safety.SENSITIVE_KEY, k) else value(x[k], level) for k in sorted(x, key=lambda k: k.encode())[:keys]}

    def value(x, level):
        if level > depth:
            return "[truncated]"
        if isinstance(x, dict):
            return members(x, level + 1)
        if isinstance(x, list):
            return [value(y, level + 1) for y in x[:items]]
        return cut(x) if isinstance(x, str) else x

    try:
        bag = json.loads(text)
    except (TypeError, ValueError):
        return {}
    return members(bag, 0) if isinstance(bag, dict) else {}


def test_safe_metadata(spark):
    rnd = random.Random(5)

    def made(level):
        kind = rnd.random()
        if level < 7 and kind < 0.3:
            return {rnd.choice("abcdefgh") * rnd.randint(1, 9) + rnd.choice(["", "", "token", '"', "é"]): made(level + 1) for _ in range(rnd.choice([0, 2, 5, 40]) if level < 3 else 2)}
        if level < 7 and kind < 0.5:
            return [made(level + 1) for _ in range(rnd.choice([0, 1, 3, 25]) if level < 3 else 1)]
        return rnd.choice([None, True, False, 3, -2.5, "", "me@x.org wrote", "q\"\\\n\tx", "z" * 300, "word " * 60, '{"a":1}', "[1]", "é漢😀"])

    texts = [json.dumps({"r": made(0), "s": made(0), "t": made(1)}) for _ in range(150)]
    texts += ["{}", '{"a":{}}', '{"a":[]}', "[1]", "3", '"x"', "null", "", "nope", None, '{"a":1', '{"token":{"b":1},"a":null}', json.dumps({f"k{i:02}": i for i in range(30)}), '{"a":{"b":{"c":{"d":{"e":1}}}}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", safety.safe_metadata("x").alias("y")).collect()
    for i, y in rows:
        assert json.loads(y) == plain_metadata(texts[i]), texts[i]
