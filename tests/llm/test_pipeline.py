"""The corpus pipeline: each stage keeps what is clean, and its columns; each against brute force on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
from marginalia.llm import quality, stages
from marginalia.llm.common import materialise
from marginalia.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import brute_components, brute_windows, crc, encoded, lower

D = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]*").fullmatch


def test_the_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "pack"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_lines_and_near_duplicates(spark, docs, texts):
    lines = stages.drop_lines(spark, docs, "")
    left = {r["doc_id"] for r in lines.collect()}
    assert lines.columns == docs.columns and left == {i for i, _ in texts} - {3}  # a whole copy of document 2
    kept = stages.keep_first(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 not in ids and 12 not in ids and {2, 11, 14, 15, 100, 101, None} <= set(ids) and ids.count(2) == 1


def test_rows_that_share_an_id(spark):
    """A row goes for its own text only, not for that of another row with its id."""
    near = " ".join(f"word{k}" for k in range(100))
    rows = [(1, near), (7, near + " more"), (7, "a text that is like no other one in the table at all"), (9, near + " other"), (9, near + " and so on"), (9, None), (None, near)]
    kept = stages.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(kept.collect(), key=str) == sorted([rows[0], rows[2], rows[5], rows[6]], key=str)
    apart = [(3, near), (3, near + " more"), (4, near + " less")]  # the first by id, then by text
    assert [r["doc_id"] for r in stages.keep_first(spark, spark.createDataFrame(apart, "doc_id long, text string"), "").collect()] == [3]
    item = spark.read.parquet(f"{D}/benchmark.parquet").where("length(text) > 200").first()["text"]
    docs = spark.createDataFrame([(1, item), (1, "clean words"), (2, None)], "doc_id long, text string")
    assert sorted(stages.drop_leaks(spark, docs, D).collect(), key=str) == [(1, "clean words"), (2, None)]


def test_odd_rows_pass_every_stage(spark, docs, nothing):
    """Nulls, blank, long and repeated rows, and clashing names, in the stages that look up tables of their own; then no rows."""
    for stage in (stages.keep_good, stages.drop_leaks):
        kept = stage(spark, docs, D)
        assert kept.columns == docs.columns and kept.count() > 0
        assert stage(spark, nothing, D).count() == 0
    ids = {r["doc_id"] for r in stages.drop_leaks(spark, docs, D).collect()}
    assert {None, 100, 101, 102} <= ids
    assert stages.pack(spark, docs, D).where("doc_id is null or doc_id = 100").count() >= 2 and stages.pack(spark, nothing, D).count() == 0


def plain_lines(rows):
    """Line dedup over (id, text) rows: what is left, without the texts that lost all they had."""
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == i]
        if len(kept) == len(lines) or not BLANK("\n".join(kept)):
            out.append((i, "\n".join(kept)))
    return out


def test_every_stage_of_a_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = materialise(stage(spark, docs, D), name)
        assert docs.columns == columns
        left = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
        seen[name] = len(left)
        if name == "quality":
            source = spark.read.parquet(f"{D}/documents.parquet")
            model = quality.train(source, spark.read.parquet(f"{D}/labels.parquet"))
            good = model.score(quality.features([(t or "").encode() for _, t in rows])) >= quality.THRESHOLD
            wanted = [(i, t or "") for (i, t), g in zip(rows, good) if g]
        elif name == "lines":
            wanted = plain_lines(rows)
        elif name == "near_duplicates":
            wanted = [(i, t) for (i, t), (_, _, top) in zip(rows, brute_components(rows, 5, 80, 100)) if i == top]
        else:
            wanted = [(i, t) for (i, t), (_, _, hit, _) in zip(rows, brute_windows(rows, benchmark)) if not hit]
        assert left == sorted(wanted), name
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, D).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for i, ids in encoded([(r["doc_id"], r["text"]) for r in docs.collect()], 1):
        at = 0
        for start, length, c in sorted(pieces.pop(i)):
            assert start == at and crc(ids[start : start + length]) == c
            at += length
        assert at == len(ids)
    assert not pieces and 0 < seen["decontaminate"] <= seen["near_duplicates"] <= seen["lines"] <= seen["quality"]


def encoded_tokens(rows):
    return sum(r["length"] for r in rows)


def test_the_whole_run(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    ids = {r["doc_id"] for r in rows}
    assert 0 < len(ids) <= spark.read.parquet(f"{D}/documents.parquet").count()
    assert encoded_tokens(rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
