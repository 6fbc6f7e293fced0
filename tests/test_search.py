"""Stems, the search index, language profiles and the replay of queued changes."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from marginalia.functions.stems import STOP_WORDS, stem
from marginalia.operators import jobs, language, search_index
from marginalia.sources.tables import shared_folder

SF = "/root/testdata/sf0.01"
STEMS = {
    "caresses": "caress", "flies": "fli", "dies": "die", "denied": "deni", "agreed": "agre", "sized": "size", "stating": "state", "itemization": "item", "sensational": "sensat", "traditional": "tradit",
    "plotted": "plot", "generously": "generous", "generate": "generat", "hopping": "hop", "hoping": "hope", "happy": "happi", "cry": "cri", "by": "by", "say": "say", "gas": "gas", "gaps": "gap", "this": "this",
    "conditional": "condit", "rationalize": "ration", "operator": "oper", "decisiveness": "decis", "callousness": "callous", "sensibility": "sensibl", "electricity": "electr", "replacement": "replac",
    "adoption": "adopt", "communism": "communism", "activate": "activ", "probate": "probat", "cease": "ceas", "controlling": "control", "knightly": "knight", "apologies": "apolog", "exceed": "exceed", "skies": "sky", "": "",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", stem("w").alias("s")).collect()} == STEMS


def plain_rank(words, stems, terms):
    """All stretches from a place to the first later place by which every term was seen; the shortest of each end counts."""
    places = [(i, stems[w]) for i, w in enumerate(words) if w not in STOP_WORDS and stems[w] in terms]
    total, last = 0.0, -1
    for k, (end, _) in enumerate(places):
        begins = [max((i for i, t in places[: k + 1] if t == term), default=-1) for term in terms]
        if min(begins) > last:
            last = min(begins)
            total += 0.1 / (1 + end - last - (len(terms) - 1))
    return total


def test_index_against_whole_texts(spark):
    r = random.Random(5)
    words = "run running runs runner the and reading reads read book books walked walking slow of".split()
    rows = [(i, " ".join(r.choice(words) + r.choice(["", ",", ". ", "\n"]) for _ in range(r.randrange(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, "RUNNING, Books!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = search_index.build(docs, shared_folder(spark, "test-search"), buckets=8)
    stems = {x["w"]: x["s"] for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", stem("w").alias("s")).collect()}
    tokens = {i: re.findall("[a-z]+", (t or "").lower()) for i, t in rows}
    for query, terms in (("Books", ["book"]), ("the running of books", ["run", "book"]), ("read a book; slow walks", ["read", "book", "slow", "walk"])):
        wanted = {i: round(plain_rank(w, stems, terms), 9) for i, w in tokens.items() if {stems[x] for x in w if x not in STOP_WORDS} >= set(terms)}
        assert wanted and {x["doc_id"]: round(x["rank"], 9) for x in index.search(spark, query).collect()} == wanted, query
    assert index.terms(spark, "the running of RUNS") == {"run": ["run", "running", "runs"]}
    assert index.search(spark, "the of and").count() == 0 and index.search(spark, "books unheard").count() == 0
    found = index.search(spark, "books")
    files = {f for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(word" in plan and files and all("/postings/" in f for f in files)


def test_language_profiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.createDataFrame(language.profiles(docs.where("doc_id % 3 > 0")).collect())
    told = language.identify(docs, known).where("doc_id % 3 = 0 and language <> 'und' and lang is not null").select("lang", "language").collect()
    assert len(told) > 100 and sum(r["lang"] == r["language"] for r in told) / len(told) > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "word " * 28 + "w" * 300, None), (4, "a" * 250, "fr")], "doc_id long, text string, lang string")
    assert [(r["language"], r["distance"]) for r in language.identify(odd, known).collect()] == [("und", None)] * 4
    nothing = language.identify(docs.limit(3), known.limit(0)).collect()
    assert {(r["language"], r["distance"]) for r in nothing} == {("und", None)} and language.identify(odd.limit(0), known).count() == 0


def test_top_trigrams():
    r = random.Random(1)
    for _ in range(50):
        plain = "".join(r.choice("ab é") for _ in range(r.randrange(0, 60)))
        counts = Counter(plain[i : i + 3] for i in range(len(plain) - 2))
        assert language.top_trigrams(plain, 5) == [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))][:5]


def flushed(queue, tries, passes):
    """Passes over a queue, one after the other: what is done leaves it, what failed or waits holds back its key."""
    state = {i: ["held", 0, None, None] for i, _, _ in queue}
    for n in range(1, passes + 1):
        blocked = set()
        for i, key, answers in queue:
            s = state[i]
            if s[0] == "done":
                continue
            if key in blocked or s[0] == "failed":
                blocked.add(key)
                continue
            status = answers[s[1]] if s[1] < len(answers) else 500
            s[1], s[2], s[3] = s[1] + 1, s[2] or n, n
            if 200 <= status < 300 or status == 409:
                s[0] = "done"
            elif (400 <= status < 500 and status not in (408, 429)) or s[1] >= tries:
                s[0] = "failed"
            else:
                s[0] = "pending"
            if s[0] != "done":
                blocked.add(key)
    return {i: tuple(s) for i, s in state.items()}


def test_replay_against_passes(spark):
    r = random.Random(9)
    for passes, tries in ((1, 5), (4, 3), (30, 5)):
        queue = [(i, r.randrange(8), [r.choice([200, 204, 409, 429, 408, 500, 503, 404] + [200] * 6) for _ in range(r.randrange(0, 6))]) for i in range(150)]
        df = spark.createDataFrame([(i, k, a) for i, k, a in queue], "id int, key int, answers array<int>")
        found = {x["id"]: (x["state"], x["sent"], x["began"], x["ended"]) for x in jobs.replayed(df.repartition(3), ["key"], ["id"], "answers", tries, passes).collect()}
        assert found == flushed(queue, tries, passes)
    assert jobs.replayed(df.limit(0), ["key"], ["id"], "answers").count() == 0
    assert {x["state"] for x in jobs.replayed(df, ["key"], ["id"], "answers").collect()} <= {"done", "failed", "held"}


def test_response_classes(spark):
    codes = [200, 299, 409, 408, 429, 400, 404, 499, 500, 302, None]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c int").orderBy("i").select(jobs.response_class(F.col("c"))).collect()]
    assert got == ["done", "done", "done", "retry", "retry", "refused", "refused", "refused", "retry", "retry", "retry"]
