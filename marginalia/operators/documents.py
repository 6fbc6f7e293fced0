"""Document operators: repetition, quality grades, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.html import link_density
from marginalia.functions.math import let, rnd
from marginalia.operators import extract


def trigram_runs(t) -> Column:
    """most and twice of an array of words: occurrences of the commonest word trigram, and of all that occur twice or more. Hashes are sorted within the row, and runs counted in one pass; nothing is shuffled."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("twice"))

    def step(s: Column, g: Column) -> Column:
        run = F.when(s["last"] == g, s["run"] + 1).otherwise(1)
        return F.struct(g.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"), (s["twice"] + F.when(run == 2, 2).when(run > 2, 1).otherwise(0)).alias("twice"))

    def of(words: Column) -> Column:
        grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.slice(words, i, 3))))
        return F.when(F.size(words) >= 3, F.aggregate(grams, start, step)).otherwise(start)

    return let(t, of)


def trigram_repetition(docs: DataFrame, least: int = 30) -> DataFrame:
    """doc_id, most (occurrences of the commonest word trigram), trigrams, repeated (share in trigrams seen twice or more); texts of fewer tokens are left out."""
    rows = docs.select("doc_id", tx.tokens("text").alias("_t")).where(F.size("_t") >= least)
    rows = rows.select("doc_id", (F.size("_t") - 2).cast("long").alias("trigrams"), trigram_runs(F.col("_t")).alias("_r"))
    return rows.select("doc_id", F.col("_r.most").cast("long").alias("most"), "trigrams", rnd(F.when(F.col("_r.twice") > 0, F.col("_r.twice")) / F.col("trigrams"), 4).alias("repeated"))


def quality(docs: DataFrame) -> DataFrame:
    """score (100 less deductions), grade (reject, warn or ok) and reasons of each text. Reject and warn reasons are the classes of their deductions."""
    counts = tx.readability_counts("text")
    rows = docs.select("*", *[counts[k].alias(k) for k in ("n_words", "n_sentences")], tx.tokens("text").alias("_t"))
    rows = rows.withColumns({"_stop": tx.stopword_ratio(F.col("_t")), "_upper": tx.uppercase_ratio("text"), "_junk": tx.garbage_ratio("text"), "_ads": tx.ad_hits("text"), "_footer": tx.boilerplate_hits("text"), "_code": tx.code_symbol_density("text")})
    n = F.col("n_words")
    rules = [
        ("reject", "empty", F.trim("text") == "", 100),
        ("reject", "too_short", n.between(1, 49), 50),
        ("reject", "short", n.between(50, 999), 40),
        ("reject", "code", F.col("_code") > 0.02, 60),
        ("warn", "garbage", F.col("_junk") > 0.02, 25),
        ("warn", "boilerplate", F.col("_footer") >= 3, 20),
        ("warn", "few_stopwords", (F.size("_t") >= 30) & (F.col("_stop") < 0.2), 25),
        ("warn", "advertising", (F.size("_t") >= 20) & (F.col("_ads") * 100.0 / F.greatest(n, F.lit(1)) > 3), 25),
        ("warn", "few_sentences", (F.size("_t") >= 40) & ((F.col("n_sentences") < 2) | (n / F.greatest("n_sentences", F.lit(1)) < 5)), 20),
        ("soft", "brief", n.between(50, 149), 10),
        ("soft", "shouting", (F.col("_upper") > 0.3) | F.col("text").rlike("[!?]{3,}"), 5),
    ]
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(p).alias("p"))) for k, r, c, p in rules]))
    rows = rows.withColumn("_hit", hit)
    worst = F.when(F.exists("_hit", lambda x: x["k"] == "reject"), "reject").when(F.exists("_hit", lambda x: x["k"] == "warn"), "warn").otherwise("ok")
    score = F.greatest(F.lit(0), 100 - F.aggregate("_hit", F.lit(0), lambda a, x: a + x["p"]))
    return rows.select(*docs.columns, score.alias("score"), worst.alias("grade"), F.transform("_hit", lambda x: x["r"]).alias("reasons"))


# The checks after which a rejected text may still be recovered.
RECOVERABLE = ("reading_time", "missing_author", "missing_date")


def grade(docs: DataFrame, paywall: tuple[str, ...] = (r"subscribe to (?:read|continue)", r"already a subscriber", r"to continue reading")) -> DataFrame:
    """All eighteen checks of an article: score (100 less deductions), grade, the checks that failed, and whether a rejected one may be recovered.

    docs: text, html, url, words, author, published, lang (null: undetermined) and ad (confidence that it is an
    advertisement; null: unknown). A rejecting check outweighs warnings, and these outweigh soft ones.
    """
    density, code_hits = extract.code_signal("text")
    digest = extract.digest_signal("html", "text", "url")
    rows = docs.withColumn("_t", tx.tokens("text")).withColumns({"_stop": tx.stopword_ratio(F.col("_t")), "_upper": tx.uppercase_ratio("text"), "_junk": tx.garbage_ratio("text"), "_ads": tx.ad_hits("text"), "_footer": tx.boilerplate_hits("text"), "_density": density, "_code": code_hits, "_links": link_density("html"), "_gram": trigram_runs(F.col("_t")), "_sentences": tx.sentence_count("text"), **{f"_{k}": v for k, v in digest.items()}})
    words, n, size = F.col("words"), F.size("_t"), F.length("text")
    filled = F.trim("text") != ""
    prose = n >= 30
    per_sentence = F.when(F.col("_sentences") > 0, n / F.col("_sentences")).otherwise(n)
    weak = (n >= 40) & ((F.col("_sentences") < 2) | (per_sentence < 5))
    thin = prose & (F.col("_stop") < 0.2)
    foreign = (size >= 200) & prose & F.col("lang").isNotNull() & ~F.col("lang").isin("und", "eng", "en")
    in_code = (size >= 400) & (F.col("_code") >= 6) & ((F.col("_density") >= 0.03) | ((F.when(prose, F.col("_stop")).otherwise(1.0) <= 0.2) & (F.col("_density") >= 0.0225)))
    listed = F.col("text").rlike(r"(?i)\bthe\s+must-?reads\b") & ((F.col("_numbered") >= 5) | (F.col("_strong") >= 5)) & (F.col("_outbound") >= 3)
    clean = ~thin & ~weak & ~foreign & (words >= 150)
    rules = [
        ("reject", "empty_body", ~filled, 100), ("reject", "word_count", words < 50, 50), ("soft", "short", words.between(50, 149), 10), ("reject", "reading_time", words.between(50, 999), 40),
        ("warn", "paywall", filled & F.col("text").rlike("(?i)" + "|".join(paywall)), 30), ("warn", "encoding", filled & (F.col("_junk") > 0.02), 25),
        ("warn", "link_density", filled & (F.col("_links") > 0.5), 20), ("warn", "boilerplate", filled & (F.col("_footer") >= 3), 20),
        ("reject", "code", filled & in_code, 60), ("reject", "digest", filled & listed, 60), ("reject", "non_english", filled & foreign, 60),
        ("warn", "stopwords", filled & thin, 25), ("warn", "advertising", filled & (n >= 20) & (F.col("_ads") * 100.0 / F.greatest(n, F.lit(1)) > 3), 25), ("warn", "sentences", filled & weak, 20),
        ("soft", "shouting", filled & ((F.col("_upper") > 0.3) | F.col("text").rlike("[!?]{3,}")), 5),
        ("warn", "repetitive", filled & prose & (F.col("_gram.most") >= 5) & (F.col("_gram.most") / F.greatest(n - 2, F.lit(1)) >= 0.08), 15),
        ("warn", "classifier", filled & (words >= 50) & ~clean & (F.coalesce("ad", F.lit(0.0)) >= 0.85), 25),
        ("soft", "missing_author", F.coalesce("author", F.lit("")) == "", 5), ("soft", "missing_date", F.col("published").isNull(), 5),
    ]
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(p).alias("p"))) for k, r, c, p in rules]))
    rows = rows.withColumn("_hit", hit)
    worst = F.when(F.exists("_hit", lambda x: x["k"] == "reject"), "reject").when(F.exists("_hit", lambda x: x["k"] == "warn"), "warn").otherwise("ok")
    failed = F.transform(F.filter("_hit", lambda x: x["r"] != "short"), lambda x: x["r"])
    recover = (worst == "reject") & (words >= 760) & F.forall(failed, lambda x: x.isin(*RECOVERABLE))
    return rows.select(*docs.columns, F.greatest(F.lit(0), 100 - F.aggregate("_hit", F.lit(0), lambda a, x: a + x["p"])).alias("score"), worst.alias("grade"), failed.alias("failed"), recover.alias("recoverable"))


def _pieces(sentence: str, budget: int) -> list[str]:
    """A sentence longer than the budget of characters as runs of words, words longer than it cut."""
    out, line = [], ""
    for word in sentence.split():
        while len(word) > budget:
            out += [line] * bool(line) + [word[:budget]]
            line, word = "", word[budget:]
        if line and len(line) + 1 + len(word) > budget:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return out + [line] * bool(line)


def chunk(sentences: list[str], most: int, overlap: int) -> list[str]:
    """Chunks of at most `most` estimated tokens; each begins with the last whole segments of the one before that fit in the overlap."""
    cost = lambda s: -(-len(s) // 4)
    segments = [p for s in sentences for p in (_pieces(s, (most - overlap) * 4) if cost(s) > most - overlap else [s])]
    out, now, size = [], [], 0
    for s in segments:
        if now and size + cost(s) > most:
            out.append(" ".join(now))
            tail, kept = [], 0
            for x in reversed(now):
                if kept + cost(x) > overlap:
                    break
                tail.insert(0, x)
                kept += cost(x)
            now, size = tail, kept
        now.append(s)
        size += cost(s)
    return out + [" ".join(now)] * bool(now)


def chunks(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """doc_id, chunk (from 0), chars and hash of every chunk. The sentences are split in the JVM; only the packing, a fold over them, is Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, c) for d, s in zip(frame["doc_id"], frame["s"], strict=True) for i, c in enumerate(chunk(list(s), most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "body"])

    made = docs.select("doc_id", tx.sentences("text").alias("s")).mapInPandas(run, "doc_id long, chunk int, body string")
    return made.select("doc_id", "chunk", F.length("body").alias("chars"), tx.content_hash("body").alias("hash"))
