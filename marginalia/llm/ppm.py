"""Language-model scores by prediction by partial matching over byte contexts, beside a smoothed word unigram."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import clean, crc_mod, deals, materialise, mix, raw_text, slices, stretches, table, text_bytes
from marginalia.llm.hashing import LOWER, KeyTable, prefix_sums, range_hash, word_bounds

ORDER = 5
#: Symbols are bytes and one boundary, which pads a text's first contexts and ends it.
BOUNDARY, BITS, SYMBOLS = 256, 9, 257
#: The words looked up in memory; the rest are looked up by a join.
HOT_WORDS = 500_000
#: The hash of the end token, which no word has.
END_WORD = np.uint64(0x0123456789ABCDEF)
MERGE_AT = 2_000_000
#: Texts are scored so many bytes at a time: each byte needs some 200 bytes of arrays.
SCORE_BYTES = 1 << 20


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (ORDER + 1)-grams that end at each byte and at each text's end, in order, and each text's range of them."""
    n = len(offsets) - 1
    padded = np.full(len(raw) + ORDER * n + 1, BOUNDARY, np.uint64)
    keep = np.ones(len(padded), bool)
    keep[-1] = False
    starts = offsets[:-1] + ORDER * np.arange(n)
    for k in range(ORDER):
        keep[starts + k] = False
    padded[keep] = raw
    grams = np.zeros(len(padded) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        grams = (grams << np.uint64(BITS)) | padded[k : len(padded) - ORDER + k]
    # gram i ends at padded[i + ORDER]; text t's first byte is padded[offsets[t] + ORDER * (t + 1)]
    first = offsets[:-1] + ORDER * np.arange(n)
    last = first + np.diff(offsets) + 1
    return grams, first, last


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[edge], np.add.reduceat(counts[order], edge)


class Tally:
    """Counts of keys, merged now and then to keep memory bounded by the number of distinct keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, weight: int = 1) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts.astype(np.int64) * weight))
        self.waiting += len(found)
        if self.waiting > MERGE_AT:
            self.parts = [self.total()]
            self.waiting = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return add_up(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


class Trie:
    """Context nodes of each order with their escape estimate (method C) and, for each context, the total that is left of its suffix's symbols once its own are excluded."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.nodes, self.hit, self.contexts, self.escape, self.rest, self.rest_escape, self.raw = [], [], [], [], [], [], []
        d_below = n_below = ctx_below = node_below = c_below = None
        for k in range(ORDER + 1):
            keys, c = grams.get(k + 1, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            ctx, start = np.unique(keys >> np.uint64(BITS), return_index=True)
            own = np.repeat(np.arange(len(ctx)), np.diff(np.append(start, len(keys))))
            n = np.add.reduceat(c, start) if len(ctx) else np.zeros(0, np.int64)
            d = np.diff(np.append(start, len(keys)))
            with np.errstate(divide="ignore", invalid="ignore"):
                self.hit.append(np.log10(c) - np.log10((n + d)[own]))
                self.escape.append(np.log10(d) - np.log10(n + d))
                self.raw.append(np.log10(c))
                if k:
                    mask = np.uint64((1 << BITS * k) - 1)
                    up = ctx_below.find(ctx & np.uint64((1 << BITS * (k - 1)) - 1))
                    shared = np.bincount(own, c_below[node_below.find(keys & mask)], len(ctx))
                    left, kinds = n_below[up] - shared, d_below[up] - d
                    self.rest.append(np.where(left + kinds > 0, np.log10(left + kinds), 0.0))
                    self.rest_escape.append(np.where(kinds > 0, np.log10(kinds) - np.log10(left + kinds), 0.0))
                else:
                    self.rest.append(np.zeros(len(ctx)))
                    self.rest_escape.append(np.zeros(len(ctx)))
            self.nodes.append(KeyTable(keys))
            self.contexts.append(KeyTable(ctx))
            ctx_below, node_below, n_below, d_below, c_below = self.contexts[-1], self.nodes[-1], n, d, c
        self.unseen = -math.log10(max(1, SYMBOLS - len(self.nodes[0].keys)))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last symbol after the others."""
        at = self.nodes[ORDER].find(grams)
        out = np.zeros(len(grams))
        known = at >= 0
        out[known] = self.hit[ORDER][at[known]]
        rest = np.flatnonzero(~known)
        gram, total, above = grams[rest], np.zeros(len(rest)), np.full(len(rest), -1, np.int64)
        for k in range(ORDER, -1, -1):
            if not len(rest):
                break
            mine = gram & np.uint64((1 << BITS * (k + 1)) - 1)
            ctx = self.contexts[k].find(mine >> np.uint64(BITS))
            node = np.full(len(rest), -1, np.int64) if k == ORDER else self.nodes[k].find(mine)
            fresh = above < 0
            hit, there = node >= 0, ctx >= 0
            got = np.where(fresh, self.hit[k][node] if len(self.hit[k]) else 0.0, (self.raw[k][node] if len(self.raw[k]) else 0.0) - (self.rest[k + 1][above] if k < ORDER and len(self.rest[k + 1]) else 0.0))
            out[rest[hit]] = (total + got)[hit]
            esc = np.where(fresh, self.escape[k][ctx] if len(self.escape[k]) else 0.0, self.rest_escape[k + 1][above] if k < ORDER and len(self.rest_escape[k + 1]) else 0.0)
            total = total + np.where(there, esc, 0.0)
            stay = ~hit
            rest, gram, total, above = rest[stay], gram[stay], total[stay], np.where(there, ctx, above)[stay]
        out[rest] = total + self.unseen
        return out


def gather(docs: DataFrame) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """From the training rows: counts of all words (word, n), and of all grams of 1 and 2 symbols (at most SYMBOLS ** 2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, pairs = Tally(), np.zeros(1 << 2 * BITS, np.int64)
        for batch in slices(batches, most=SCORE_BYTES):
            pairs += np.bincount((_ends(batch) & np.uint64((1 << 2 * BITS) - 1)).astype(np.int64), minlength=len(pairs))
            raw, offsets = raw_text(batch.column(1))
            raw = LOWER[raw]
            starts, ends, _ = word_bounds(raw, offsets)
            tally.add(np.concatenate((range_hash(prefix_sums(raw), starts, ends), np.full(batch.num_rows, END_WORD))))
        keys, counts = tally.total()
        held = np.flatnonzero(pairs)
        is_word = np.concatenate((np.ones(len(keys), bool), np.zeros(len(held), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(is_word), pa.array(np.concatenate((keys.view(np.int64), held))), pa.array(np.concatenate((counts, pairs[held])))], ["is_word", "word", "n"])

    learnt = clean(docs).where(crc_mod(10) != 0)
    made = materialise(learnt.mapInArrow(count, "is_word boolean, word long, n long").groupBy("is_word", "word").agg(F.sum("n").alias("n")), "words")
    pair = made.where("not is_word").orderBy("word").toArrow()
    keys, n = pair.column("word").to_numpy().view(np.uint64), pair.column("n").to_numpy()
    return made.where("is_word").select("word", "n"), {1: add_up(keys & np.uint64((1 << BITS) - 1), n), 2: (keys, n)}


def _ends(batch: pa.RecordBatch) -> np.ndarray:
    """The (ORDER + 1)-grams of a batch's texts, len(text) + 1 for each."""
    grams, first, last = symbols(*raw_text(batch.column(1)))
    keep = np.zeros(len(grams) + 1, np.int8)
    keep[first] += 1
    np.add.at(keep, last, -1)
    return grams[np.cumsum(keep[:-1]) > 0]


def gram_scores(dealt: DataFrame, short: dict[int, tuple[np.ndarray, np.ndarray]], shards: int) -> DataFrame:
    """place, keys and logs: log10 of the probability of each distinct (ORDER + 1)-gram of the texts of a place.

    Each place sends its distinct grams with their counts in training rows, 0 for those of held-out rows alone, to
    the shard of the last two symbols of their contexts. All contexts of two symbols and more that a gram's
    probability depends on, with all their symbols, lie in that shard; the grams of 1 and 2 symbols are given.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(short)

    def ask(texts: pa.Table) -> pa.Table:
        tally = Tally()
        for batch in slices(texts.select(["doc_id", "text", "held_out"]).to_batches(), most=SCORE_BYTES):
            for held, weight in ((False, 1), (True, 0)):
                part = batch.filter(pc.equal(batch.column(2), held))
                if part.num_rows:
                    tally.add(_ends(part), weight)
        keys, counts = tally.total()
        shard = mix(keys >> np.uint64(BITS) & np.uint64((1 << 2 * BITS) - 1)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        full, at = stretches(shard[order])
        keys, counts = keys[order], counts[order]
        place = np.full(len(full), texts.column("place")[0].as_py(), np.int32)
        return pa.table({"place": place, "shard": pa.array(full.astype(np.int32)), "keys": pa.array([keys[k].tobytes() for k in at], pa.binary()), "counts": pa.array([counts[k].tobytes() for k in at], pa.binary())})

    def answer(asked: pa.Table) -> pa.Table:
        raw, offsets = raw_text(asked.column("keys"))
        sent = np.frombuffer(raw, np.uint64)
        keys, counts = add_up(sent, np.frombuffer(raw_text(asked.column("counts"))[0], np.int64))
        grams, n = dict(shared.value), counts[counts > 0]
        known = keys[counts > 0]
        for size in range(ORDER + 1, 2, -1):
            known, n = add_up(known & np.uint64((1 << BITS * size) - 1), n)
            grams[size] = known, n
        trie = Trie(grams)
        logs = np.concatenate([trie.log10(keys[i : i + SCORE_BYTES]) for i in range(0, len(keys), SCORE_BYTES)])
        edges = (offsets // 8).tolist()
        out = [logs[np.searchsorted(keys, sent[i:j])].tobytes() for i, j in zip(edges, edges[1:])]
        return pa.table({"place": asked.column("place"), "keys": asked.column("keys"), "logs": pa.array(out, pa.binary())})

    asked = dealt.groupBy("place").applyInArrow(ask, "place int, shard int, keys binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "place int, keys binary, logs binary")


def score(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from all rows whose crc32(doc_id) mod 10 is not 0, and score all. A null text is empty: it has
    the end token alone. A null doc_id is held out. Repeated rows count, and are scored, as often as they occur. With
    nothing to learn from, no token is known and every symbol is as likely as any other. An empty table gives no rows.

    Rows are dealt to places, and each place asks once for each distinct byte gram, whose counts lie in shards. The
    frequent words' counts are broadcast (HOT_WORDS); those of rarer words are joined to the places they occur at.
    No count is left out of either model.
    """
    spark = docs.sparkSession
    places = deals(spark, text_bytes(docs))
    word, short = gather(docs)
    n_train, vocabulary = word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = math.log10(n_train + 0.1 * (vocabulary + 1))
    hot = word.orderBy(F.desc("n"), "word").limit(HOT_WORDS).toArrow()
    order = np.argsort(hot.column("word").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((hot.column("word").to_numpy().view(np.uint64)[order], hot.column("n").to_numpy()[order]))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        hot_keys, hot_counts = shared.value
        lookup, logs = KeyTable(hot_keys), np.log10(hot_counts + 0.1)
        grams = KeyTable(np.frombuffer(raw_text(answers.column("keys"))[0], np.uint64))
        gram_logs = np.frombuffer(raw_text(answers.column("logs"))[0], np.float64)
        made, done = [], 0
        for batch in slices(texts.select(["doc_id", "text", "place"]).to_batches(), most=SCORE_BYTES):
            raw, offsets = raw_text(batch.column(1))
            at = grams.find(_ends(batch))
            if (at < 0).any():
                raise ValueError("a gram of the texts has no answer")
            p = gram_logs[at]
            low = LOWER[raw]
            starts, ends, words = word_bounds(low, offsets)
            h = np.insert(range_hash(prefix_sums(low), starts, ends), words[1:], END_WORD)
            words = words + np.arange(len(words))
            at = lookup.find(h)
            part = np.where(at >= 0, logs[at] if len(logs) else 0.0, 0.0)
            seen = np.concatenate(([0], np.cumsum(at >= 0)))
            n = np.diff(words)
            rows = (batch.column(2)[0].as_py() << 40) + done + np.arange(batch.num_rows)
            done += batch.num_rows
            nil = pa.nulls(batch.num_rows, pa.int64())
            made.append([pa.array(rows), nil, batch.column(0), pa.array(n), pa.array(seen[words[1:]] - seen[words[:-1]]), pa.array(np.add.reduceat(part, words[:-1])), pa.array(np.add.reduceat(p, offsets[:-1] + np.arange(batch.num_rows)))])
            cold = np.flatnonzero(at < 0)
            if len(cold):
                row = rows[np.searchsorted(words, cold, "right") - 1]
                nil, none = pa.nulls(len(cold), pa.int64()), pa.nulls(len(cold), pa.float64())
                made.append([pa.array(row), pa.array(h[cold].view(np.int64)), nil, nil, nil, none, none])
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, ["row", "word", "doc_id", "n_tokens", "n_known", "part", "score"]) for x in made])

    schema = "row long, word long, doc_id long, n_tokens long, n_known long, part double, score double"
    dealt = clean(docs).withColumn("held_out", crc_mod(10) == 0).withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(places)).cast("int"))
    both = materialise(dealt.groupBy("place").cogroup(gram_scores(dealt, short, places).groupBy("place")).applyInArrow(run, schema), "scored")
    rare = (
        both.where(F.col("word").isNotNull())
        .select("row", "word")
        .join(word.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.count("n").alias("known"))
    )
    return (
        both.where(F.col("word").isNull())
        .join(rare, "row", "left")
        .select(
            "doc_id",
            (crc_mod(10) == 0).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(n_train).cast("long").alias("train_tokens"),
            (F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
            "score",
        )
    )


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
