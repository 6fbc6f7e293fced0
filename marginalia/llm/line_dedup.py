"""Line deduplication by a sharded minimal perfect hash over the distinct keys of repeated lines.

Each shard of the index is written as one row of arrays; documents probe the arrays, not the lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import deals, materialise, mix, raw_text, slices, stretches, table, text_bytes

MIN_CHARS = 10
NO_ID = (1 << 63) - 1
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: levels of bit arrays in which each key alone at its slot is settled; the rank of its bit is its index."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        self.size, rest = 0, keys
        while len(rest):
            size = 64 * max(1, int(len(rest) * gamma) // 64)
            slot = self._slots(rest, len(self.levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            self._add(size, np.packbits(alone, bitorder="little"))
            rest = rest[~alone[slot]]

    @classmethod
    def of_bits(cls, sizes: list[int], bits: np.ndarray) -> PerfectHash:
        """The hash from its levels' sizes and bits alone."""
        made, at = cls(np.zeros(0, np.uint64)), 0
        for size in sizes:
            made._add(size, bits[at : at + size // 8])
            at += size // 8
        return made

    def _add(self, size: int, packed: np.ndarray) -> None:
        ones = np.cumsum(ONES[packed], dtype=np.int64)
        self.levels.append((size, packed, ones - ONES[packed], self.size))
        self.size += int(ones[-1])

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; a key that isn't in the set gets -1 or that of another key."""
        found, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (size, packed, ranks, base) in enumerate(self.levels):
            if not len(todo):
                break
            slot = self._slots(keys[todo], k, size)
            byte, bit = slot >> 3, (slot & 7).astype(np.uint8)
            here = (packed[byte] >> bit) & 1 == 1
            below = ONES[packed[byte] & ((np.uint16(1) << bit) - np.uint16(1)).astype(np.uint8)]
            found[todo[here]] = (base + ranks[byte] + below)[here]
            todo = todo[~here]
        return found


class LineIndex:
    """One shard of the index: the perfect hash and, by its indices, arrays of fingerprints, document counts (2 stands for more) and first documents.

    A shard is kept as one row of a table: the sizes of the levels, their bits, and the arrays. Of keys that share the
    hashed half all but one are kept as they are, beside the arrays.
    """

    SCHEMA = "shard int, levels array<long>, bits binary, prints binary, counts binary, first binary, rest binary"

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray, first: np.ndarray, rest: np.ndarray):
        self.hash, self.prints, self.counts, self.first, self.rest = hashed, prints, counts, first, rest

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, first: np.ndarray) -> LineIndex:
        one = np.zeros(len(keys), bool)
        one[np.unique(keys, return_index=True)[1]] = True
        rest = np.stack((keys.view(np.int64), prints.view(np.int64), counts.astype(np.int64), first), 1)[~one]
        keys, prints, counts, first = keys[one], prints[one], counts[one], first[one]
        hashed = PerfectHash(keys)
        order = np.argsort(hashed.index(keys), kind="stable")
        return cls(hashed, prints[order], np.minimum(counts[order], 2).astype(np.uint8), first[order], rest)

    def row(self, shard: int) -> pa.RecordBatch:
        levels = self.hash.levels
        data = [b"".join(packed.tobytes() for _, packed, _, _ in levels), self.prints.tobytes(), self.counts.tobytes(), self.first.tobytes(), self.rest.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([[size for size, _, _, _ in levels]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in data)], ["shard", "levels", "bits", "prints", "counts", "first", "rest"])

    @classmethod
    def from_row(cls, row: dict) -> LineIndex:
        take = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(PerfectHash.of_bits(row["levels"], take("bits", np.uint8)), take("prints", np.uint64), take("counts", np.uint8), take("first", np.int64), take("rest", np.int64).reshape(-1, 4))

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the count (0: not in the index) and the first document."""
        at = self.hash.index(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        count, first = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        count[known], first[known] = self.counts[at[known]], self.first[at[known]]
        for k, p, n, doc in self.rest:
            here = (keys.view(np.int64) == k) & (prints.view(np.int64) == p)
            count[here], first[here] = n, doc
        return count, first


def line_key(line: bytes, least: int) -> tuple[int, int] | None:
    """A 128-bit hash in two halves of a line's key: white space stripped at both ends, A-Z lower-cased; None below `least` code points."""
    key = line.strip().lower()
    n = len(key)
    if n < least or not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < least:
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return h & 0xFFFFFFFFFFFFFFFF, h >> 64


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row of docs, with repeated lines taken out of its text, and n_lines, n_dropped and kept_sha256.

    A line whose key has min_chars code points and is found in two documents or more stays only in the document
    with the smallest id. A null text is one empty line and gives an empty text. Rows that share an id count as one
    document; a null id counts as the largest. An empty table gives no rows. Columns of docs named like the three
    counts are replaced; all others are kept as they are.

    The index is built first, from line hashes that are combined before they meet, and written shard by shard. Then
    documents, dealt to groups by id, send the distinct hashes of their group to the shards, which look them up in
    their arrays and answer with the first document of each repeated one. A line that all documents share is so asked
    for once a group.
    """
    spark = docs.sparkSession
    groups = deals(spark, text_bytes(docs, text_col))
    own = ["n_lines", "n_dropped", "kept_sha256"]
    kept = docs.drop(*[c for c in docs.columns if c in own])
    place = "_group"
    while place in kept.columns:
        place += "_"
    names = kept.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    # Rows without an id are told apart by their texts: they are one document, but need no one group.
    dealt = kept.withColumn(place, F.pmod(F.coalesce(F.xxhash64(id_col), F.lit(0)) + F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(0), F.lit(groups)).cast("int"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The line hashes of each slice of texts, with the first and the last document that has each."""
        for batch in slices(batches):
            first: dict[tuple[int, int], int] = {}
            last: dict[tuple[int, int], int] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc = NO_ID if doc is None else doc
                for line in (text or "").encode().split(b"\n"):
                    if k := line_key(line, min_chars):
                        first[k] = min(doc, first.get(k, doc))
                        last[k] = max(doc, last.get(k, doc))
            if first:
                h1, h2 = (np.array(h, np.uint64).view(np.int64) for h in zip(*first, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(list(first.values()), pa.int64()), pa.array(list(last.values()), pa.int64())], ["h1", "h2", "first", "last"])

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        h1, h2, first = (rows.column(c).to_numpy() for c in ("h1", "h2", "first"))
        order = np.lexsort((h2, h1))
        yield LineIndex.build(h1[order].view(np.uint64), h2[order].view(np.uint64), np.full(len(h1), 2), first[order]).row(key[0].as_py())

    def ask(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct line hashes of a group, a row for each shard."""
        seen = {k for batch in slices(batches, text_col) for text in batch.column(text_at).to_pylist() for line in (text or "").encode().split(b"\n") if (k := line_key(line, min_chars))}
        if not seen:
            return
        h1, h2 = (np.array(h, np.uint64) for h in zip(*sorted(seen), strict=True))
        shard = (h1 % np.uint64(groups)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        full, at = stretches(shard[order])
        parts = [pa.array([h[order[k]].tobytes() for k in at], pa.binary()) for h in (h1, h2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), key[0].as_py()), pa.int32()), pa.array(full.astype(np.int32)), *parts], ["place", "shard", "h1", "h2"])

    def probe(asked: pa.Table, index: pa.Table) -> pa.Table:
        made: list[list] = [[], [], [], []]
        if index.num_rows:
            shard = LineIndex.from_row(index.to_pylist()[0])
            for group, a, b in zip(asked.column("place").to_pylist(), asked.column("h1"), asked.column("h2"), strict=True):
                h1, h2 = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                count, first = shard.probe(h1, h2)
                gone = count > 1
                if gone.any():
                    for to, x in zip(made, (group, h1[gone].tobytes(), h2[gone].tobytes(), first[gone].tobytes()), strict=True):
                        to.append(x)
        return pa.table({"place": pa.array(made[0], pa.int32()), "h1": pa.array(made[1], pa.binary()), "h2": pa.array(made[2], pa.binary()), "first": pa.array(made[3], pa.binary())})

    def edit(texts: pa.Table, found: pa.Table) -> pa.Table:
        take = lambda name, kind: np.frombuffer(raw_text(found.column(name))[0], kind).tolist()
        first = dict(zip(zip(take("h1", np.uint64), take("h2", np.uint64), strict=True), take("first", np.int64), strict=True)) if found.num_rows else {}
        made = []
        for batch in slices(texts.select(names).to_batches(), text_col):
            out, n_lines, n_dropped, digest = [], [], [], []
            for doc, text in zip(batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True):
                doc = NO_ID if doc is None else doc
                lines = (text or "").encode().split(b"\n")
                left = [x for x in lines if not first or (k := line_key(x, min_chars)) is None or first.get(k, doc) == doc]
                data = b"\n".join(left)
                out.append(data.decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                digest.append(hashlib.sha256(data).hexdigest())
            columns = [*batch.columns[:text_at], pa.array(out, pa.string()), *batch.columns[text_at + 1 :], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())]
            made.append(pa.RecordBatch.from_arrays(columns, [*names, *own]))
        return pa.Table.from_batches(made) if made else texts.select(names).append_column("n_lines", pa.array([], pa.int64())).append_column("n_dropped", pa.array([], pa.int64())).append_column("kept_sha256", pa.array([], pa.string()))

    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(held, "h1 long, h2 long, first long, last long")
    repeated = lines.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last")
    # The same shard as in ask: h1 as an unsigned number modulo the number of shards.
    shard = F.pmod(F.pmod("h1", F.lit(groups)) + F.when(F.col("h1") < 0, pow(2, 64, groups)).otherwise(0), F.lit(groups)).cast("int")
    index = materialise(repeated.withColumn("shard", shard).groupBy("shard").applyInArrow(build, LineIndex.SCHEMA), "line-index")
    texts = dealt.groupBy(place)
    answers = texts.applyInArrow(ask, "place int, shard int, h1 binary, h2 binary").groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, "place int, h1 binary, h2 binary, first binary")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_lines long, n_dropped long, kept_sha256 string"
    return texts.cogroup(answers.groupBy("place")).applyInArrow(edit, fields)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
