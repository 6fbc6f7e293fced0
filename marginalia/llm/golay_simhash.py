"""Near duplicates by fingerprints of four-word shingles, joined on the codewords of a perfect Golay code.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, each a vector of the binary Golay code of length 23.
Every vector has one codeword within distance three. A segment's keys are that codeword and those of its 23 neighbours:
the codeword alone where it is nearer than three, else it and the five codewords at distance four. Two vectors at
distance one or two have a neighbour in common (or are neighbours), so they share a key. Of four differing bits at most
one segment holds three or more, so of two linked fingerprints at least two segments share a key each: the fingerprints
meet in the bucket of these two segments and their two codewords (28 buckets a pair of segments on average), where their
distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import by_key, clean, deals, materialise, mix, ragged, stretches, table
from marginalia.llm.graph import components
from marginalia.llm.hashing import LOWER, word_bounds

#: The generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the cyclic Golay code of length 23.
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = tuple(combinations(range(3), 2))
#: Buckets of more fingerprints are cut into blocks of at most so many.
BLOCK = 1 << 16
#: Buckets are counted on one fingerprint in so many, chosen by hash; a count decides how a bucket is dealt, not what is compared.
SURVEY = 64
#: Up to so many large buckets are broadcast (12 bytes each), and so many frequent fingerprints.
BROADCAST_BUCKETS, FREQUENT = 1 << 20, 1 << 12
#: Larger buckets are searched outwards from one fingerprint, smaller ones pair by pair.
SMALL = 32
SHINGLES = 1 << 16
#: So many fingerprints are compared with so many at once.
FRONT, ACROSS = 256, 1 << 12


def _syndromes(vectors: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: zero for codewords, the same for all vectors of a coset."""
    rest = np.array(vectors, np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest ^= (rest >> bit & 1) * (GENERATOR << bit - CHECK_BITS)
    return rest


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns that lead to its keys, and how many: the leader, and the five of weight four where the leader has weight three."""
    found = np.zeros((1 << CHECK_BITS, 6), np.int64)
    counts = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for e, s in zip(errors.tolist(), _syndromes(errors).tolist()):
            if weight < 4 or found[s, 0].bit_count() == 3:
                found[s, counts[s]] = e
                counts[s] += 1
    return found, counts


PATTERNS, KEYS = _patterns()


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of each vector's key codewords in rows of six, and how many of them count."""
    s = _syndromes(vectors)
    return (vectors[:, None] ^ PATTERNS[s]) >> CHECK_BITS, KEYS[s]


def buckets(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every bucket of every fingerprint: positions in prints, and buckets (two bits for the pair of segments, twelve for each codeword)."""
    parts = [codes((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    rows, names = [], []
    for k, (i, j) in enumerate(PAIRS):
        (a, n), (b, m) = parts[i], parts[j]
        row = np.repeat(np.arange(len(prints)), n * m)
        nth = ragged(np.zeros(len(prints), np.int64), n * m)
        rows.append(row)
        names.append(k << 24 | a[row, nth // m[row]] << 12 | b[row, nth % m[row]])
    return np.concatenate(rows), np.concatenate(names)


def fingerprint(text: bytes, words: int = 4) -> int:
    """Bit b is set if more than half of the shingles' XXH64 (seed 42) have it; a text without words gives 0."""
    raw = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    if not len(starts):
        return 0
    low = raw.tobytes()
    if (starts[1:] != ends[:-1] + 1).any() or (raw[ends[:-1]] != 0x20).any():
        low = b" ".join([low[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        ends = np.cumsum(ends - starts + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
    else:
        low, starts, ends = low[starts[0] : ends[-1]], starts - starts[0], ends - starts[0]
    last = ends[words - 1 :] if len(ends) >= words else ends[-1:]
    first = starts[: len(last)]
    sums, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(last), SHINGLES):
        h = [digest(low[a:b], 42) for a, b in zip(first[k : k + SHINGLES].tolist(), last[k : k + SHINGLES].tolist())]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * sums > len(last)).tolist()))


def _prints(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.encode(), words) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of one fingerprint in SURVEY."""
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        _, names = buckets(prints[mix(prints) % np.uint64(SURVEY) == 0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32())], ["bucket"])


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for k in range(0, len(prints), 1 << 14):
            some = prints[k : k + (1 << 14)]
            row, names = buckets(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(some[row])], ["bucket", "print"])


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def spread(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as two arrays of ends.

    Goes outwards from one fingerprint of each component: those not reached yet are compared with those reached last, a block at a time,
    so that a dense group costs little more than its size; fingerprints without links are compared with all.
    """
    left, ends_a, ends_b = prints, [prints[:0]], [prints[:0]]
    while len(left):
        block = left[:FRONT]
        degree = sum(near(block[:, None], left[None, k : k + ACROSS], bits).sum(1) for k in range(0, len(left), ACROSS))
        linked = block[degree > 1]  # one is the fingerprint itself
        left, todo = np.concatenate((linked, left[FRONT:])), len(linked)
        while todo:
            front, left, todo = left[:1], left[1:], todo - 1
            while len(front):
                some, front = front[:FRONT], front[FRONT:]
                rest, ahead = [left[:0]], 0
                for k in range(0, len(left), ACROSS):
                    part = left[k : k + ACROSS]
                    hit = near(some[:, None], part[None, :], bits)
                    new = hit.any(0)
                    ends_a.append(some[hit[:, new].argmax(0)])
                    ends_b.append(part[new])
                    front = np.concatenate((front, part[new]))
                    rest.append(part[~new])
                    ahead += int(new[: max(0, todo - k)].sum())
                left, todo = np.concatenate(rest), todo - ahead
    return np.concatenate(ends_a), np.concatenate(ends_b)


def _links(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets (or cells) from rows sorted by them; pairs of small ones, forests of large ones."""
    for held in by_key(batches, "name", 1 << 23):
        names, prints = held["name"].to_numpy(), held["print"].to_numpy().view(np.uint64)
        _, cut = stretches(names)
        size = np.array([s.stop - s.start for s in cut])
        ends_a, ends_b = [prints[:0]], [prints[:0]]
        room = np.repeat(np.where(size <= SMALL, size, 0), size)
        place = ragged(np.zeros(len(size), np.int64), size)
        for step in range(1, SMALL):
            i = np.flatnonzero(place + step < room)
            if not len(i):
                break
            i = i[near(prints[i], prints[i + step], bits)]
            ends_a.append(prints[i])
            ends_b.append(prints[i + step])
        for k in np.flatnonzero(size > SMALL).tolist():
            a, b = spread(prints[cut[k]], bits)
            ends_a.append(a)
            ends_b.append(b)
        a, b = np.concatenate(ends_a), np.concatenate(ends_b)
        if len(a):
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            a, b = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(distinct: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column print, long) that connect all pairs at `bits` (at most 4) or fewer differing bits.

    Buckets of more than `block` fingerprints are cut into blocks by hash, and each block meets every other in a cell,
    so that no task holds a whole bucket. The result connects what all links connect; it isn't every link.
    """
    if not 0 <= bits <= 4:
        raise ValueError("segments and keys are made for 4 differing bits at most")
    spark = distinct.sparkSession
    n = distinct.count()
    keyed = distinct.select("print").mapInArrow(_keyed, "bucket int, print long")
    if n > block:
        counts = distinct.select("print").mapInArrow(_survey, "bucket int").groupBy("bucket").agg(F.count("*").alias("n"))
        large = materialise(counts.where(F.col("n") * SURVEY > block).select("bucket", (F.ceil(F.col("n") * SURVEY / block) + 2).cast("int").alias("blocks")), "large")
        keyed = keyed.join(F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large, "bucket", "left")
    else:
        keyed = keyed.withColumn("blocks", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != own), lambda j: F.least(j, own) * F.col("blocks") + F.greatest(j, own) + 1)
    cells = keyed.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(others)))
    named = cells.select((F.shiftleft(F.col("bucket").cast("long"), 32) + F.col("cell")).alias("name"), "print")
    parts = deals(spark, 85 * 28 * n)
    return named.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(lambda batches: _links(batches, bits), "a long, b long")


def cluster(docs: DataFrame, words: int = 4, bits: int = 4, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links, itself included) of every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other. A row with a null id links what
    lies on both sides of it; its component is the smallest id of its group, null if there is none. Repeated rows
    and rows that share an id each give a row; two texts of one id aren't linked by that. Long texts are hashed whole, a stretch of
    shingles at a time; an empty table gives no rows; other columns are passed over.
    """
    prints = materialise(clean(docs, id_col, text_col).mapInArrow(lambda batches: _prints(batches, words), "doc_id long, print long"), "prints")
    distinct = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, bits, block)).select(F.col("node").alias("print"), "root")
    placed = materialise(distinct.join(roots, "print", "left").select("print", "first", "n", F.coalesce("root", "print").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(placed.join(least, "root").select("print", "n", "component_id"), "named")
    # At most FREQUENT fingerprints can have more than total / FREQUENT rows: these are broadcast, so that no task gets all rows of one.
    often = F.col("n") * FREQUENT > prints.count()
    common = F.broadcast(named.where(often).select("print", F.struct("component_id").alias("common")))
    rare = named.where(~often).select("print", F.struct("component_id").alias("rare"))
    seen = prints.join(common, "print", "left")
    text = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    hot = seen.where("common is not null").select("doc_id", text, "common.component_id")
    return hot.unionByName(seen.where("common is null").join(rare, "print").select("doc_id", text, "rare.component_id"))


def op11_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))
