"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures, reported as connected components.

Sets whose sizes fall in one band, or in two bands next to each other, and whose similarity reaches the threshold
differ in at most k features. The hashed feature domain is cut into n1 partitions, so that one of them holds at most
`drop` differences; each partition is cut into n2 parts, and each way to leave out `drop` parts gives a signature.
Similar sets share one. A sketch of each set, its counts in equal ranges of the hashed domain, bounds the difference
of two sets from below and so drops most pairs that share a signature by chance, and no similar pair. Sets that are
joined by what is left, directly or through others, are candidates of one component, and the links between them are
decided on their differences to a reference set: in a task, or dealt over many if the component is large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import SLICE_BYTES, by_key, clean, deals, materialise, mix, ragged, raw_text, slices, stretches, table
from marginalia.llm.graph import components
from marginalia.llm.hashing import shingle_sets

EMPTY_ID = 0
#: Shingles of a candidate component that is decided in one task.
WHOLE = 1 << 16
#: Sets that are compared with as many others in a task.
BLOCK = 1024


class Scheme:
    """Bands, numbers of partitions and signatures for the similarity num / den."""

    def __init__(self, num: int, den: int, parts: int = 3, drop: int = 1):
        self.num, self.den, self.parts, self.drop = num, den, parts, drop
        self.low, self.high = [1], [den // num]
        self.chosen = {d: np.array([[c not in out for c in range(self.n2(d))] for out in combinations(range(self.n2(d)), d)]).T for d in range(drop + 1)}

    def n2(self, drop: int) -> int:
        return self.parts if drop else 1

    def band(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.den // self.num)
        return int(np.searchsorted(self.high, size))

    def level(self, band: int) -> tuple[int, int]:
        """n1 and drop for pairs of a set in this band with one in it or in the next."""
        self.band(self.high[-1] + 1) if band + 1 >= len(self.high) else None
        k = (self.den - self.num) * (self.high[band] + self.high[band + 1]) // (self.den + self.num)
        drop = min(self.drop, k)
        return k // (drop + 1) + 1, drop

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """features: sorted distinct 64-bit hashes. Signatures as a member of its band and as one of the band above that below."""
        own, out = self.band(len(features)), []
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(features + np.uint64(0x632BE59BD9B4E019)))))
        top = features >> np.uint64(32)
        for band in (own - 1, own) if own else (own,):
            n1, drop = self.level(band)
            n2 = self.n2(drop)
            cell = (top * np.uint64(n1 * n2)) >> np.uint64(32)
            edge = np.searchsorted(cell, np.arange(n1 * n2 + 1, dtype=np.uint64))
            held = (sums[edge[1:]] - sums[edge[:-1]]).reshape(n1, n2)
            kept = np.stack([held[:, way].sum(axis=1, dtype=np.uint64) for way in self.chosen[drop].T], 1)
            place = np.arange(n1 * kept.shape[1], dtype=np.uint64).reshape(kept.shape)
            out.append(mix(mix(kept + place) + np.uint64(band * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)).ravel())
        return np.concatenate(out)


def set_id(features: np.ndarray) -> int:
    """A 63-bit id of a set, from 1 on; EMPTY_ID for the empty set."""
    if not len(features):
        return EMPTY_ID
    total = mix(np.array([mix(features ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64) + np.uint64(len(features))]))[0]
    return max(1, int(total) >> 1)


def sketch(features: np.ndarray) -> bytes:
    """Counts, up to 255, in 2 ** j equal ranges of the hash, about four features to a range."""
    bits = min(14, max(5, (len(features) // 4).bit_length()))
    counts = np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def stack(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one matrix, longer ones folded to the length of the shortest."""
    least = min(map(len, sketches))
    return np.stack([np.frombuffer(x, np.uint8).reshape(least, -1).sum(axis=1, dtype=np.int32) for x in sketches])


def may_link(rows: np.ndarray, size: np.ndarray, one: np.ndarray, one_size: int, num: int, den: int, full: bool) -> np.ndarray:
    """Which of the sketched sets may be similar to one: their counts differ by no more than similar sets may. full: no count was cut at 255."""
    if not full:
        rows, one = np.minimum(rows, 255), np.minimum(one, 255)
    apart = np.maximum(np.abs(rows - one).sum(axis=1), np.abs(size - one_size))
    return (den + num) * apart <= (den - num) * (size + one_size)


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


class Bound:
    """Links told from differences to a reference set R: with D(x) the features that are in one of x and R alone,
    x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| features, whatever R is.

    weight(x) = (den + num) |D(x)| - (den - num) |x|. x and y are linked exactly when twice (den + num) times
    |D(x) & D(y)| reaches weight(x) + weight(y); so always if that sum isn't positive.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.twice = num, den, 2 * (den + num)

    def weight(self, apart, size):
        return (self.den + self.num) * apart - (self.den - self.num) * size

    def overlapping(self, x: Deviations, y: Deviations, forest: Forest, x_at: np.ndarray, y_at: np.ndarray, bin_rows: int = 256) -> Iterator[tuple[int, int]]:
        """Links between rows of x and of y that join what was apart in the forest, whose places are x_at and y_at."""
        codes = np.unique(y.features)
        place = np.searchsorted(codes, y.features)
        order = np.argsort(place, kind="stable")
        owners = np.repeat(np.arange(len(y.size)), np.diff(y.edges))[order]
        first = np.searchsorted(place[order], np.arange(len(codes) + 1))
        width = len(y.size)
        for i in range(0, len(x.size), bin_rows):
            j = min(i + bin_rows, len(x.size))
            mine = x.features[x.edges[i] : x.edges[j]]
            row = np.repeat(np.arange(j - i), np.diff(x.edges[i : j + 1]))
            at = np.minimum(np.searchsorted(codes, mine), max(0, len(codes) - 1))
            if not len(codes) or not len(mine):
                continue
            known = codes[at] == mine
            at, row = at[known], row[known]
            n = first[at + 1] - first[at]
            cell = np.repeat(row * width, n) + owners[ragged(first[at], n)]
            both = np.bincount(cell, minlength=(j - i) * width).reshape(j - i, width)
            hit = (self.twice * both >= x.weight[i:j, None] + y.weight[None]) & (both > 0)
            top = forest.roots()[y_at]
            for a in np.flatnonzero(hit.any(axis=1)).tolist():
                found = np.flatnonzero(hit[a])
                for b in found[np.unique(top[found], return_index=True)[1]].tolist():  # one link for each of y's groups will do
                    if forest.join(int(x_at[i + a]), int(y_at[b])):
                        yield i + a, b


class Deviations:
    """Rows of sorted features (edges: where each row begins), with the set's size and weight."""

    def __init__(self, features: np.ndarray, edges: np.ndarray, size: np.ndarray, weight: np.ndarray):
        self.features, self.edges, self.size, self.weight = features, edges, size, weight

    def take(self, rows: np.ndarray) -> Deviations:
        n = np.diff(self.edges)[rows]
        return Deviations(self.features[ragged(self.edges[rows], n)], np.concatenate(([0], np.cumsum(n))), self.size[rows], self.weight[rows])


def majority(features: np.ndarray, n: int) -> np.ndarray:
    """The features that more than half of n sets hold."""
    values, count = np.unique(features, return_counts=True)
    return values[2 * count > n]


def deviate(sets: list[np.ndarray], base: np.ndarray, bound: Bound) -> Deviations:
    rows = [np.setxor1d(s, base, assume_unique=True) for s in sets]
    n = np.array([len(r) for r in rows], np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    return Deviations(np.concatenate(rows) if rows else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(n))), size, bound.weight(n, size))


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the smallest index of a set it is linked with, directly or through others. Exact.

    One pass joins all sets that the differences to the majority tell to be linked with the nearest set. What is left
    needs common differences with a partner; differences of one set alone drop out, then the sets whose differences
    can't suffice, and those that remain are counted against each other by an index of the differences.
    """
    bound, forest = Bound(num, den), Forest(len(sets))
    base = majority(np.concatenate(sets), len(sets))
    all_rows = deviate(sets, base, bound)
    best = int(all_rows.weight.argmin())
    for j in np.flatnonzero(all_rows.weight + all_rows.weight[best] <= 0).tolist():
        forest.join(best, j)
    core = all_rows.weight + all_rows.weight[best] <= 0
    core[best] = True
    values, code, count = np.unique(all_rows.features, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner = np.repeat(np.arange(len(sets)), np.diff(all_rows.edges))[shared]
    held = np.bincount(owner, minlength=len(sets))
    rows = Deviations(code[shared], np.concatenate(([0], np.cumsum(held))), all_rows.size, all_rows.weight)
    room = bound.twice * held - rows.weight  # a partner's weight may be so high
    open_rows = np.flatnonzero(~core & (held > 0) & (rows.weight <= room.max(initial=0)) & (rows.weight[best] <= room))
    if not len(open_rows):
        return forest.roots()
    others = np.flatnonzero((held > 0) & (room >= rows.weight[open_rows].min()) & (rows.weight <= room[open_rows].max()))
    for i in range(0, len(others), 2048):
        part = others[i : i + 2048]
        for _ in bound.overlapping(rows.take(open_rows), rows.take(part), forest, open_rows, part):
            pass
    return forest.roots()


def candidates(docs: DataFrame, base: DataFrame, words: int, num: int, den: int, scheme: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (set_id, row, sketch, n_shingles), and set_id and root of those that signatures and sketches join.

    Similar sets always have one root; sets that aren't similar may have one too.
    """
    spark = docs.sparkSession
    parts, drop = scheme
    total, count = base.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    plan = Scheme(num, den, parts, drop)
    n1, left_out = plan.level(plan.band(300))
    shards = deals(spark, 12 * (2 * n1 * plan.chosen[left_out].shape[1] / 300 * total + 8 * count))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Scheme(num, den, parts, drop)
        for batch in slices(batches):
            sigs, ids, seen = [], [], set()
            for s in shingle_sets(*raw_text(batch.column(1)), words):
                if len(s) and (k := set_id(s)) not in seen:
                    seen.add(k)
                    sigs.append(plan.signatures(s))
                    ids.append(np.full(len(sigs[-1]), k, np.int64))
            if not sigs:
                continue
            sig, ident = np.concatenate(sigs), np.concatenate(ids)
            shard = (sig >> np.uint64(32)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            full, at = stretches(shard[order])
            low, ident = sig[order].astype(np.uint32), ident[order]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[k].tobytes() for k in at], pa.binary()), pa.array([ident[k].tobytes() for k in at], pa.binary())], ["shard", "sigs", "ids"])

    def meet(blobs: pa.Table) -> pa.Table:
        """The first member of each signature with each other one, and the members of signatures of three and more."""
        sig = np.frombuffer(raw_text(blobs.column("sigs"))[0], np.uint32)
        ident = np.frombuffer(raw_text(blobs.column("ids"))[0], np.int64)
        order = np.lexsort((ident, sig))
        sig, ident = sig[order], ident[order]
        once = np.concatenate(([True], (np.diff(sig) != 0) | (np.diff(ident) != 0)))
        sig, ident = sig[once], ident[once]
        start = np.flatnonzero(np.concatenate(([True], np.diff(sig) != 0)))
        length = np.diff(np.append(start, len(sig)))
        start, length = start[length > 1], length[length > 1]
        head = np.repeat(ident[start], length - 1)
        pair = np.unique(np.stack((head, ident[ragged(start + 1, length - 1)]), 1), axis=0)
        start, length = start[length > 2], length[length > 2]
        member = ident[ragged(start, length)]
        edge = np.cumsum(length) - length
        name = mix(np.add.reduceat(mix(member.view(np.uint64)), edge)) if len(edge) else np.zeros(0, np.uint64)
        name, one = np.unique(name, return_index=True)  # the same members under several signatures count once
        at = ragged(edge[one], length[one])
        n = len(at)
        return pa.table({"a": np.concatenate((pair[:, 0], np.zeros(n, np.int64))), "b": np.concatenate((pair[:, 1], member[at])), "group": pa.array(np.concatenate((np.zeros(len(pair), np.int64), np.repeat(name, length[one]).view(np.int64))), mask=np.arange(len(pair) + n) < len(pair))})

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n, y, m = (c.to_pylist() for c in batch.columns[2:])
            keep = [bool(may_link(s[:1], np.array([q]), s[1], r, num, den, max(q, r) < 255)[0]) for s, q, r in ((stack([u, v]), q, r) for u, v, q, r in zip(x, y, n, m, strict=True))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of different roots in a cell that may be similar, until they are joined; within a block only in the block's own cell."""
        for table in by_key(batches, "cell", SLICE_BYTES):
            cell, top, size, block = (table.column(c).to_numpy() for c in ("cell", "root", "n_shingles", "block"))
            sketches, edge = table.column("sketch").to_pylist(), np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            pairs = []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                at, names = np.unique(top[i:j], return_inverse=True)[::-1], top[i:j]
                if names[0] == names[-1] and (names == names[0]).all():
                    continue
                rows, n, here, full = stack(sketches[i:j]), size[i:j], block[i:j], int(size[i:j].max()) < 255
                other = (here != here[0]).any()
                forest, group = Forest(int(at[0].max()) + 1), at[0]
                for k in range(1, j - i):
                    may = may_link(rows[:k], n[:k], rows[k], int(n[k]), num, den, full) & (group[:k] != group[k])
                    if other:
                        may &= here[:k] != here[k]
                    for x in np.flatnonzero(may).tolist():
                        if forest.join(int(group[k]), int(group[x])):
                            pairs.append((int(names[k]), int(names[x])))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    shared = materialise(docs.mapInArrow(sign, "shard int, sigs binary, ids binary").groupBy("shard").applyInArrow(meet, "a long, b long, group long"), "shared")
    known = base.where(F.col("set_id") != EMPTY_ID).groupBy("set_id").agg(F.min("row").alias("row"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    known = materialise(known, "known")
    left, right = known.select(F.col("set_id").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n")), known.select(F.col("set_id").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("m"))
    edges = shared.where("group is null").select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "x", "n", "y", "m").mapInArrow(close, "a long, b long")
    once = components(edges).select(F.col("node").alias("set_id"), "root")

    # A group's sets that aren't in one component yet are compared with each other, a block with a block in each cell.
    spread = shared.where("group is not null").select("group", F.col("b").alias("set_id")).distinct().join(once, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    spread = materialise(spread, "spread")
    open_groups = spread.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low <> high").select("group", "blocks")
    block = F.pmod(F.xxhash64("set_id"), "blocks")
    cells = spread.join(open_groups, "group").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("set_id", "root", "block", F.xxhash64("group", F.least("block", "with"), F.greatest("block", "with")).alias("cell"))
    more = cells.join(known.select("set_id", "sketch", "n_shingles"), "set_id").repartition("cell").sortWithinPartitions("cell").mapInArrow(across, "a long, b long").distinct()
    near = components(once.select(F.col("set_id").alias("a"), F.col("root").alias("b")).unionByName(more)).select(F.col("node").alias("set_id"), "root")
    return known, near


def links_within(feats: DataFrame, num: int, den: int, whole: int) -> DataFrame:
    """a and b: links that connect the similar sets of candidate components that are too large for one task.

    feats: set_id, root, total (shingles of the component), features. Rows are dealt by a salt beside the root, and what
    all of a component's sets need (reference, nearest set, limits) is sent once for each salt. The reference is the
    majority of a sample of about `whole` shingles; links are exact whatever it is (see Bound).
    """
    bound = Bound(num, den)

    def reference(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [b.column("features") for b in batches]
        base = majority(np.concatenate([x.flatten().to_numpy() for x in lists]), sum(map(len, lists)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([base.tolist()], pa.list_(pa.int64()))], ["root", "base"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "cell", SLICE_BYTES):
            cell = table.column("cell").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = table.slice(i, j - i).combine_chunks()
                ids, names = np.unique(part.column("set_id").to_numpy(), return_inverse=True)
                lists, weight = part.column("shared").combine_chunks(), part.column("weight").to_numpy()
                edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
                rows = Deviations(lists.flatten().to_numpy(), edges, np.zeros(len(weight)), weight)
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
                pairs = [(ids[names[x[a]]], ids[names[y[b]]]) for a, b in bound.overlapping(rows.take(x), rows.take(y), Forest(len(ids)), names[x], names[y])]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in pairs], pa.int64()), pa.array([int(b) for _, b in pairs], pa.int64())], ["a", "b"])

    salts = F.ceil(F.col("total") / whole)
    salted = feats.withColumn("salt", F.pmod(F.xxhash64("set_id", F.lit(1)), salts))
    sizes = feats.groupBy("root").agg(F.first("total").alias("total"))

    def sent(few: DataFrame) -> DataFrame:
        """A row for each root, copied for each of its salts."""
        return few.join(sizes, "root").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("total")

    sample = feats.where(F.pmod(F.xxhash64("set_id", F.lit(2)), F.lit(1 << 20)) * F.col("total") < F.lit(whole << 20))
    base = sample.groupBy("root").applyInArrow(reference, "root long, base array<long>")
    dev = salted.join(sent(base), ["root", "salt"], "left").withColumn("base", F.coalesce("base", F.array().cast("array<long>")))
    dev = dev.withColumn("apart", F.concat(F.array_except("features", "base"), F.array_except("base", "features")))
    dev = materialise(dev.select("set_id", "root", "salt", "apart", bound.weight(F.size("apart"), F.size("features")).cast("long").alias("weight")), "apart")
    best = dev.groupBy("root").agg(F.min(F.struct("weight", "set_id")).alias("best"))
    dev = dev.join(sent(best), ["root", "salt"])
    core = F.col("weight") + F.col("best.weight") <= 0

    # Differences that one set alone has drop out; a set must have enough of the others.
    each = dev.select("root", "set_id", F.explode("apart").alias("f"))
    common = each.groupBy("root", "f").agg(F.count("*").alias("n")).where("n > 1").select("root", "f")
    held = each.join(common, ["root", "f"]).groupBy("set_id").agg(F.collect_set("f").alias("shared"))
    rest = dev.select("set_id", "root", "salt", "weight", "best", core.alias("core")).join(held, "set_id")
    rest = materialise(rest.withColumn("room", F.size("shared") * bound.twice - F.col("weight")).where(F.col("best.weight") <= F.col("room")), "shared")
    limit = rest.groupBy("root").agg(F.max("room").alias("most"))
    asking = rest.where("not core").join(sent(limit), ["root", "salt"]).where("weight <= most").drop("most")
    asking = materialise(asking, "asking")
    limits = asking.groupBy("root").agg(F.min("weight").alias("low"), F.max("room").alias("high"), F.ceil(F.count("*") / BLOCK).alias("x_blocks"))
    asked = rest.join(sent(limits), ["root", "salt"]).where("room >= low and weight <= high")
    blocks = asked.groupBy("root").agg(F.first("x_blocks").alias("x_blocks"), F.ceil(F.count("*") / BLOCK).alias("y_blocks"))

    def dealt(rows: DataFrame, asks: bool) -> DataFrame:
        mine, other = ("x_blocks", "y_blocks") if asks else ("y_blocks", "x_blocks")
        rows = rows.select("set_id", "root", "salt", "shared", "weight").join(sent(blocks), ["root", "salt"])
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("set_id", F.lit(3)), mine)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return rows.select("set_id", "weight", "shared", F.lit(asks).alias("asks"), F.xxhash64("root", "mine" if asks else "other", "other" if asks else "mine").alias("cell"))

    cells = dealt(asking, True).unionByName(dealt(asked, False))
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(counted, "a long, b long")
    return dev.where(core).select(F.col("set_id").alias("a"), F.col("best.set_id").alias("b")).unionByName(found)


def cluster(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, scheme: tuple[int, int] = (3, 1), whole: int = WHOLE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (see classes)."""
    return classes(docs, words, num, den, scheme, whole).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, scheme: tuple[int, int] = (3, 1), whole: int = WHOLE) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key (xxhash64 of the text) and leads for every row of docs: whether it is the first of its component by id and text key. A row without words or id leads too.

    Two documents are linked when den * |A & B| >= num * |A | B| for their sets of `words`-word shingles; a
    component's id is its smallest doc_id. A text without words, or null, has no shingles and is linked with nothing:
    its component_id is its own doc_id. Equal texts are linked, also when they are repeated rows; a null doc_id counts
    for no minimum, and is the id only of a component that has no other. An empty table gives no rows. Only doc_id and text are read.

    Candidate components of up to `whole` shingles are decided in a task, several together; the sets of larger ones
    are dealt over tasks (links_within).
    """
    # A row's key is its id, or without one a hash of its text; rows that share a key are told apart by their sets.
    rows = clean(docs).withColumn("text_key", F.xxhash64("text")).withColumn("row", F.coalesce("doc_id", "text_key"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*raw_text(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "n_shingles", "set_id", "sketch", "text_key", "row"])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """set_id, root, total and the set's features, of the rows that have the wanted set."""
        for batch in slices(batches):
            sets = shingle_sets(*raw_text(batch.column(batch.schema.get_field_index("text"))), words)
            ids = batch.column(batch.schema.get_field_index("set_id"))
            keep = pa.array([set_id(s) == want for s, want in zip(sets, ids.to_pylist(), strict=True)], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("set_id", "root", "total")), lists], ["set_id", "root", "total", "features"]).filter(keep)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "root", SLICE_BYTES):
            lists = table.column("features").combine_chunks()
            edge, flat = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))), lists.flatten().to_numpy().view(np.uint64)
            groups: dict[int, dict[int, np.ndarray]] = {}
            for k, (ident, root) in enumerate(zip(table.column("set_id").to_pylist(), table.column("root").to_pylist(), strict=True)):
                groups.setdefault(root, {})[ident] = flat[edge[k] : edge[k + 1]]
            node, top = [], []
            for members in groups.values():
                ids = sorted(members)
                node += ids
                top += [ids[k] for k in linked([members[k] for k in ids], num, den)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(top, pa.int64())], ["set_id", "top"])

    base = materialise(rows.mapInArrow(describe, "doc_id long, n_shingles long, set_id long, sketch binary, text_key long, row long"), "sets")
    known, near = candidates(rows, base, words, num, den, scheme)
    picked = known.select("set_id", "row", "n_shingles").join(near, "set_id")
    total = picked.groupBy("root").agg(F.sum("n_shingles").alias("total"))
    picked = materialise(picked.select("set_id", "row", "root").join(total, "root"), "picked")
    # Always a shuffle: which rows are picked grows with the corpus.
    texts = rows.select("row", "text").join(picked.hint("merge"), "row")
    feats = materialise(texts.mapInArrow(prepare, "set_id long, root long, total long, features array<long>"), "features")
    small, large = feats.where(F.col("total") <= whole), feats.where(F.col("total") > whole)
    tops = small.select("set_id", "root", "features").repartition("root").sortWithinPartitions("root").mapInArrow(decide, "set_id long, top long")
    if large.limit(1).count():
        tops = tops.unionByName(components(links_within(large, num, den, whole)).select(F.col("node").alias("set_id"), F.col("root").alias("top")))
    placed = base.drop("sketch", "row").join(tops, "set_id", "left").withColumn("top", F.coalesce("top", "set_id"))
    placed = materialise(placed, "placed")
    # Written, so that both sides of the last join come from their shuffles and a large component's rows can be split.
    first = materialise(placed.where(F.col("set_id") != EMPTY_ID).groupBy("top").agg(F.min("doc_id").alias("component_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("lead")), "first")
    leads = F.col("lead").isNull() | F.col("doc_id").isNull() | (F.struct("doc_id", "text_key") == F.col("lead"))
    return placed.join(first, "top", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key", leads.alias("leads"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i+2], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
