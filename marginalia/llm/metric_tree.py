"""Exact top-k inner products by best-first search in M-trees.

An inner product ranks as a distance does once a coordinate is added: with M the largest norm, candidates get
sqrt(M ** 2 - |x| ** 2) and queries 0, and the squared distance is |q| ** 2 + M ** 2 - 2 q.x. A directory of pivots is the
tree's upper level: vectors go to their nearest pivot, which has a covering radius, and many vectors of one pivot are
dealt over several pages. A page's task builds the tree below: nodes of a routing vector, a covering radius and the
distance to the parent. Queries visit first the page nearest to them; the score of their k-th find then bounds which
other pages they must visit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialise, raw_text, table

K = 20
EVERY = 20
SCALE = 64
PAGE_ROWS = 16_384
#: The directory has at most so many pivots, whatever the number of vectors; it is fitted on SAMPLE vectors for each.
MAX_PIVOTS, SAMPLE = 4096, 8
LEAF_ROWS, FAN_OUT = 256, 12
#: Sums of products stay exact in a double below this.
EXACT = float(1 << 53)
FOUND = "query_id long, vec_id long, score long"


def quantise(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v: floor(64 * x) for each component; without null vectors or ones with null or non-finite components."""
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)) & (F.size(vector_col) > 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v")
    )


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: np.dtype | None = None) -> np.ndarray:
    """The vectors of a column as rows of doubles: lists, or with a kind bytes of such integers."""
    if kind is not None:
        return np.frombuffer(raw_text(column)[0], kind).astype(np.float64).reshape(-1, dim)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))


def distances(q: np.ndarray, ql: np.ndarray, x: np.ndarray, xl: np.ndarray) -> np.ndarray:
    """Between the rows of q and x, whose added coordinates are ql and xl."""
    square = ((q * q).sum(axis=1) + ql * ql)[:, None] + ((x * x).sum(axis=1) + xl * xl)[None] - 2 * (q @ x.T + np.outer(ql, xl))
    return np.sqrt(np.maximum(square, 0))


def centres(v: np.ndarray, vl: np.ndarray, k: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """k pivots of a sample: each farthest from those before, then moved to the mean of the vectors nearest to them."""
    picks, near = [0], distances(v, vl, v[:1], vl[:1])[:, 0]
    while len(picks) < min(k, len(v)):
        picks.append(int(near.argmax()))
        near = np.minimum(near, distances(v, vl, v[picks[-1:]], vl[picks[-1:]])[:, 0])
    pv, pl = v[picks].copy(), vl[picks].copy()
    for _ in range(rounds):
        owner = np.concatenate([distances(v[i : i + 1024], vl[i : i + 1024], pv, pl).argmin(axis=1) for i in range(0, len(v), 1024)])
        order = np.argsort(owner, kind="stable")
        held, first = np.unique(owner[order], return_index=True)
        n = np.diff(np.append(first, len(v)))
        pv[held], pl[held] = np.add.reduceat(v[order], first) / n[:, None], np.add.reduceat(vl[order], first) / n
    return pv, pl


@dataclass
class Directory:
    """The pivots with their covering radii, and over how many pages the vectors of each are dealt (0: it has none)."""

    pv: np.ndarray
    pl: np.ndarray
    radius: np.ndarray
    splits: np.ndarray
    top: float

    def lower(self, q: np.ndarray) -> np.ndarray:
        """Least distances of queries to the vectors of each pivot."""
        slack = 1e-6 * (1 + np.sqrt(self.top))
        low = np.maximum(distances(q, np.zeros(len(q)), self.pv, self.pl) - self.radius - slack, 0)
        low[:, self.splits == 0] = np.inf
        return low

    def nearest(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The page that each query visits first: of the nearest pivot, and one of its pages."""
        low = self.lower(q)
        # Where several pivots can't be excluded at all, the nearest of them is the best guess.
        far = distances(q, np.zeros(len(q)), self.pv, self.pl)
        far[low > low.min(axis=1)[:, None]] = np.inf
        at = far.argmin(axis=1)
        return (at << 32) + ids % self.splits[at]

    def others(self, q: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and pages that may hold a score of the query's bound or more, but for the page that it visited first."""
        may = ((q * q).sum(axis=1)[:, None] + self.top - np.minimum(self.lower(q), 1e150) ** 2) / 2 >= bound[:, None]
        may[:, self.splits == 0] = False
        who, pivot = np.nonzero(may)
        n = self.splits[pivot]
        sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who, page = np.repeat(who, n), (np.repeat(pivot, n) << 32) + sub
        left = page != self.nearest(q, ids)[who]
        return who[left], page[left]


@dataclass
class Node:
    """A routing vector, covering radius and distance to the parent's routing vector; children, or a leaf's rows and their distances to the routing vector."""

    route: int
    radius: float
    to_parent: float
    rows: np.ndarray
    to_route: np.ndarray
    children: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class MTree:
    """The nodes of one page, the root first."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, top: float):
        self.ids, self.v, self.up, self.top = ids, v, lift(v, top), top
        self.nodes: list[Node] = []
        self._build(np.arange(len(ids)), 0, 0.0)
        self.radius, self.to_parent = np.array([n.radius for n in self.nodes]), np.array([n.to_parent for n in self.nodes])

    def _build(self, rows: np.ndarray, route: int, to_parent: float) -> int:
        far = distances(self.v[[route]], self.up[[route]], self.v[rows], self.up[rows])[0]
        node, number = Node(route, float(far.max(initial=0.0)), to_parent, rows, far), len(self.nodes)
        self.nodes.append(node)
        if len(rows) <= LEAF_ROWS:
            return number
        # Routing vectors spread over the rows: each farthest from those before.
        picks, near = [int(rows[far.argmax()])], None
        for _ in range(FAN_OUT - 1):
            d = distances(self.v[picks[-1:]], self.up[picks[-1:]], self.v[rows], self.up[rows])[0]
            near = d if near is None else np.minimum(near, d)
            if near.max() <= 1e-6 * (1 + np.sqrt(self.top)):
                break
            picks.append(int(rows[near.argmax()]))
        if len(picks) == 1:  # equal vectors: any split does
            parts = [(rows[i : i + LEAF_ROWS], int(rows[i])) for i in range(0, len(rows), LEAF_ROWS)]
        else:
            owner = distances(self.v[rows], self.up[rows], self.v[picks], self.up[picks]).argmin(axis=1)
            parts = [(rows[owner == k], p) for k, p in enumerate(picks) if (owner == k).any()]
        if len(parts) == 1:  # rounding keeps near-equal vectors together
            parts = [(rows[i : i + LEAF_ROWS], int(rows[i])) for i in range(0, len(rows), LEAF_ROWS)]
        back = distances(self.v[[route]], self.up[[route]], self.v[[p for _, p in parts]], self.up[[p for _, p in parts]])[0]
        node.children = np.array([self._build(part, p, float(back[k])) for k, (part, p) in enumerate(parts)])
        node.rows = node.to_route = rows[:0]
        return number

    def search(self, qids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Up to k best rows for each query that reach its bound (a score, or -inf): query positions, row ids and scores.

        Best-first over the nodes, all queries at once: in each round every query opens the pending node with its
        least lower bound, and is done once that can't reach its k-th score. A child becomes pending with a bound from
        its parent's distance and the stored one, without a distance of its own; that is taken when it is opened.
        """
        none, square = np.zeros(len(q)), (q * q).sum(axis=1)
        slack = 1e-6 * (1 + np.sqrt(self.top) + np.sqrt(square.max(initial=0)))
        pending = np.full((len(q), len(self.nodes)), np.inf)
        pending[:, 0] = 0
        score, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        worst = bound.astype(np.float64)

        def reach(who: np.ndarray, low: np.ndarray) -> np.ndarray:
            """The greatest score at a distance of low or more."""
            return (square[who].reshape(-1, *[1] * (low.ndim - 1)) + self.top - np.maximum(low - slack, 0) ** 2) / 2

        live = np.arange(len(q))
        while len(live):
            at = pending[live].argmin(axis=1)
            low = pending[live, at]
            go = low < np.inf
            live, at, low = live[go], at[go], low[go]
            go = reach(live, low) >= worst[live]
            live, at, low = live[go], at[go], low[go]
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                who, number = live[part], int(at[part[0]])
                node = self.nodes[number]
                pending[who, number] = np.inf
                d = distances(q[who], none[who], self.v[[node.route]], self.up[[node.route]])[:, 0]
                least = np.maximum(low[part], d - node.radius)
                go = reach(who, least) >= worst[who]
                who, d, least = who[go], d[go], least[go]
                if not len(who):
                    continue
                if len(node.children):
                    below = np.abs(d[:, None] - self.to_parent[node.children]) - self.radius[node.children]
                    pending[who[:, None], node.children] = np.maximum(least[:, None], below)
                    continue
                near = (reach(who, np.abs(d[:, None] - node.to_route)) >= worst[who, None]).any(axis=0)
                rows = node.rows[near]
                s = q[who] @ self.v[rows].T
                s[self.ids[rows][None] == qids[who][:, None]] = -np.inf
                both = np.concatenate((score[who], s), axis=1)
                name = np.concatenate((ids[who], np.broadcast_to(self.ids[rows], s.shape)), axis=1)
                name = np.where(both == -np.inf, np.iinfo(np.int64).max, name)
                best = np.lexsort((name, -both), axis=1)[:, :k]
                score[who], ids[who] = np.take_along_axis(both, best, 1), np.take_along_axis(name, best, 1)
                worst[who] = np.maximum(bound[who], score[who, -1])
        hit = (score > -np.inf) & (score >= bound[:, None])
        return np.nonzero(hit)[0], ids[hit], score[hit]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k highest inner products with other rows; equal scores by smaller vec_id.

    Both inputs have vec_id and v, as quantise() gives them. Every row is indexed. Rows whose length isn't the most
    common one take no part, nor do rows that share the query's id; a repeated query counts once, a repeated candidate
    as often as it occurs. Empty inputs give no rows. Sums beyond 2 ** 53 are refused.

    Vectors travel as integers of the least width. Where the distances tell vectors apart, most pages are passed over;
    in data without such structure (independent components) no bound helps and every query visits every page.
    """
    spark = vectors.sparkSession
    dims = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = dims["d"]
    rows = vectors.where(F.size("v") == dim)
    asked = queries.where(F.size("v") == dim).dropDuplicates(["vec_id"])
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, top, high = rows.agg(F.count("*"), F.max(norm), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if dim * high * high >= EXACT:
        raise ValueError("components are too large for exact sums")
    kind = next(np.dtype(t) for t in (np.int8, np.int16, np.int32, np.int64) if high <= np.iinfo(t).max)
    k_pivots = min(MAX_PIVOTS, max(1, n // PAGE_ROWS))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * k_pivots).toArrow()
    sv = matrix(sample.column("v"), dim)
    pv, pl = centres(sv, lift(sv, top), k_pivots)

    def codes(v: np.ndarray) -> pa.Array:
        data = np.ascontiguousarray(v.astype(kind))
        offsets = np.arange(len(v) + 1, dtype=np.int32) * (dim * kind.itemsize)
        return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                v = matrix(part.column(1), dim)
                d = distances(v, lift(v, top), pv, pl)
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), codes(v), pa.array(best), pa.array(d[np.arange(len(v)), best])], ["vec_id", "v", "pivot", "far"])

    placed = materialise(rows.mapInArrow(place, "vec_id long, v binary, pivot long, far double"), "placed")
    info = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # at most MAX_PIVOTS rows
    directory = Directory(pv, pl, np.zeros(len(pv)), np.zeros(len(pv), np.int64), top)
    for r in info:
        directory.radius[r["pivot"]], directory.splits[r["pivot"]] = r["radius"], -(-r["n"] // PAGE_ROWS)
    shared = spark.sparkContext.broadcast(directory)
    splits = F.broadcast(spark.createDataFrame([(r["pivot"], -(-r["n"] // PAGE_ROWS)) for r in info], "pivot long, splits long"))
    paged = placed.join(splits, "pivot").select((F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), "splits")).alias("page"), "vec_id", "v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                v = matrix(part.column(1), dim)
                page = shared.value.nearest(v, part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), codes(v), pa.array(page), pa.array(np.full(len(v), -np.inf))], ["vec_id", "v", "page", "bound"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                v = matrix(part.column(1), dim)
                bound = part.column(2).to_numpy(zero_copy_only=False)
                who, page = shared.value.others(v, part.column(0).to_numpy(), bound)
                for j in range(0, len(who), 8192):
                    w, p = who[j : j + 8192], page[j : j + 8192]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(w)), codes(v[w]), pa.array(p), pa.array(bound[w])], ["vec_id", "v", "page", "bound"])

    def search(held: pa.Table, come: pa.Table) -> pa.Table:
        if not held.num_rows or not come.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        order = np.argsort(held.column("vec_id").to_numpy(), kind="stable")
        tree = MTree(held.column("vec_id").to_numpy()[order], matrix(held.column("v"), dim, kind)[order], top)
        who, vec, score = [], [], []
        for batch in come.to_batches(512):
            qid = batch.column(0).to_numpy()
            a, b, c = tree.search(qid, matrix(batch.column(1), dim, kind), batch.column(3).to_numpy(), k)
            who.append(qid[a])
            vec.append(b)
            score.append(c.astype(np.int64))
        return pa.table({"query_id": np.concatenate(who), "vec_id": np.concatenate(vec), "score": np.concatenate(score)})

    held = paged.groupBy("page")
    visit = "vec_id long, v binary, page long, bound double"
    first = materialise(held.cogroup(asked.mapInArrow(nearest, visit).groupBy("page")).applyInArrow(search, FOUND), "found")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bound"))
    going = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    rest = held.cogroup(going.mapInArrow(others, visit).groupBy("page")).applyInArrow(search, FOUND)
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantise(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
