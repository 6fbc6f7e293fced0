"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import clean, crc_mod, raw_text, slices, table

FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "newline", "stop", "symbol", "wide", "entropy", "top_symbol",
    "log_words", "word_bytes", "distinct", "top_word", "repeat_next", "capitals", "symbol_end", "bars", "log_lines", "line_bytes", "line_stops",
)
THRESHOLD = 0.3
#: At most so many labelled rows are learnt from: those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000


def _class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1
    return mask


LETTERS = bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t", b"\n", b".,;:'-?", bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:'-?"), bytes(range(128, 256))
CLASSES = np.stack([_class(x) for x in LETTERS], 1)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text, from all of its bytes, words and lines; an empty text gives zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        n = len(text)
        if not n:
            continue
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        p = counts[counts > 0] / n
        words, lines = text.split(), text.split(b"\n")
        w = len(words)
        row = [np.log1p(n), *(counts @ CLASSES / n), float(-(p * np.log2(p)).sum()), (counts * CLASSES[:, 6]).max() / n, np.log1p(w)]
        if w:
            ends = bytes([x[-1] for x in words])
            plain = sum(ends.count(c) for c in (46, 44, 59, 58, 63, 33))
            letters = sum(map(bytes.isalpha, words))
            seen: dict[bytes, int] = {}
            for x in words:
                seen[x] = seen.get(x, 0) + 1
            row += [sum(map(len, words)) / w, len(seen) / w, max(seen.values()) / w, sum(map(eq, words, words[1:])) / w, sum(map(bytes.isupper, words)) / w, (w - letters - plain) / w, seen.get(b"|", 0) / w]
        else:
            row += [0.0] * 7
        row += [np.log1p(len(lines)), n / len(lines), sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines)]
        out[k] = row
    return out


@dataclass
class AdditiveModel:
    """Per-feature edges and lookup tables, and tables of some pairs of features; a score is the logistic of the sum of looked-up values."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edge, lut) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += lut[np.searchsorted(edge, x[:, j], "right")]
        for i, j, ei, ej, lut in self.pairs:
            total += lut[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins: greedy splits by gain; the Newton step of its leaf for each bin."""
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(hess)))
    cuts = [0, len(grad)]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        m = np.arange(a + 1, b)
        gl, hl, gr, hr = g[m] - g[a], h[m] - h[a], g[b] - g[m], h[b] - h[m]
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
        gain[(hl < least) | (hr < least)] = 0
        k = int(gain.argmax())
        return float(gain[k]), int(m[k])

    while len(cuts) <= leaves:
        gain, cut = max((best(a, b) for a, b in zip(cuts, cuts[1:])), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, cut])
    step = np.empty(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, bins: int = 64, pair_bins: int = 8, n_pairs: int = 6, leaves: int = 3, rate: float = 0.1, least: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets a small step on the logistic loss, then the strongest pairs on what is left.

    With no rows the model scores every text 0.5; with one class, near that class.
    """
    n, m = x.shape
    if not n:
        return AdditiveModel([np.zeros(0)] * m, [np.zeros(1)] * m, [], 0.0)
    edges = [_edges(x[:, j], bins) for j in range(m)]
    binned = [np.searchsorted(edges[j], x[:, j], "right") for j in range(m)]
    rate0 = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate0 / (1 - rate0)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, base)
    for _ in range(rounds):
        for j in range(m):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[j])
            step = rate * _tree(np.bincount(binned[j], y - p, size), np.bincount(binned[j], p * (1 - p), size), leaves, least)
            tables[j] += step
            total += step[binned[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(m)]
    small = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(m)]
    p = 1 / (1 + np.exp(-total))
    strength = []
    for i in range(m):
        for j in range(i + 1, m):
            wide = len(coarse[j]) + 1
            cell, size = small[i] * wide + small[j], (len(coarse[i]) + 1) * wide
            g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
            strength.append((float((g**2 / (h + 1)).sum()), i, j))
    pairs = []
    for _, i, j in sorted(strength, reverse=True)[:n_pairs]:
        pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
    for _ in range(pair_rounds):
        for i, j, _, _, lut in pairs:
            p = 1 / (1 + np.exp(-total))
            cell = small[i] * lut.shape[1] + small[j]
            g, h = np.bincount(cell, y - p, lut.size), np.bincount(cell, p * (1 - p), lut.size)
            step = rate * g / (h + 1)
            lut += step.reshape(lut.shape)
            total += step[cell]
    return AdditiveModel(edges, tables, pairs, base)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Learns from at most `rows` labelled documents outside the held-out fifth; null labels and ids are passed over.

    The sample is bounded, so it may be broadcast, and its feature rows may come to the driver.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod(5) != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
    )
    used = clean(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")
    n = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(2)], ["x", "y"])

    got = used.mapInArrow(run, "x array<double>, y double").toPandas()
    if not len(got):
        return fit(np.zeros((0, n)), np.zeros(0))
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))  # the same model whatever order the rows come in
    return fit(x[order], y[order])


def _bytes(column: pa.Array) -> list[bytes]:
    raw, offsets = raw_text(column)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Every row of docs with score (0 to 1) and predicted (1 from the threshold on), which replace columns of those names.

    A null text counts as empty and gets the score of a text without words; an empty table gives no rows.
    """
    rows = docs.drop(*[c for c in docs.columns if c in ("score", "predicted")])
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            s = model.score(features(_bytes(batch.column(at))))
            made = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(clean(docs).withColumn("held_out", crc_mod(5) == 0), model)
    return scored.select("doc_id", "held_out", "score", "predicted")
