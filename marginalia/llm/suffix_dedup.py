"""Exact removal of repeated byte strings by longest-previous-factor arrays of candidate stretches.

The window starts of a text are cut into runs by the least gram hash of their windows, so equal windows lie in runs of
one hash. Runs that are equal as a whole, by two further hashes, are settled once. The stretches of the others go, once
for each distinct one, to the task of their hash. It sorts the suffixes of its stretches by prefix doubling up to the
window's length; the previous and the next smaller position in suffix order give each start's longest previous factor,
and the greater ones its longest later factor: a window is a copy where these reach the window's length.

A hash with many unlike stretches, as of a line that many texts share, is cut further: by where in a window the gram stands,
in classes of a few offsets, and by the bytes that all windows of a class share. Equal windows still meet, and each part of
a stretch goes to the task of its own class and bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import anchors
from marginalia.llm.common import clean, deals, materialise, ragged, raw_text, slices, stretches, table, text_bytes

WINDOW, GRAM = 200, 48
#: Suffixes are sorted in batches of about so many bytes, cut between hashes.
BATCH_BYTES = 1 << 19
#: A hash with more bytes of unlike stretches is cut into parts, by classes of so many offsets.
SPLIT_BYTES, WIDTH = 2 << 20, 16
REMOVE, SEND, ANSWER, SPLIT = 1, 2, 4, 8
DOUBLE = np.uint32(1 << 31)
RUN = (("h", np.uint32), ("f", np.uint64), ("g", np.uint64), ("key", np.int64), ("doc", np.int64), ("start", np.uint32), ("count", np.uint32))
MARK = (("h", np.uint32), ("key", np.int64), ("start", np.uint32), ("count", np.uint32), ("kind", np.uint8))
STRETCH = (("h", np.uint32), ("key", np.int64), ("doc", np.int64), ("start", np.uint32), ("length", np.uint32), ("kind", np.uint8))
SPAN = (("key", np.int64), ("start", np.uint32), ("end", np.uint32))


def blobs(to: np.ndarray, fields: tuple, columns: list[np.ndarray]) -> pa.Table:
    """One row for each place that gets something: its part of each column as bytes."""
    order = np.argsort(to, kind="stable")
    full, at = stretches(to[order])
    made = {"place": pa.array(full.astype(np.int32))}
    for (name, kind), column in zip(fields, columns, strict=True):
        column = column.astype(kind, copy=False)[order]
        made[name] = pa.array([column[k].tobytes() for k in at], pa.binary())
    return pa.table(made)


def unblob(rows: pa.Table, fields: tuple) -> list[np.ndarray]:
    return [np.frombuffer(raw_text(rows.column(name))[0], kind) if rows.num_rows else np.zeros(0, kind) for name, kind in fields]


def schema(fields: tuple, more: str = "") -> str:
    return ", ".join(["place int", *(f"{name} binary" for name, _ in fields)]) + more


def suffix_order(raw: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the bytes from them, as far as the window goes, ties by position; and the common prefix, at most the window, of each with the one before it in that order."""
    n, pad = len(raw), window + 8
    padded = np.concatenate((raw, np.zeros(pad, np.uint8))).astype(np.uint64)
    known = min(8, window)
    head = np.zeros(n + pad - known + 1, np.uint64)
    for k in range(known):
        head = head << np.uint64(8) | padded[k : k + len(head)]
    levels = [(known, np.unique(head[:n], return_inverse=True)[1].astype(np.uint32))]
    while 2 * known < window:
        rank = levels[-1][1]
        ahead = np.concatenate((rank[known:], np.zeros(min(known, n), np.uint32)))[:n]
        known *= 2
        levels.append((known, np.unique(rank.astype(np.uint64) << np.uint64(32) | ahead, return_inverse=True)[1].astype(np.uint32)))
    rank = levels[-1][1].astype(np.uint64)
    rank = np.unique(rank[starts] << np.uint64(32) | rank[starts + (window - known)], return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")
    common = np.zeros(len(starts), np.int64)
    common[1:] = window
    apart = np.flatnonzero(np.diff(rank[order])) + 1
    i, j = starts[order[apart - 1]], starts[order[apart]]
    length = np.zeros(len(apart), np.int64)
    for size, rank in reversed(levels):
        a, b = i + length, j + length
        length += np.where((a < n) & (b < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]), size, 0)
    differ = head[np.minimum(i + length, len(head) - 1)] ^ head[np.minimum(j + length, len(head) - 1)]
    for k in range(1, levels[0][0]):
        length += differ < np.uint64(1 << 8 * (levels[0][0] - k))
    common[apart] = np.minimum(length, window - 1)
    return order, common


def nearest_smaller(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place of the suffix order its common prefix with the nearest place before it that has a smaller value (0: there is none).

    All places at once: while the place pointed at has a greater value, its own pointer is followed.
    """
    to, length = np.arange(len(values)) - 1, common.copy()
    todo = np.flatnonzero((to >= 0) & (values[to] > values))
    while len(todo):
        via = to[todo]
        length[todo], to[todo] = np.minimum(length[todo], length[via]), to[via]
        todo = todo[(to[todo] >= 0) & (values[to[todo]] > values[todo])]
    length[to < 0] = 0
    return length


def longest_factors(order: np.ndarray, common: np.ndarray, later: bool = False) -> np.ndarray:
    """The longest-previous-factor array over the starts (or the longest later factors): how much of what follows each start also follows one before it, as far as the window goes."""
    values = -order if later else order
    before = nearest_smaller(values, common)
    after = nearest_smaller(values[::-1], np.concatenate(([0], common[:0:-1])))[::-1]
    found = np.zeros(len(order), np.int64)
    found[order] = np.maximum(before, after)
    return found


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal ranges, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate(([True], start[1:] > end[:-1]))
    return start[first], end[np.concatenate((first[1:], [True]))]


def split(raw: np.ndarray, begin: np.ndarray, count: np.ndarray, kind: np.ndarray, order: tuple[np.ndarray, ...], window: int, gram: int, width: int, keep_first: bool) -> tuple[np.ndarray, ...]:
    """The parts of stretches, each of the same bytes sent once: stretch, first window in it, number of windows, hash and kind.

    Parts with the bytes of another are settled here: all but the first in order are copies, and so is the first unless it is to be kept.
    """
    owner, at, number, h, f, g = anchors.parts(raw, begin, count + window - 1, window, gram, width)
    if not len(owner):
        return owner, at, number, h, np.zeros(0, np.uint8)
    rank = np.empty(len(begin), np.int64)
    rank[np.lexsort(order)] = np.arange(len(begin))
    by = np.lexsort((at, rank[owner], g, f, h))
    owner, at, number, h, f, g = (x[by] for x in (owner, at, number, h, f, g))
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (f[1:] != f[:-1]) | (g[1:] != g[:-1])))
    copies = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    copy = (copies > 1) & ~(new & keep_first)
    made = np.where(copy, REMOVE, 0) | np.where(new, SEND, 0) | np.where(new & ~copy, kind[owner] & ANSWER, 0)
    return owner, at, number, h, made.astype(np.uint8)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_first: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary).

    Removes each byte of a `window`-byte string that occurs elsewhere in the corpus, overlapping itself included:
    with keep_first only copies after the first in order of doc_id, else all. Strings are judged on the input. A null
    text is empty; texts shorter than the window are kept whole. Repeated rows are copies of each other: where the
    first is to be kept, so are rows that equal it in doc_id and text. A null doc_id comes first. An empty table
    gives no rows. Only doc_id and text are read. split_bytes changes no rows.
    """
    width = min(WIDTH, max(1, (window - gram) // 4))
    groups = deals(docs.sparkSession, text_bytes(docs))
    rows = clean(docs).withColumn("key", F.xxhash64("doc_id", "text")).withColumn("place", F.pmod("key", F.lit(groups)).cast("int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = raw_text(batch.column(1))
            text, start, count, h, f, g, double = anchors.runs(raw, offsets, window, gram)
            key = batch.column(2).to_numpy()[text]
            doc = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()[text]
            columns = [h >> np.uint64(8), f, g, key, doc, start - offsets[text], count | np.where(double, DOUBLE, 0)]
            yield from blobs((h >> np.uint64(40)).astype(np.int64) % groups, RUN, columns).to_batches()

    def settle(table: pa.Table) -> pa.Table:
        h, f, g, key, doc, start, count = unblob(table, RUN)
        order = np.lexsort((start, key, doc, g, f, h))
        h, f, g, key, doc, start, count = (x[order] for x in (h, f, g, key, doc, start, count))
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new_f = new_h | np.concatenate(([True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])))
        kinds = np.bincount((np.cumsum(new_h) - 1)[new_f])[np.cumsum(new_h) - 1]
        copies = np.bincount(np.cumsum(new_f) - 1)[np.cumsum(new_f) - 1]
        compare = (kinds > 1) | (count & DOUBLE != 0)
        kept = np.zeros(len(h), bool)
        if keep_first:  # the first of its kind, and the same place of rows that repeat it: spans hold for a key
            lead = np.flatnonzero(new_f)[np.cumsum(new_f) - 1]
            kept = (key == key[lead]) & (start == start[lead])
        kind = np.where((copies > 1) & ~kept, REMOVE, 0)
        kind |= np.where(compare & new_f, SEND, 0)
        kind |= np.where(compare & new_f & (kind & REMOVE == 0), ANSWER, 0)
        sent = np.where(kind & SEND > 0, (count & ~DOUBLE).astype(np.int64) + window - 1, 0)
        total = np.add.reduceat(sent, np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
        kind |= np.where((kind & SEND > 0) & (total > split_bytes), SPLIT, 0)
        use = kind > 0
        return blobs(key[use] % groups, MARK, [x[use] for x in (h, key, start, count & ~DOUBLE, kind)])

    def fetch(texts: pa.Table, marks: pa.Table) -> pa.Table:
        h, key, start, count, kind = unblob(marks, MARK)
        raw, offsets = raw_text(texts.column("text"))
        at = {k: i for i, k in enumerate(texts.column("key").to_pylist())}
        row = np.array([at.get(k, -1) for k in key.tolist()], np.int64)
        use = (kind & SEND > 0) & (row >= 0)
        h, key, start, count, kind, row = (x[use] for x in (h, key, start, count, kind, row))
        doc = texts.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()[row] if len(row) else np.zeros(0, np.int64)
        count, begin, to = count.astype(np.int64), offsets[row] + start, h.astype(np.int64) % groups
        cut = kind & SPLIT > 0
        kind &= ANSWER | SEND
        if cut.any():
            owner, at, number, name, made = split(raw, begin[cut], count[cut], kind[cut], (start[cut], key[cut], doc[cut]), window, gram, width, keep_first)
            owner = np.flatnonzero(cut)[owner]
            joined = lambda x, more: np.concatenate((x[~cut], more))
            h, to = joined(h, name.astype(np.uint32)), joined(to, (name >> np.uint64(32)).astype(np.int64) % groups)
            start, begin = joined(start, (start[owner] + at).astype(np.uint32)), joined(begin, begin[owner] + at)
            key, doc, count, kind = joined(key, key[owner]), joined(doc, doc[owner]), joined(count, number), joined(kind, made)
        length = count + window - 1
        out = blobs(to, STRETCH, [h, key, doc, start, length, kind])
        order = np.argsort(to, kind="stable")
        pack = zstandard.ZstdCompressor(level=3)
        sent = [o[kind[o] & SEND > 0] for o in (order[k] for k in stretches(to[order])[1])]
        data = [pack.compress(raw[ragged(begin[o], length[o])].tobytes()) for o in sent]
        return out.append_column("bytes", pa.array(data, pa.binary()))

    def compare(table: pa.Table) -> pa.Table:
        h, key, doc, start, length, kind = unblob(table, STRETCH)
        raw = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in table.column("bytes")), np.uint8)
        known = kind & REMOVE > 0
        found = [(key[known], start[known].astype(np.int64), start[known].astype(np.int64) + length[known])]
        h, key, doc, start, length, kind = (x[kind & SEND > 0] for x in (h, key, doc, start, length.astype(np.int64), kind))
        begin = np.cumsum(length) - length
        order = np.lexsort((start, key, doc, h))
        h, key, start, length, kind, begin = (x[order] for x in (h, key, start, length, kind, begin))
        size = np.cumsum(length)
        i = 0
        while i < len(h):
            j = int(np.searchsorted(size, size[i] - length[i] + BATCH_BYTES, "right"))
            j = max(i + 1, j)
            j = int(np.searchsorted(h, h[j - 1], "right"))  # hashes stay whole
            part = slice(i, j)
            text = raw[ragged(begin[part], length[part])]
            first = np.cumsum(length[part]) - length[part]
            owner = np.repeat(np.arange(j - i), length[part] - window + 1)
            inside = ragged(np.zeros(j - i, np.int64), length[part] - window + 1)
            sorted_starts = suffix_order(text, first[owner] + inside, window)
            hit = longest_factors(*sorted_starts) >= window
            if not keep_first:
                hit |= longest_factors(*sorted_starts, later=True) >= window
            hit &= kind[part][owner] & ANSWER > 0
            at, who = inside[hit], owner[hit]
            if len(at):
                head = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(who) != 0)))
                tail = np.concatenate((head[1:], [True]))
                place = start[part].astype(np.int64)[who]
                found.append((key[part][who[head]], (place + at)[head], (place + at)[tail] + window))
            i = j
        keys, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        return blobs(keys % groups, SPAN, [keys, starts, ends])

    def remove(texts: pa.Table, spans: pa.Table) -> pa.Table:
        key, start, end = unblob(spans, SPAN)
        order = np.argsort(key, kind="stable")
        key, start, end = key[order], start[order].astype(np.int64), end[order].astype(np.int64)
        names, removed, count, digest, kept = texts.column("key").to_numpy(), [], [], [], []
        low, high = np.searchsorted(key, names, "left").tolist(), np.searchsorted(key, names, "right").tolist()
        raw, offsets = raw_text(texts.column("text"))
        data, edges = memoryview(raw.tobytes()), offsets.tolist()
        for k in range(texts.num_rows):
            text = data[edges[k] : edges[k + 1]]
            if low[k] == high[k]:
                removed.append(0)
                count.append(0)
                kept.append(bytes(text))
            else:
                s, e = merged(start[low[k] : high[k]], end[low[k] : high[k]])
                removed.append(int((e - s).sum()))
                count.append(len(s))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True)))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans of runs that are settled without a look at their bytes."""
        for batch in batches:
            _, key, start, count, kind = unblob(pa.Table.from_batches([batch]), MARK)
            use = kind & REMOVE > 0
            end = start[use].astype(np.int64) + count[use] + window - 1
            yield from blobs(key[use] % groups, SPAN, [key[use], start[use], end]).to_batches()

    marks = rows.select("doc_id", "text", "key").mapInArrow(cut, schema(RUN)).groupBy("place").applyInArrow(settle, schema(MARK))
    marks = materialise(marks, "marks")
    texts = rows.select("place", "key", "doc_id", "text").groupBy("place")
    fetched = texts.cogroup(marks.groupBy("place")).applyInArrow(fetch, schema(STRETCH, ", bytes binary"))
    spans = fetched.groupBy("place").applyInArrow(compare, schema(SPAN)).unionByName(marks.mapInArrow(whole, schema(SPAN)))
    return texts.cogroup(spans.groupBy("place")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), keep_first=False).drop("kept")
