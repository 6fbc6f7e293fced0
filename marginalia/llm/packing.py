"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import clean, slices, table
from marginalia.llm.tokens import default_path, encoder

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 16_384
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


class Packer:
    """Fills windows of several sizes, all powers of two, from the documents of one task.

    A document gives as many whole windows of the largest size as it can. What is left of it goes to the tier of
    the smallest window that holds it. Each tier is packed from the longest down: a piece opens a window of its
    tier, whole pieces of shorter tiers fill the gap, and the last gap takes a cut from the shortest piece at hand.
    So every closed window is full. flush() splits what remains into windows of falling powers of two.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, first_id: int = 0):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("context sizes must be powers of two")
        self.tiers, self.step_tokens = tuple(sorted(set(tiers), reverse=True)), step_tokens
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.next_id, self.step_id = first_id, first_id
        self.open_steps: dict[int, list[int]] = {}
        self.rows: list[tuple] = []

    def _tier(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if n <= t)

    def _close(self, window: list[tuple], size: int) -> None:
        """A step group takes windows of one size up to step_tokens, so groups of a size hold equal numbers of tokens."""
        step = self.open_steps.get(size)
        if step is None:
            step = self.open_steps[size] = [self.step_id, 0]
            self.step_id += 1
        at = 0
        for doc_id, ids, start, length in window:
            crc = zlib.crc32(np.ascontiguousarray(ids[start : start + length], "<u4").tobytes())
            self.rows.append((doc_id, start, length, crc, len(ids), self.next_id, at, size, step[0]))
            at += length
        self.next_id += 1
        step[1] += size
        if step[1] >= self.step_tokens:
            del self.open_steps[size]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, n = self.tiers[0], len(ids)
        for start in range(0, n - top + 1, top):
            self._close([(doc_id, ids, start, top)], top)
        if n % top:
            self.waiting[self._tier(n % top)].append((doc_id, ids, n - n % top, n % top))

    def _cut(self, gap: int) -> tuple | None:
        """Exactly gap tokens from the head of a waiting piece that is longer, the shortest tier's first."""
        for t in reversed(self.tiers):
            for k in range(len(self.waiting[t]) - 1, max(-1, len(self.waiting[t]) - 9), -1):
                doc_id, ids, start, length = self.waiting[t][k]
                if length > gap:
                    self.waiting[t].pop(k)
                    self.waiting[self._tier(length - gap)].append((doc_id, ids, start + gap, length - gap))
                    return doc_id, ids, start, gap
        return None

    def pack(self) -> None:
        """Packs what waits, until a window can't be filled; that window's pieces wait on."""
        for size in self.tiers:
            while self.waiting[size]:
                window = [self.waiting[size].pop()]
                gap = size - window[0][3]
                for t in (t for t in self.tiers if t < size):
                    while gap and self.waiting[t] and self.waiting[t][-1][3] <= gap:
                        window.append(self.waiting[t].pop())
                        gap -= window[-1][3]
                while gap:
                    piece = self._cut(gap) or next((self.waiting[t].pop() for t in self.tiers if self.waiting[t]), None)
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= piece[3]
                if gap:
                    for piece in window:
                        self.waiting[self._tier(piece[3])].append(piece)
                    return
                self._close(window, size)

    def flush(self) -> None:
        self.pack()
        left = [p for t in self.tiers for p in self.waiting[t]]
        self.waiting = {t: [] for t in self.tiers}
        total = sum(p[3] for p in left)
        while total:
            size = min(self.tiers[0], 1 << (total.bit_length() - 1))
            window, room = [], size
            while room:
                doc_id, ids, start, length = left.pop()
                take = min(room, length)
                window.append((doc_id, ids, start, take))
                if take < length:
                    left.append((doc_id, ids, start + take, length - take))
                room -= take
            self._close(window, size)
            total -= size

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Packs documents into full sequences of several lengths; one row for each piece of a document.

    The ids of a document are those of its whole text and `end`. Every input partition is packed by itself, in one
    narrow pass without a shuffle; a sequence never spans partitions. Rows with a null text hold `end` alone; a null
    doc_id stays null; repeated rows are packed as often as they occur; an empty table gives no rows. Texts of any
    length are cut into windows. Other columns of the input are dropped.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, names = Packer(tiers, step_tokens, part << 40), [x.split()[0] for x in SCHEMA.split(", ")]

        def out() -> Iterator[pa.RecordBatch]:
            if rows := packer.take():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in slices(batches):
            ids, offsets = encoder(path).encode(batch.column(1), end)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                packer.add(doc_id, ids[offsets[k] : offsets[k + 1]])
            packer.pack()
            yield from out()
        packer.flush()
        yield from out()

    return clean(docs).mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
