"""Token ids of a corpus in wavelet-matrix files: succinct bit planes with rank and select.

A file is one binary row of a Parquet folder in the shared storage, so that only Spark's readers and writers touch it.
Layout, little-endian: HEADER; document ids (int64), their null flags (uint8) and lengths (uint32); then for each bit
of the ids, highest first, a plane: packed bits, and the ones before each block of BLOCK bits (uint32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import clean, deals, shared_path, slices, table, text_bytes
from marginalia.llm.tokens import default_path, encoder

END = 2
BLOCK = 512
MAGIC = b"MWM1"
#: magic, bits of an id, tokens, documents, the file's first token in its partition, and the partition
HEADER = struct.Struct("<4sIQQQQ")
#: A file takes whole documents until it has so many tokens.
FILE_TOKENS = 1 << 18
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """planes[k]: packed bits and ranks of the k-th highest bit, of the ids stably sorted by their higher bits, zeros first."""

    def __init__(self, n: int, planes: list[tuple[np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes
        self.zeros = [n - self._rank(k, n) for k in range(len(planes))]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), []
        for k in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << k)) != 0
            packed = np.packbits(one, bitorder="little")
            full = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            full[: len(packed)] = packed
            ranks = np.zeros(len(full) // (BLOCK // 8) + 1, np.uint32)
            np.cumsum(ONES[full].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32), out=ranks[1:])
            planes.append((full, ranks))
            now = now.take(cls._order(one))
        return cls(len(ids), planes)

    @staticmethod
    def _order(one: np.ndarray) -> np.ndarray:
        """The positions of a plane in the order of the next: zeros first, then ones."""
        return np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))

    def _rank(self, k: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        packed, ranks = self.planes[k]
        block = i // BLOCK
        inside = packed[block * (BLOCK // 8) : i // 8]
        tail = int(packed[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ranks[block]) + int(ONES[inside].sum(dtype=np.int64)) + int(ONES[tail])

    def access(self, i: int) -> int:
        value = 0
        for k, (packed, _) in enumerate(self.planes):
            bit = int(packed[i // 8]) >> (i % 8) & 1
            ones = self._rank(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token among the first i."""
        low, bits = 0, len(self.planes)
        for k in range(bits):
            if token >> (bits - 1 - k) & 1:
                low, i = self.zeros[k] + self._rank(k, low), self.zeros[k] + self._rank(k, i)
            else:
                low, i = low - self._rank(k, low), i - self._rank(k, i)
        return i - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n) if token >> len(self.planes) == 0 else 0

    def _select(self, k: int, bit: int, nth: int) -> int:
        """The place of the nth (from 0) bit of its kind in a plane."""
        packed, ranks = self.planes[k]
        before = ranks if bit else np.minimum(np.arange(len(ranks), dtype=np.int64) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, nth, "right")) - 1
        here = np.unpackbits(packed[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(here == bit)[nth - int(before[block])])

    def select(self, token: int, nth: int) -> int:
        """The place of a token's nth occurrence, from 0."""
        bits, low = len(self.planes), 0
        for k in range(bits):
            low = self.zeros[k] + self._rank(k, low) if token >> (bits - 1 - k) & 1 else low - self._rank(k, low)
        at = low + nth
        for k in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane tells which of the sorted values go where."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k][0], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[self._order(one)] = now
            now = above | (one.astype(kind) << kind(bits - 1 - k))
        return now


def to_file(part: int, start: int, docs: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    matrix = WaveletMatrix.build(ids, bits)
    parts = [HEADER.pack(MAGIC, bits, len(ids), len(docs), start, part)]
    parts += [np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], np.uint8).tobytes(), lengths.astype("<u4").tobytes()]
    for packed, ranks in matrix.planes:
        parts += [packed.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(parts)


def from_file(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, WaveletMatrix]:
    """Partition, first token in it, document ids, their lengths and the matrix."""
    magic, bits, n, docs, start, part = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    blocks = -(-n // BLOCK)
    planes = [(take("u1", blocks * (BLOCK // 8)), take("<u4", blocks + 1)) for _ in range(bits)]
    return part, start, [None if x else d for d, x in zip(ids.tolist(), null.tolist(), strict=True)], lengths, WaveletMatrix(n, planes)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS) -> None:
    """Encodes whole texts, each followed by `end`, and writes files in ascending doc_id order (null ids first, repeated rows side by side).

    A null text is empty and has the end token alone; an empty table gives an empty folder; a text of any length is
    one document in one file. Only doc_id and text are read. Partitions are ranges of doc_id and, so that rows of one id
    or of none need no one partition, of a hash of the text.
    """
    source = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        code = encoder(source)
        bits = max(code.tokenizer.get_vocab_size() - 1, end).bit_length()
        names, lengths, ids = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal names, lengths, ids, done
            whole = np.concatenate(ids)
            data = to_file(part, done, names, np.concatenate(lengths), whole, bits)
            out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([done]), pa.array([len(whole)]), pa.array([data], pa.binary())], ["part", "start", "n", "file"])
            done += len(whole)
            names, lengths, ids = [], [], []
            return out

        for batch in slices(batches, most=1 << 20):
            found, offsets = code.encode(batch.column(1), end)
            names += batch.column(0).to_pylist()
            lengths.append(np.diff(offsets))
            ids.append(found)
            if sum(map(len, ids)) >= file_tokens:
                yield close()
        if names:
            yield close()

    by = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    dealt = clean(docs).withColumn("hash", F.xxhash64("text")).repartitionByRange(deals(docs.sparkSession, text_bytes(docs)), *by)
    ordered = dealt.sortWithinPartitions(*by).select("doc_id", "text")
    ordered.mapInArrow(run, "part long, start long, n long, file binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    The partitions' sizes, one number each, come to the driver and give the first token of each. Null ids come back as
    null; an empty folder gives no rows.
    """
    files = spark.read.parquet(path)
    first, total = [], 0
    for r in sorted(files.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        first.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(first, "part long, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                part, start, docs, lengths, matrix = from_file(data.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = files.select("file").mapInArrow(run, "part long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def locate(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id (null where it was) and place in the document of every occurrence of a token, by select on the planes; none for a token that no file has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                _, _, docs, lengths, matrix = from_file(data.as_py())
                at = np.array([matrix.select(token, k) for k in range(matrix.count(token))], np.int64)
                ends = np.cumsum(lengths, dtype=np.int64)
                doc = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array([docs[d] for d in doc.tolist()], pa.int64()), pa.array(at - (ends - lengths)[doc], pa.int64())], ["doc_id", "place"])

    return spark.read.parquet(path).select("file").mapInArrow(run, "doc_id long, place long")


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "wavelet")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
