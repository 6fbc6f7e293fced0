"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: A group that meets in one task holds about so many bytes.
GROUP_BYTES = 16 << 20
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir or, where that is unset, under the context's checkpoint folder.

    With neither, a folder of this machine will do on a local master; on a cluster executors would write apart, so
    that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='marginalia-')}")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors cost no recomputation of its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deals(spark: SparkSession, total_bytes: int, each: int = GROUP_BYTES) -> int:
    """Into how many groups to deal data, so that each holds about `each` bytes; the shuffle setting at least."""
    return max(shuffle_partitions(spark), -(-int(total_bytes or 0) // each))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one number, from one pass over the column."""
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def by_key(batches: Iterable[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of whole keys from batches that are sorted by `key`: as many keys together as make about `most` bytes."""
    held: list[pa.RecordBatch] = []
    size, last = 0.0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        weight, begin = batch.nbytes / len(names), 0
        heads = np.flatnonzero(names[1:] != names[:-1]) + 1
        for cut in ([0] if held and names[0] != last else []) + heads.tolist():
            if size + (cut - begin) * weight >= most:
                held += [batch.slice(begin, cut - begin)] * (cut > begin)
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0.0, cut
        held.append(batch.slice(begin))
        size += (len(names) - begin) * weight
        last = names[-1]
    if held:
        yield pa.Table.from_batches(held)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on; a null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def raw_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without a copy: bytes, and n + 1 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches at rows so that each slice holds about `most` bytes of text, or one longer row."""
    for batch in batches:
        _, offsets = raw_text(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, min(j, n) - i)
            i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def stretches(names: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The values of a sorted array and where each lies."""
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
    edge = np.append(first, len(names)).tolist()
    return names[first], [slice(i, j) for i, j in zip(edge[:-1], edge[1:])]


def crc_mod(n: int):
    """crc32 of doc_id as text, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))
