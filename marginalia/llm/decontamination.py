"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows make a hash table that is broadcast after its size was checked. A window of n words
holds exactly one block of b words that begins at a multiple of s, where s + b - 1 = n. So a document is probed
with one block hash in s words; around a block that the benchmark also has, the up to s windows that hold the block
are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import clean, materialise, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The benchmark is broadcast up to so many windows and so many bytes of their words and item ids, and joined by a shuffle beyond.
BROADCAST_WINDOWS, BROADCAST_BYTES = 400_000, 64 << 20
#: Copies of the benchmark's tables in a shuffled join.
SALTS = 8


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of the items: win (words), n, items (ids as sorted strings). An item of fewer words is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    size = F.size("w")
    starts = F.when(size >= window, F.sequence(F.lit(1), size - window + 1)).when(size > 0, F.array(F.lit(1)))
    return (
        items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("win", F.size("win").alias("n"), "items", F.xxhash64("win").alias("hash"))
    )


def block_hashes(wins: DataFrame, lengths: dict[int, int], window: int) -> DataFrame:
    """h and len: the hashes of each whole window's blocks, and those of each shorter window as it is."""
    stride = (window + 1) // 2
    block = window - stride + 1
    blocks = (
        wins.where(F.col("n") == window)
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda i: F.xxhash64(F.slice("win", i, block)))).alias("h"))
        .distinct()
        .select("h", F.lit(window).alias("len"))
    )
    for n in sorted(k for k in lengths if k < window):
        blocks = blocks.unionByName(wins.where(F.col("n") == n).select(F.col("hash").alias("h"), F.lit(n).alias("len")).distinct())
    return blocks


def probes(lengths: dict[int, int], window: int, near: bool = False) -> list[Column]:
    """Arrays of (at, h, len) over the words w: one block hash in `stride` words, and every place for shorter windows. With `near`, each has the words of all windows that hold its block (see around), so that a row made of it needs no more of the text."""
    stride = (window + 1) // 2
    size = F.size("w")

    def made(n: int, every: int, width: int) -> Column:
        def probe(i: Column) -> Column:
            first = F.greatest(i - (n - width), F.lit(1))
            words = [F.slice("w", first, i - first + n).alias("near")] * near
            return F.struct(i.alias("at"), F.xxhash64(F.slice("w", i, width)).alias("h"), F.lit(n).alias("len"), *words)

        found = F.transform(F.sequence(F.lit(1), size - width + 1, F.lit(every)), probe)
        return F.when(size >= width, found).otherwise(F.array().cast(f"array<struct<at:int,h:bigint,len:int{',near:array<string>' * near}>>"))

    return [made(window, stride, window - stride + 1)] * (window in lengths) + [made(n, 1, n) for n in sorted(lengths) if n < window]


def around(at: Column, n: Column, window: int, words: Column | None = None) -> Column:
    """The windows (s, win) over the words w that hold the block at `at`; with the probe's own words, from these."""
    size, back = F.size("w"), F.when(n == window, (window + 1) // 2 - 1).otherwise(0)
    if words is not None:
        first = F.greatest(at - back, F.lit(1))
        high = F.least(at, first + F.size(words) - n)
        return F.when((at > 0) & (first <= high), F.transform(F.sequence(first, high), lambda s: F.struct(s.alias("s"), F.slice(words, s - first + 1, n).alias("win"))))
    low, high = F.greatest(at - back, F.lit(1)), F.least(at, size - n + 1)
    return F.when((at > 0) & (low <= high), F.transform(F.sequence(low, high), lambda s: F.struct(s.alias("s"), F.slice("w", s, n).alias("win"))))


def by_row(found: DataFrame, *more: Column) -> DataFrame:
    """The hit windows (s, n) and the items of each row."""
    return found.groupBy("row").agg(
        *more,
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct(F.col("c.s").alias("s"), F.col("n").alias("n")))).alias("starts"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def hits_by_broadcast(rows: DataFrame, wins: DataFrame, lengths: dict[int, int], window: int) -> DataFrame:
    """One pass over the documents, with the benchmark's tables in every task. A probe's row has the few words around it, not the text, so time is in proportion to a text's length."""
    # One probe without a hash keeps each document's row through the join.
    keep = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("long").alias("h"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("near")))
    rows = rows.withColumn("size", F.size("w"))  # below the explode, above which w is never read
    probe = rows.select("doc_id", "row", "size", F.explode_outer(F.concat(keep, *probes(lengths, window, True))).alias("p"))
    hit = probe.join(F.broadcast(block_hashes(wins, lengths, window)).withColumn("known", F.lit(True)), (F.col("p.h") == F.col("h")) & (F.col("p.len") == F.col("len")), "left")
    hit = hit.where((F.col("p.at") == 0) | F.col("known"))
    at, n = F.col("p.at"), F.col("p.len")
    tried = hit.select("doc_id", "row", F.when(at == 0, F.col("size")).alias("n_words"), F.explode_outer(around(at, n, window, F.col("p.near"))).alias("c"))
    found = tried.join(F.broadcast(wins), (F.xxhash64("c.win") == F.col("hash")) & (F.col("c.win") == F.col("win")), "left")
    return by_row(found.where(F.col("n_words").isNotNull() | F.col("items").isNotNull()), F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"))


def hits_by_shuffle(rows: DataFrame, wins: DataFrame, lengths: dict[int, int], window: int) -> DataFrame:
    """For a benchmark too large to broadcast: probes of a few numbers each meet the blocks by hash, salted, as a block may be in a third of all texts; the words join only the rows that were hit, once each."""
    rows = materialise(rows, "words")
    salted = block_hashes(wins, lengths, window).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    probe = rows.select("row", F.explode(F.concat(*probes(lengths, window))).alias("p")) if lengths else rows.select("row", F.struct(F.lit(0).alias("at"), F.lit(None).cast("long").alias("h"), F.lit(0).alias("len")).alias("p")).limit(0)
    probe = probe.select("row", "p.at", "p.h", "p.len", F.pmod(F.xxhash64("row", "p.at"), F.lit(SALTS)).cast("int").alias("salt"))
    hit = probe.join(salted, ["h", "len", "salt"]).groupBy("row").agg(F.collect_set(F.struct("at", "len")).alias("blocks"))
    tried = rows.join(hit, "row").select("row", F.explode(F.array_distinct(F.flatten(F.transform("blocks", lambda b: around(b["at"], b["len"], window))))).alias("c"))
    # A window that many texts hold is looked up once for each salt too.
    copies = wins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tried = tried.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).withColumn("hash", F.xxhash64("c.win"))
    found = by_row(tried.join(copies, ["hash", "salt"]).where(F.col("c.win") == F.col("win")))
    return rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words")).join(found, "row", "left").withColumns({"starts": F.coalesce("starts", F.array().cast("array<struct<s:int,n:int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def numbered(docs: DataFrame) -> DataFrame:
    return clean(docs).withColumn("row", F.monotonically_increasing_id())


def hits(rows: DataFrame, benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """As report(), for texts with a row number."""
    wins = benchmark_windows(benchmark, window)
    size = F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + 64
    sizes = wins.groupBy("n").agg(F.count("*").alias("count"), F.sum(size.cast("long")).alias("bytes")).collect()  # at most `window` rows
    lengths = {r["n"]: r["count"] for r in sizes}
    small = sum(lengths.values()) <= most and sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    find = hits_by_broadcast if small else hits_by_shuffle
    found = find(rows.select("doc_id", "row", words_of(F.col("text")).alias("w")), wins, lengths, window)
    hit = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    return found.withColumn("n_hit", hit.cast("long")).select("doc_id", "row", "n_words", "n_hit", "items", "starts")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_hit, items (array of ids as strings), starts (hit windows).

    A document's word is hit when it lies inside an occurrence of a benchmark window. Null texts have no words; a
    null doc_id stays null; repeated rows are reported one by one; an empty benchmark hits nothing and an empty
    table gives no rows; items without words are passed over; the windows of a null item id hit words, but it is listed as no item. Only doc_id, text, item_id and text
    of the inputs are read, so other columns can't clash. Beyond `most` windows the benchmark isn't broadcast.
    """
    return hits(numbered(docs), benchmark, window, most)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, all columns kept. Rows are told apart by id and text: of two that share an id the clean one stays. A null doc_id always stays."""
    rows = numbered(docs).withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text"))))
    bad = hits(rows, benchmark, window, BROADCAST_WINDOWS).where("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias("_bad")).distinct().select("_bad.*")
    key = (docs["doc_id"].cast("long") == bad["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["text"])
    return docs.join(bad, key, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id and text without the hit words and the separators after them; one row for each document row. A null text gives an empty one."""
    rows = materialise(numbered(docs), "numbered")  # row numbers may differ from one pass to the next
    found = hits(rows, benchmark, window, BROADCAST_WINDOWS)
    parts = rows.join(found.select("row", "starts"), "row").select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(WORD.replace("\\x60", "\\x40\\x5B-\\x60")), F.lit(0)).alias("w"),
        F.split("text", WORD.replace("\\x60", "\\x40\\x5B-\\x60"), -1).alias("gaps"),
        F.flatten(F.transform("starts", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))).alias("hit"),
    )
    kept = F.transform("w", lambda w, i: F.when(F.array_contains("hit", i + 1), F.lit("")).otherwise(F.concat(w, F.get("gaps", i + 1))))
    return parts.select("doc_id", F.concat(F.coalesce(F.get("gaps", F.lit(0)), F.lit("")), F.array_join(kept, "")).alias("text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, list_aggregate(w[i:i+9], 'string_agg', ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT rid, i, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT occ.rid, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.k = win.k AND occ.n = win.n),
per AS (
  SELECT rid, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids, count(DISTINCT item_id) AS n_items FROM hit GROUP BY rid),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(per.n_items, 0) AS n_items,
  sha256(coalesce(per.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN per USING (rid) LEFT JOIN pos USING (rid)
"""
