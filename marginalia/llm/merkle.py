"""A Merkle tree over a dataset: levels of runs are written bottom-up, proofs are pushed top-down.

Each level is a table of runs, a row for FAN consecutive nodes of a tree. A run's digest is a node of the level above.
On the way down a run's row meets the path of its own node (for every level above, the digests left and right of it), and each child
puts its own siblings before it. The leaves' paths are never shuffled: they are made inside the row of their run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import GROUP_BYTES, deals, materialise, table

FAN = 16
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
#: About the bytes of a leaf row in a shuffle.
LEAF_BYTES = 256


def field(value: Column) -> Column:
    """A value as hashed: '-' if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """tree (the source; empty for null, else with '=' before it, so that it sorts nulls first), doc_id, leaf, and tampered: the leaf's digest with text `changed`, for rows where crc32(doc_id) is a multiple of 5."""
    head = [field(docs[name]) for name in FIELDS[:-1]]
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("tree"),
        docs["doc_id"].cast("long").alias("doc_id"),
        digest(*head, field(docs["text"])).alias("leaf"),
        F.when(hit, digest(*head, field(changed))).alias("tampered"),
    )


def numbered(nodes: DataFrame, parts: int, *order: str) -> DataFrame:
    """Adds i, the place of a node in its tree from 0 in the order given (nulls first), and n, the number of nodes of the tree.

    Nodes are dealt by ranges of tree and order and written sorted; a place is the one in its part plus the counts of the parts before,
    so a tree of any size is numbered in many tasks.
    """
    keys = [F.col(name).asc_nulls_first() for name in ("tree", *order)]
    dealt = nodes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "dealt").withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    upto = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("tree", "part", (F.sum("here").over(upto) - F.col("here") - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    return dealt.join(starts, ["tree", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def files(rows: int) -> int:
    """Into how many files to write so many small rows."""
    return max(8, rows * LEAF_BYTES // GROUP_BYTES)


def runs(nodes: DataFrame, level: int, *carried: str) -> DataFrame:
    """One row a run of the nodes (tree, i, n, digest) of a level: its nodes in order as kids, and the digest of the node it makes. The only node of a tree goes up as it is."""
    kids = F.sort_array(F.collect_list(F.struct("i", "digest", *carried))).alias("kids")
    met = nodes.groupBy("tree", F.floor(F.col("i") / FAN).cast("long").alias("i")).agg(F.first("n").alias("n"), kids)
    joined = F.array_join(F.col("kids.digest"), "")
    return met.withColumn("digest", F.when(F.col("n") > FAN**level, F.sha2(joined.cast("binary"), 256)).otherwise(joined))


def rise(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """The written levels of runs over numbered nodes, from the lowest to that with one run a tree; at least one. Upper levels are small and written to few files."""
    most, level, found = nodes.agg(F.max("n")).first()[0] or 0, 0, []
    while not found or most > FAN**level:
        made = runs(nodes, level, *(carried if level == 0 else ()))
        found.append(materialise(made.coalesce(files(found[-1].count())) if found else made, f"level{level}"))
        nodes, level = found[-1].select("tree", "i", "n", "digest"), level + 1
    return found


def children(level: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The nodes of a level with their paths: each run meets the path of its own node in `above` (tree, i, path, ...), and each child prepends its siblings."""
    run = level.join(above, ["tree", "i"]).withColumn("inner", F.col("n") > FAN**height).select("*", F.posexplode("kids").alias("slot", "kid")).drop("i")
    siblings = F.col("kids.digest")
    left = F.array_join(F.slice(siblings, 1, F.col("slot")), "")
    right = F.array_join(F.slice(siblings, F.col("slot") + 2, FAN), "")
    path = F.when(F.col("inner"), F.array_prepend("path", F.struct(left.alias("left"), right.alias("right")))).otherwise(F.col("path"))
    return run.select(*[c for c in above.columns if c not in ("i", "path")], "kid.*", path.alias("path"))


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest nodes with their paths, from the paths of the trees' last nodes."""
    for height in range(len(levels) - 1, -1, -1):
        nodes = children(levels[height], top, height)
        top = nodes if height == 0 else nodes.drop("digest")
    return top


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and a path lead to."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs.

    Null fields are hashed as '-', empty texts as '0:'. Null doc_ids come first in their source and are never tampered with; rows of one
    source and id are ordered by their leaf digests, and equal rows are leaves of their own with equal digests, so
    which of them stands first doesn't matter to any root. A null source is a tree of its own, before the empty one.
    A source with one row has that leaf as subroot; one source's subroot is the root. Long texts are hashed once (twice
    where tampered) and never shuffled. An empty table gives no rows. Other columns are passed over.
    """
    changed = F.translate(docs["text"], CAPITALS, CAPITALS.lower()) if changed is None else changed
    found = materialise(leaves(docs, changed), "leaves")
    parts = deals(docs.sparkSession, found.count() * LEAF_BYTES)
    low = rise(numbered(found, parts, "doc_id", "leaf").withColumnRenamed("leaf", "digest"), "doc_id", "tampered")
    subroots = low[-1].select("tree", "digest")
    high = rise(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), files(subroots.count()), "source"), "source")
    last = high[-1].first()
    root = F.lit(last["digest"] if last else None).cast("string")
    top = high[-1].select("tree", "i", F.array().cast(PATH).alias("path"))
    over = materialise(descend(high, top).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("i"), F.col("digest").alias("subroot"), "path").coalesce(files(subroots.count())), "paths")
    placed = descend(low, over)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    folded = fold(F.coalesce("tampered", "digest"), F.col("path"))
    out = placed.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: crc32 in DuckDB: the table of all bytes' remainders, and a fold over the characters of an ASCII string.
CRC_TABLE_SQL = """crc_steps(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB's expression for the unsigned crc32 of an ASCII string, beside the column crc of table crc."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"


def _levels_sql(name: str, nodes: str, height: int) -> str:
    """CTEs <name>_r0.. : the runs of each level (tree, p, n, kids), of nodes (tree, i, n, digest)."""
    out = []
    for k in range(height):
        source = nodes if k == 0 else f"{name}_n{k}"
        out.append(f"{name}_r{k} AS MATERIALIZED (SELECT tree, i // 16 AS p, n, list(digest ORDER BY i) AS kids FROM {source} GROUP BY tree, i // 16, n)")
        out.append(f"{name}_n{k + 1} AS (SELECT tree, p AS i, n, CASE WHEN n > {16**k} THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS digest FROM {name}_r{k})")
    return ",\n".join(out)


def _climb_sql(name: str, height: int) -> str:
    """CTEs <name>_c1.. : every row (tree, i, h, proof, ...) of <name>_c0 one level higher, with its siblings behind the proof."""
    out = []
    for k in range(height):
        slot = f"(i // {16**k}) % 16"
        left, right = f"array_to_string(kids[1:{slot}], '')", f"array_to_string(kids[{slot} + 2:], '')"
        out.append(
            f"{name}_c{k + 1} AS MATERIALIZED (SELECT c.* REPLACE (CASE WHEN n > {16**k} THEN sha256({left} || h || {right}) ELSE h END AS h,"
            f" CASE WHEN n > {16**k} THEN proof || {left} || {right} ELSE proof END AS proof) FROM {name}_c{k} c JOIN {name}_r{k} r ON r.tree = c.tree AND r.p = i // {16 ** (k + 1)})"
        )
    return ",\n".join(out)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_HEAD = " || ".join(_field_sql(f"{name}::VARCHAR") for name in FIELDS[:-1])
#: Up to 16 ** 6 rows a source and 16 ** 4 sources.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS source, sha256({_HEAD} || {_field_sql("text")}) AS leaf,
    CASE WHEN {crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN sha256({_HEAD} || {_field_sql(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")}) END AS tampered
  FROM documents, crc),
low_nodes AS MATERIALIZED (
  SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS digest, doc_id, tampered FROM d),
{_levels_sql("low", "low_nodes", 6)},
high_nodes AS MATERIALIZED (
  SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, digest, tree AS source FROM low_n6),
{_levels_sql("high", "high_nodes", 4)},
low_c0 AS (SELECT tree, i, coalesce(tampered, digest) AS h, '' AS proof, doc_id, digest AS leaf FROM low_nodes),
{_climb_sql("low", 6)},
high_c0 AS (SELECT s.tree, s.i, c.h, c.proof, c.doc_id, c.leaf, s.digest AS subroot FROM low_c6 c JOIN high_nodes s ON s.source = c.tree),
{_climb_sql("high", 4)}
SELECT c.doc_id, c.leaf, c.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.digest AS verified
FROM high_c4 c, high_n4 t
"""
