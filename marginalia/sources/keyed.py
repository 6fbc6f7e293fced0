"""Tables of one row a key in bucket folders, so that an upsert or a guarded update rewrites only the buckets that its keys fall into."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Files of a bucket: its keys are dealt over so many tasks.
PARTS = 2
Guard = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class KeyedTable:
    """A folder of Parquet files by bucket of the key's hash. A null key is a key like others."""

    path: str
    keys: tuple[str, ...]
    buckets: int

    def _dealt(self, df: DataFrame) -> DataFrame:
        h = F.xxhash64(*self.keys)
        return df.withColumns({"bucket": F.pmod(h, F.lit(self.buckets)).cast("int"), "_part": F.pmod(F.shiftrightunsigned(h, 40), F.lit(PARTS)).cast("int")})

    def _last(self, df: DataFrame, order: list[str]) -> DataFrame:
        """One row a key, put together in each task before the shuffle, so that a key with very many rows is no hot group."""
        rest = [c for c in df.columns if c not in self.keys]
        return df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("_row")).select(*self.keys, "_row.*").select(*df.columns)

    def _grouped(self, df: DataFrame, buckets: int):
        """Rows by key, after one shuffle by bucket and part, which is also how they are written."""
        return df.repartition(buckets * PARTS, "bucket", "_part").groupBy("bucket", "_part", *self.keys)

    def create(self, rows: DataFrame, order: list[str]) -> KeyedTable:
        """Writes the table; of several rows of one key the greatest by order counts."""
        last = self._dealt(self._last(rows, order)).repartition(self.buckets * PARTS, "bucket", "_part")
        last.select(*rows.columns, "bucket").write.partitionBy("bucket").parquet(self.path)
        return self

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("bucket")

    def upsert(self, changes: DataFrame, order: list[str], guard: Guard | None = None, insert: bool = True) -> dict[str, int]:
        """Applies changes (all columns of the table) and returns how many keys were inserted, updated and refused.

        Of several changes of one key the greatest by order counts, ties by the other columns. A known key's columns take the
        change's values where these aren't null, if guard (of the old and the new row; null counts as false) allows it. An unknown
        key is inserted, or refused where insert is False. Guard and counts are worked out in the pass that writes. Untouched
        buckets are neither read nor written; their number bounds what the driver learns of the changes. Buckets are replaced
        when all their files are staged, one after the other: after a driver lost in between, the same changes can be applied
        again, and without a guard give the same rows. Two upserts of one table must not run at once.
        """
        spark = changes.sparkSession
        columns = self.rows(spark).columns
        rest = [c for c in columns if c not in self.keys]
        changes = self._dealt(self._last(changes.select(*columns), order))
        touched = [r[0] for r in changes.select("bucket").distinct().collect()]
        if not touched:
            return {"inserted": 0, "updated": 0, "refused": 0}
        old = self._dealt(spark.read.parquet(self.path).where(F.col("bucket").isin(touched)))
        row = F.struct(*rest)
        side = lambda df, new: df.select(*self.keys, "bucket", "_part", F.lit(new).alias("_new"), row.alias("_row"))
        both = side(old, False).unionByName(side(changes, True))
        met = self._grouped(both, len(touched)).agg(
            F.first(F.when(~F.col("_new"), F.col("_row")), ignorenulls=True).alias("old"), F.first(F.when(F.col("_new"), F.col("_row")), ignorenulls=True).alias("new"),
        )
        known, asked = F.col("old").isNotNull(), F.col("new").isNotNull()
        allowed = F.coalesce(guard(F.col("old"), F.col("new")), F.lit(False)) if guard else F.lit(True)
        fate = F.when(~asked, "kept").when(~known, "inserted" if insert else "refused").when(allowed, "updated").otherwise("refused")
        value = lambda c: F.when(F.col("_fate") == "updated", F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).when(F.col("_fate") == "inserted", F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        counts = Observation()
        made = met.withColumn("_fate", fate).observe(counts, *[F.count_if(F.col("_fate") == k).cast("long").alias(k) for k in ("inserted", "updated", "refused")])
        made = made.where(known | (F.col("_fate") == "inserted")).select(*[F.col(c) if c in self.keys else value(c).alias(c) for c in columns], "bucket")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return dict(counts.get)
