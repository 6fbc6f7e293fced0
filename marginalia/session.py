"""The Spark session that tests and benchmarks use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", app: str = "marginalia") -> SparkSession:
    """UTC, adaptive execution with skew handling, and few shuffle partitions, for one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
