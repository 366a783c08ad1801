"""Cutting lineage with tables in the folder that all executors share; sizes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import forget, new_path, scratch, shared_folder, stored

__all__ = ["bucket_count", "forget", "new_path", "scratch", "shared_folder", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, as its files have them, for each hash bucket.
BUCKET_BYTES = 64 << 20


def bucket_count(df: DataFrame) -> int:
    """How many hash buckets df is dealt to, so that one task can hold any of them.

    One for each ``BUCKET_BYTES`` of the files that df reads (Spark's own estimate), but as
    many as the session's shuffle partitions at least, and 8. Where Spark has no estimate
    (a table of unknown size), the shuffle partitions decide.
    """
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return parts if size >= 1 << 60 else min(max(parts, size // BUCKET_BYTES), 1 << 20)
