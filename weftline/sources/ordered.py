"""Places in an order over all partitions: of sorted rows, and of the lines of input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

#: Ordinals of one bucket: what one task orders when a limit falls into it.
BUCKET = 1 << 16


def _before(counts: DataFrame, *order: str) -> DataFrame:
    """Adds how many rows come before each part; one row for each part, so they fit in one task."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def numbered(rows: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Adds the place of each row, from 0, in an order over all rows.

    Rows are sorted by ranges and written once; a range's first place is the sum of the counts
    before it, so no task holds more than its range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    parts = kept.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    placed = kept.join(_before(parts, "_part").drop("n"), "_part")
    return placed.withColumn(name, F.col("before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "before")


def input_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, file, ordinal: the lines of text files in the order of the files' names and lines.

    A line's place is that in its piece of a file, the rows of the pieces before it, and those of
    the files before it. Pieces differ from scan to scan, so lines are written with theirs once.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    kept = stored(lines, "input-lines")
    pieces = kept.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    placed = kept.join(_before(pieces, "file", "_block").drop("n"), ["file", "_block"])
    return placed.select("value", "file", (F.col("before") + F.col("_at") - F.col("_first")).alias("ordinal"))


def first_in_order(rows: DataFrame, limit: int, ordinal: str = "ordinal") -> DataFrame:
    """The first rows by a column of distinct ordinals, which may have gaps.

    Counts by buckets of ordinals say in which bucket the limit falls; only there rows are ordered.
    """
    bucket = F.expr(f"{ordinal} div {BUCKET}")
    counts = _before(rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n")), "_bucket").where(F.col("before") < limit)
    some = rows.withColumn("_bucket", bucket).join(counts, "_bucket")
    whole = some.where(F.col("before") + F.col("n") <= limit)
    last = some.where(F.col("before") + F.col("n") > limit)
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(ordinal))
    last = last.withColumn("_place", place).where(F.col("before") + F.col("_place") <= limit).drop("_place")
    return whole.unionByName(last).drop("_bucket", "n", "before")
