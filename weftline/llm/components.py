"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, stored


def _print(edges: DataFrame):
    """Tells two edge tables apart: their size and the combined hash of their rows."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected(edges: DataFrame) -> DataFrame:
    """cls, component (smallest id reachable) for every end of an edge (a, b)."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = stored(edges, "edges")
    before = _print(edges)
    while True:
        # large star: every node's larger neighbours point to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: every node's smaller neighbours and itself point to the smallest of them
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y").unionByName(
            lower.select(F.col("m").alias("x"), F.col("b").alias("y"))
        )
        after = stored(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        forget(edges)
        edges, last, before = after, before, _print(after)
        if last == before:
            break
    nodes = edges.select(F.col("b").alias("cls"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("cls"), F.col("a").alias("component")).distinct())
