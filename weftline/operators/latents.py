"""Geometry of embeddings: probes, per-dimension statistics, mean cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import squared_l2


def dimensions(rows: DataFrame, vector: str = "v", *keep: str) -> DataFrame:
    """One row per component: keep columns, dim from 0, x."""
    return rows.select(*keep, F.posexplode(vector).alias("dim", "x"))


def dim_statistics(rows: DataFrame) -> DataFrame:
    d = dimensions(rows)
    return d.groupBy("dim").agg(
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.var_pop("x"), 6).alias("variance"),
        F.min("x").alias("least"),
        F.max("x").alias("most")
    )


def eta_squared(rows: DataFrame, label: str = "label") -> DataFrame:
    """Between-label share of each dimension's squares, clamped to [0, 1]."""
    d = dimensions(rows, "v", label)
    groups = d.groupBy("dim", label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    total = groups.groupBy("dim").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sum("q").alias("q"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b")
    )
    between, whole = F.col("b") - F.col("n") * F.col("mean") ** 2, F.col("q") - F.col("n") * F.col("mean") ** 2
    return total.select(
        "dim",
        F.round(
            F.when(whole <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), between / whole))), 6
        ).alias("eta_squared")
    )


def mean_pair_cosine(rows: DataFrame) -> DataFrame:
    """Mean cosine of all pairs from the sum of unit vectors: no pairs are made."""
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    units = rows.select(F.transform("v", lambda x: x / norm).alias("u"))
    sums = units.select(F.posexplode("u").alias("dim", "x")).groupBy("dim").agg(
        F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n")
    )
    return sums.agg(
        F.round(
            (F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (F.max("n") * (F.max("n") - 1)).cast("double"), 6
        ).alias("mean_cosine")
    )


def centroids(train: DataFrame, label: str = "label") -> DataFrame:
    d = dimensions(train, "v", label).groupBy(label, "dim").agg(F.avg("x").alias("m"))
    return d.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("c"))


def nearest_centroid(rows: DataFrame, train: DataFrame, ident: str = "id", label: str = "label") -> DataFrame:
    """ident, actual, predicted: the label of the nearest centroid, ties to the smallest label.

    Centroids are one row per label; every row meets each of them.
    """
    c = centroids(train, label).withColumnRenamed(label, "predicted")
    d = rows.crossJoin(c).select(
        ident, F.col(label).alias("actual"), "predicted", F.round(squared_l2(F.col("v"), F.col("c")), 9).alias("d")
    )
    return d.groupBy(ident, "actual").agg(F.min(F.struct("d", "predicted")).alias("best")).select(
        ident, "actual", F.col("best.predicted").alias("predicted")
    )


def latest(df: DataFrame, key: list[str], ordinal: str, value) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, ordinal).alias("latest"))


def hash_pool(rows: DataFrame, by: list, order: list, cap: int) -> DataFrame:
    return rows.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ).where(F.col("_n") <= cap).drop("_n")
