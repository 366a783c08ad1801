"""Out-of-fold logistic calibration, on sums that executors add up.

Every Newton step is one aggregation over all rows, for all folds at once: the gradient and the
curvature of a fold have as many entries as features allow, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored

FOLDS, STEPS, RIDGE = 5, 12, 1.0


def fold_ids(problems: DataFrame, ident: str, folds: int = FOLDS, seed: str = "0") -> DataFrame:
    """ident, fold: problems dealt round by round in seeded order, so folds differ by one at most.

    The order is cut in 4096 buckets whose sizes tell where each one begins.
    """
    keyed = problems.select(ident).distinct().withColumn(
        "o", T.hash_order(F.col(ident), seed=seed)
    ).withColumn("bucket", F.substring("o", 1, 3))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # 4096 rows at most
    before = sizes.select(
        "bucket",
        F.coalesce(
            F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before")
    )
    place = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("o", ident)) - 1
    return keyed.join(F.broadcast(before), "bucket").select(ident, F.pmod(place, F.lit(folds)).cast("int").alias("fold"))


def standardised(rows: DataFrame, features: list[str], folds: int = FOLDS) -> DataFrame:
    """For each fold left out: the features by mean and deviation of the other folds' rows.

    Adds left_out (0 .. folds - 1) and z (array); rows come once for each fold left out.
    """
    own = rows.groupBy("fold").agg(  # a row for each fold
        F.count(F.lit(1)).alias("n"),
        *(F.sum(f).alias(f"s_{f}") for f in features),
        *(F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features)
    ).collect()
    by = {r["fold"]: r for r in own}
    levels = []
    for left in range(folds):
        rest = [r for f, r in by.items() if f != left]
        n = sum(r["n"] for r in rest) or 1
        mean = [sum(float(r[f"s_{f}"]) for r in rest) / n for f in features]
        std = [
            max(sum(float(r[f"q_{f}"]) for r in rest) / n - m * m, 0.0) ** 0.5 or 1.0 for f,
            m in zip(features, mean, strict=True)
        ]
        z = F.array(*((F.col(f).cast("double") - m) / s for f, m, s in zip(features, mean, std, strict=True)))
        levels.append(F.struct(F.lit(left).alias("left_out"), z.alias("z")))
    return rows.withColumn("x", F.explode(F.array(*levels))).select("*", "x.left_out", "x.z").drop("x")


def out_of_fold(
    rows: DataFrame, features: list[str], label: str, folds: int = FOLDS, ridge: float = RIDGE, steps: int = STEPS
) -> DataFrame:
    """Adds probability: the logistic model of the other folds, for each row's own fold.

    rows has a fold column. L2 on all weights but the bias, features standardised on the other
    folds; the weights are those that minimise the regularised loss. A descent of some hundred
    steps of a fixed length ends near them, so its probabilities differ by what it still lacks.

    The rows are written once, each of them one time, and read for each step, which makes the
    standardised features of all folds from them.
    """
    z = standardised(stored(rows, "folds"), features, folds)
    d = len(features) + 1
    inputs = [F.col("z")[i] for i in range(d - 1)] + [F.lit(1.0)]
    weights = np.zeros((folds, d))

    def score(w: np.ndarray):
        chosen = None
        for left in range(folds):
            total = sum((x * float(c) for x, c in zip(inputs, w[left], strict=True)), F.lit(0.0))
            chosen = F.when(
                F.col("left_out") == left, total
            ) if chosen is None else chosen.when(F.col("left_out") == left, total)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), chosen))))

    train = z.where("fold <> left_out")
    for _ in range(steps):
        error, steep = F.col("p") - F.col(label), F.col("p") * (1 - F.col("p"))
        sums = [F.sum(error * x).alias(f"g{i}") for i, x in enumerate(inputs)]
        sums += [F.sum(steep * inputs[i] * inputs[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        moved = 0.0
        for r in train.withColumn("p", score(weights)).groupBy("left_out").agg(*sums).collect():  # a row for each fold
            w = weights[r["left_out"]]
            gradient = np.array([r[f"g{i}"] for i in range(d)])
            curve = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
            keep = ridge * np.append(np.ones(d - 1), 0)
            step = np.linalg.solve(curve + np.diag(keep) + 1e-9 * np.eye(d), gradient + keep * w)
            w -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    return z.where("fold = left_out").withColumn("probability", score(weights)).drop("left_out", "z")
