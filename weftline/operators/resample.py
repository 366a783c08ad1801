"""Bootstrap intervals, and reports on the geometry of vectors.

Intervals are sums per round that executors add up; geometry needs only the d x d sums of
products, whose eigenvalues are taken on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ordered import numbered


def bootstrap_ci(df: DataFrame, by: str, value: str, rounds: int = 1000, seed: int = 0, strata: int = 64) -> DataFrame:
    """by, mean, low, high: percentile interval of the mean by a Poisson bootstrap.

    Each task-sized stratum draws its rows' Poisson weights and keeps two sums per round, so
    no method is gathered in one place; equal seeds give equal intervals.
    """

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        rng = np.random.default_rng([seed, int(pdf["stratum"].iloc[0])])
        total, weight = np.zeros(rounds), np.zeros(rounds)
        x = pdf[value].to_numpy(float)
        for at in range(0, len(x), 4096):
            w = rng.poisson(1.0, (rounds, len(x[at : at + 4096])))
            total += w @ x[at : at + 4096]
            weight += w.sum(axis=1)
        return pd.DataFrame(
            {
                by: pdf[by].iloc[0],
                "round": np.arange(rounds),
                "total": total,
                "weight": weight,
                "x": x.sum() / rounds,
                "n": len(x) / rounds
            }
        )

    dealt = df.select(by, value, F.xxhash64(*df.columns).alias("h")).withColumn(
        "stratum", F.pmod("h", F.lit(strata)).cast("int")
    )
    kind = dict(df.dtypes)[by]
    each = dealt.groupBy(by, "stratum").applyInPandas(
        sums, f"{by} {kind}, round int, total double, weight double, x double, n double"
    )
    means = each.groupBy(by, "round").agg(
        (F.sum("total") / F.sum("weight")).alias("m"), F.sum("x").alias("x"), F.sum("n").alias("n")
    )
    return means.groupBy(by).agg(
        (F.sum("x") / F.sum("n")).alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")
    )


def effective_rank(vectors: DataFrame, vector: str = "v") -> DataFrame:
    """n, effective_rank, rank_ratio: exp of the entropy of the covariance's eigenvalues."""

    def partial(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf[vector].tolist(), float)
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    parts = vectors.select(vector).mapInPandas(partial, "n long, s array<double>, q array<double>")
    total = lambda c: parts.select(
        F.posexplode(c).alias("i", "x")
    ).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    n = parts.agg(F.sum("n")).first()[0] or 0
    spark = vectors.sparkSession
    if n < 2:
        return spark.createDataFrame([(n, None, None)], "n long, effective_rank double, rank_ratio double")
    s, q = total("s"), total("q")
    d = len(s)
    values = np.clip(np.linalg.eigvalsh(q.reshape(d, d) / n - np.outer(s / n, s / n)), 0, None)
    p = values[values > 0] / values.sum() if values.sum() > 0 else np.ones(1)
    rank = float(np.exp(-(p * np.log(p)).sum()))
    return spark.createDataFrame([(n, round(rank, 6), round(rank / d, 6))], "n long, effective_rank double, rank_ratio double")


# The linear congruential generator of the exact streams.
LCG_FACTOR, LCG_STEP, LCG_MODULUS = 1103515245, 12345, 2**31
#: Draws that one task makes.
DRAWS = 1 << 20
#: Fewer tasks than this have no interval.
LEAST_TASKS = 20


def lcg_start(seed: int) -> int:
    import hashlib

    return int(hashlib.sha256(str(seed).encode()).hexdigest()[:16], 16) % LCG_MODULUS


def lcg_jump(steps: int) -> tuple[int, int]:
    """(factor, step) of so many steps at once, by doubling: state -> factor * state + step."""
    factor, step = 1, 0
    one, add = LCG_FACTOR, LCG_STEP
    while steps:
        if steps & 1:
            factor, step = factor * one % LCG_MODULUS, (step * one + add) % LCG_MODULUS
        one, add = one * one % LCG_MODULUS, (add * one + add) % LCG_MODULUS
        steps >>= 1
    return factor, step


def lcg_states(start: int, first: int, count: int) -> np.ndarray:
    """States number first + 1, first + 2, ... of the stream that starts at a state.

    One jump to the first of them; then what is there is doubled by jumping over its length.
    """
    factor, step = lcg_jump(first + 1)
    states = np.empty(count, np.uint64)
    if count:
        states[0] = (factor * start + step) % LCG_MODULUS
    have = min(1, count)
    while have < count:
        factor, step = lcg_jump(have)
        some = min(have, count - have)
        states[have : have + some] = (states[:some] * np.uint64(factor) + np.uint64(step)) % np.uint64(LCG_MODULUS)
        have += some
    return states.astype(np.int64)


def lcg_choices(seed: int, n: int, count: int) -> list[int]:
    """Rows that a linear congruential generator draws from n, one after the other."""
    return (lcg_states(lcg_start(seed), 0, count) % n).tolist()


def drawn_rows(spark: SparkSession, n: int, rounds: int, seed: int) -> DataFrame:
    """round, row, times: rounds of n draws each from n rows, one exact stream over all rounds.

    Each task jumps to its own stretch of the stream and counts what is drawn there.
    """
    total, start = rounds * n, lcg_start(seed)

    def draw(batches):
        for batch in batches:
            for first in batch.column("id").to_pylist():
                at = np.arange(first, min(first + DRAWS, total))
                key = at // n * n + lcg_states(start, first, len(at)) % n
                key, times = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_pydict({"round": pa.array(key // n), "row": pa.array(key % n), "times": pa.array(times)})

    tasks = -(-total // DRAWS)
    return spark.range(0, total, DRAWS, max(1, min(tasks, 10_000))).mapInArrow(draw, "round long, row long, times long")


def lift_intervals(
    df: DataFrame, task: str, method: str, baselines: list[str], values: list[str], rounds: int = 1000, seed: int = 0
) -> DataFrame:
    """baseline, metric, tasks, lift, low, high: how far a method's means are above each baseline's.

    df: task, method and values, a row for each task and method; tasks that lack one are left out.
    Intervals are exact percentiles of resampled means: tasks in the order of their key, rows drawn
    by the stream of the seed, round after round. Fewer than LEAST_TASKS tasks, or no rounds, give
    nulls.
    """
    wide = df.where(F.col("method").isin(method, *baselines)).groupBy(task).pivot("method", [method, *baselines]).agg(F.first(F.struct(*values)))
    wide = wide.na.drop()
    names = [(b, v) for b in baselines for v in values]
    lifts = F.array(*((F.col(f"`{method}`.`{v}`") - F.col(f"`{b}`.`{v}`")).cast("double") for b, v in names))
    rows = numbered(wide.select(F.col(task), lifts.alias("x")), task, name="row")
    n = rows.count()
    spark = df.sparkSession
    means = rows.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))))
    if n >= LEAST_TASKS and rounds > 0:
        # the planner takes the draws for as few as the tasks that make them: without the hint it would broadcast them
        sums = drawn_rows(spark, n, rounds, seed).join(rows.select("row", "x").hint("shuffle_hash"), "row").groupBy("round").agg(
            *(F.sum(F.col("times") * F.col("x")[i]).alias(f"s{i}") for i in range(len(names)))
        )
        low, high = int(0.025 * (rounds - 1)), min(rounds - 1, math.ceil(0.975 * (rounds - 1)))
        ordered = [F.sort_array(F.collect_list(F.col(f"s{i}") / n)) for i in range(len(names))]  # a number for each round
        ends = sums.agg(*(F.struct(F.get(o, F.lit(low)).alias("low"), F.get(o, F.lit(high)).alias("high")).alias(f"e{i}") for i, o in enumerate(ordered)))
    else:
        none = F.lit(None).cast("double")
        ends = spark.range(1).select(*(F.struct(none.alias("low"), none.alias("high")).alias(f"e{i}") for i in range(len(names))))
    stack = F.array(
        *(
            F.struct(F.lit(b).alias("baseline"), F.lit(v).alias("metric"), F.col(f"m{i}").alias("lift"), F.col(f"e{i}.low").alias("low"), F.col(f"e{i}.high").alias("high"))
            for i, (b, v) in enumerate(names)
        )
    )
    found = means.crossJoin(ends).select(F.explode(stack).alias("r"))  # one row each
    return found.select("r.baseline", "r.metric", F.lit(n).cast("long").alias("tasks"), "r.lift", "r.low", "r.high")


def paired_lift_ci(
    df: DataFrame, method: str, baselines: list[str], value: str, rounds: int = 1000, seed: int = 0
) -> DataFrame:
    """baseline, lift, low, high of one value, by :func:`lift_intervals`; df: task, method, value."""
    return lift_intervals(df, "task", method, baselines, [value], rounds, seed).select("baseline", "lift", "low", "high")


def _sums(vectors: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products) of all vectors: d + d * d numbers reach the driver."""

    def partial(batches):
        n, s, q = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf[vector].tolist(), float)
                n, s, q = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            yield pd.DataFrame({"i": np.arange(1 + s.size + q.size), "x": np.concatenate(([n], s, q.ravel()))})

    found = vectors.select(vector).mapInPandas(
        partial, "i int, x double"
    ).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    if not len(found):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(round((-1 + (1 + 4 * (len(found) - 1)) ** 0.5) / 2))
    return int(found[0]), found[1 : 1 + d], found[1 + d :].reshape(d, d)


def collapse_report(vectors: DataFrame, vector: str = "v", ident: str | None = None) -> DataFrame:
    """One row: variances (least, median, largest), effective rank and its ratio, mean cosine, mean norm.

    With the column of row ids the entropy of nearest neighbours too, by the join of all rows.
    """
    from .allnearest import nearest_rows, neighbour_entropy
    from .latents import mean_pair_cosine

    n, s, q = _sums(vectors, vector)
    spark = vectors.sparkSession
    schema = (
        "n long, per_dim_variance_min double, per_dim_variance_median double, per_dim_variance_max double, effective_rank "
        "double, effective_rank_ratio double, mean_cosine double, mean_norm double"
    )
    if n < 2:
        row = (n, *[None] * 7)
    else:
        covariance = q / n - np.outer(s / n, s / n)
        variance = np.clip(np.diag(covariance), 0, None)
        values = np.clip(np.linalg.eigvalsh(covariance), 0, None)
        p = values[values > 0] / values.sum() if values.sum() > 0 else np.ones(1)
        rank = float(np.exp(-(p * np.log(p)).sum()))
        norm = vectors.agg(F.avg(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
        cosine = mean_pair_cosine(vectors.select(F.col(vector).alias("v"))).first()[0]
        spread = (float(variance.min()), float(np.median(variance)), float(variance.max()))
        row = (n, *spread, rank, rank / len(s), float(cosine), float(norm))
    report = spark.createDataFrame([row], schema)
    if ident is None:
        return report
    return report.crossJoin(neighbour_entropy(nearest_rows(vectors, ident, vector)))  # one row each


def latent_matrix(vectors: DataFrame, vector: str = "v", top: int = 16) -> DataFrame:
    """dim, mean, variance, std of the dimensions with most variance, by falling sample variance."""
    n, s, q = _sums(vectors, vector)
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "dim int, mean double, variance double, std double")
    mean = s / n
    variance = np.clip((np.diag(q) - n * mean * mean) / (n - 1), 0, None)
    order = np.lexsort((np.arange(len(s)), -np.round(variance, 12)))[:top]
    rows = [(int(i), float(mean[i]), float(variance[i]), float(variance[i] ** 0.5)) for i in order]
    return vectors.sparkSession.createDataFrame(rows, "dim int, mean double, variance double, std double")


def correlations(vectors: DataFrame, vector: str = "v") -> DataFrame:
    """a, b, correlation of all dimensions a < b; 0 where one doesn't vary."""
    n, s, q = _sums(vectors, vector)
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "a int, b int, correlation double")
    covariance = (q - np.outer(s, s) / n) / (n - 1)
    std = np.sqrt(np.clip(np.diag(covariance), 0, None))
    both = np.outer(std, std)
    r = np.divide(covariance, both, out=np.zeros_like(covariance), where=both > 1e-15)
    rows = [(i, j, float(r[i, j])) for i in range(len(s)) for j in range(i + 1, len(s))]  # d * d / 2 rows
    return vectors.sparkSession.createDataFrame(rows, "a int, b int, correlation double")
