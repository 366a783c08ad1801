"""Ranks, retrieval and rerank metrics, neighbours and pools."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


#: Queries and rows of a block, and queries whose distances to a block of rows are held at once.
QUERY_BLOCK, ROW_BLOCK, QUERY_STEP = 512, 8192, 64


def _packed(size: int, ident: str):
    """Mapper: blocks of rows, ids and vectors packed; the vectors come last, as v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                ids = np.asarray(some.column(ident)).tobytes()
                flat = np.asarray(some.column("v").flatten(), np.float64)
                yield pa.RecordBatch.from_pydict({ident: pa.array([ids], pa.binary()), "v": pa.array([flat.tobytes()], pa.binary())})

    return run


def _block_pairs(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each block of queries (query_id, v) and block of rows (id, v), packed.

    Each pair of blocks is one step of some task, so neither side is ever gathered.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "v").mapInArrow(
        _packed(QUERY_BLOCK, "query_id"), "query_id binary, v binary"
    ).withColumnRenamed("v", "q")
    r = rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(_packed(ROW_BLOCK, "id"), "id binary, v binary")
    return r.crossJoin(q)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of ``QUERY_STEP`` queries and a block of rows at a time.

    Columns are views of the batch: q has a row for each query, v one for each row.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            one = {c: batch.column(c)[i].as_buffer() for c in batch.schema.names}
            ask, ids = np.frombuffer(one["query_id"], np.int64), np.frombuffer(one["id"], np.int64)
            q, v = np.frombuffer(one["q"]).reshape(len(ask), -1), np.frombuffer(one["v"]).reshape(len(ids), -1)
            for at in range(0, len(ask), QUERY_STEP):
                part = slice(at, at + QUERY_STEP)
                yield {"query_id": ask[part], "id": ids, "q": q[part], "v": v}


def _distances(x: np.ndarray, y: np.ndarray, distance: str) -> np.ndarray:
    """Distances of all rows of x and y by a matrix product; near ones are computed anew later."""
    if distance == "l2":
        return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None], 0)
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
    return 1 - np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm > 0)


def nearest(queries: DataFrame, rows: DataFrame, k: int, distance: str = "l2") -> DataFrame:
    """query_id, rank, id, distance: exact neighbours of the queries (query_id, q) among rows (id, v).

    l2 is the squared distance; cosine of a zero vector is 0. Blocks of queries meet blocks of
    rows; each step keeps what its rows may add to a query's k nearest.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _steps(batches):
            ask, ids, q, v = row["query_id"], row["id"], row["q"], row["v"]
            d = _distances(q, v, distance)
            d[ask[:, None] == ids[None]] = np.inf
            keep = min(k, len(ids))
            limit = np.partition(d, keep - 1, axis=1)[:, keep - 1]
            i, j = np.nonzero(d <= (limit + 2e-6)[:, None])  # ties after rounding stay
            i, j = i[np.isfinite(d[i, j])], j[np.isfinite(d[i, j])]
            exact = ((q[i] - v[j]) ** 2).sum(axis=1) if distance == "l2" else d[i, j]
            yield pa.RecordBatch.from_pydict(
                {"query_id": pa.array(ask[i]), "id": pa.array(ids[j]), "distance": pa.array(exact)}
            )

    found = _block_pairs(
        queries.select("query_id", F.col("q").alias("v")), rows
    ).mapInArrow(best, "query_id long, id long, distance double")
    found = found.withColumn("distance", F.round("distance", 6))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def target_ranks(scores: DataFrame) -> DataFrame:
    """query_id, rank, candidates: place of the target by falling score, ties by position."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn(
        "candidates", F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    )
    return ranked.where("target").select("query_id", "rank", "candidates")


def retrieval_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 9)
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        hit(1).alias("r1"),
        hit(5).alias("r5"),
        hit(10).alias("r10"),
        F.round(F.avg(1.0 / F.col("rank")), 9).alias("mrr"),
        F.median("rank").alias("median_rank"),
        F.min("candidates").alias("min_candidates"),
        F.max("candidates").alias("max_candidates")
    )


def claim_gate(metrics: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Deltas of the prediction to each baseline; open only with strictly better R@1 and MRR."""
    base = metrics.where(F.col("method") != prediction)
    own = metrics.where(F.col("method") == prediction).select(F.col("r1").alias("p1"), F.col("mrr").alias("pm"))
    return base.join(F.broadcast(own)).select(
        "method",
        F.round(F.col("p1") - F.col("r1"), 9).alias("delta_r1"),
        F.round(F.col("pm") - F.col("mrr"), 9).alias("delta_mrr"),
        ((F.col("p1") > F.col("r1")) & (F.col("pm") > F.col("mrr"))).alias("gate_open")
    )


def first_passes(rows: DataFrame, problem: str, orders: dict[str, list]) -> DataFrame:
    """problem, method, first_pass (null without one), pool, passes: all orders over one exchange."""
    ranked, rank = rows, lambda m: F.col(f"_{m}")
    for method, order in orders.items():
        ranked = ranked.withColumn(f"_{method}", F.row_number().over(Window.partitionBy(problem).orderBy(*order)))
    firsts = [F.min(F.when(F.col("passed"), rank(m))).alias(f"_{m}") for m in orders]
    each = ranked.groupBy(problem).agg(*firsts, F.count(F.lit(1)).alias("pool"), F.count_if("passed").alias("passes"))
    methods = F.array(*(F.struct(F.lit(m).alias("method"), rank(m).alias("first_pass")) for m in orders))
    return each.select(problem, F.explode(methods).alias("x"), "pool", "passes").select(problem, "x.*", "pool", "passes")


def pass_metrics(firsts: DataFrame, k: int = 3) -> DataFrame:
    """method, problems, pass_at_1, pass_at_k, mrr, mean_first_pass."""
    hit = lambda n: F.round(F.avg(F.when(F.col("first_pass") <= n, 1.0).otherwise(0.0)), 9)
    return firsts.groupBy("method").agg(
        F.count(F.lit(1)).alias("problems"),
        hit(1).alias("pass_at_1"),
        hit(k).alias("pass_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_pass"), F.lit(0.0))), 9).alias("mrr"),
        F.round(F.avg("first_pass"), 9).alias("mean_first_pass"),
    )


def true_rank_half_ties(better: Column, ties: Column) -> Column:
    """1 + better + ties // 2."""
    return 1 + better + F.floor(ties / 2).cast("long")


def rotated(df: DataFrame, key: list, order: list, value: str) -> DataFrame:
    """Each row gets the next row's value within its key, the last the first's."""
    w = Window.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("rotated", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))


def rotated_rows(queries: DataFrame, ident: str, size: str, value: str, seed: str = "0", strata: int = 64) -> DataFrame:
    """Each query gets the value of another query of equal pool size: a shuffled control.

    Within a size, and there within ``strata`` parts by hash so that a common size isn't one
    task, values move on by one in seeded order; a part of one query keeps its own.
    """
    o = T.hash_order(F.col(ident), seed=seed)
    cut = queries.withColumn("_o", o).withColumn(
        "_s", F.pmod(F.conv(F.substring("_o", 1, 4), 16, 10).cast("long"), F.lit(strata))
    )
    return rotated(cut, [size, "_s"], ["_o", ident], value).drop("_o", "_s")
