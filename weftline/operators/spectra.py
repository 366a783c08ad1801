"""Largest eigenvalues of wide covariances, and dimensions that tell labels apart.

The Gram matrix is summed in square blocks, a few at a time, so a task holds CELLS numbers of it
whatever the vectors' width. Its largest eigenvalues come from a block Krylov space: each step
multiplies a thin matrix by the stored blocks on the executors; only that thin matrix (width times
the number of values and some more) is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Columns of a block, and numbers of the Gram matrix that one pass sums.
SIDE, CELLS = 256, 4 << 20
BLOCK = "i int, j int, n long, cells binary"
#: Rows of a batch that are multiplied at once.
ROWS = 4096


def _products(batches: Iterator[pa.RecordBatch], pairs: list[tuple[int, int]], width: int, side: int) -> Iterator[pa.RecordBatch]:
    """Sums over a task's rows: blocks of products, and with the pair (0, 0) the column sums."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            column = batch.column(0).slice(at, ROWS)
            x = np.asarray(column.flatten(), np.float64).reshape(len(column), width)
            n += len(x)
            for i, j in pairs:
                found = x[:, i * side : (i + 1) * side].T @ x[:, j * side : (j + 1) * side]
                sums[i, j] = sums[i, j] + found if (i, j) in sums else found
            if (0, 0) in pairs:
                sums[-1, -1] = sums.get((-1, -1), 0) + x.sum(axis=0)
    for (i, j), cells in sums.items():
        yield _block(i, j, n if i < 0 else 0, cells)


def _block(i: int, j: int, n: int, cells: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("cells", pa.binary())])
    return pa.RecordBatch.from_pydict({"i": [i], "j": [j], "n": [n], "cells": [cells.tobytes()]}, schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal blocks, which come one after the other: one is held at a time."""
    key, n, cells = None, 0, None
    for batch in batches:
        for row in batch.to_pylist():
            own = np.frombuffer(row["cells"])
            if key == (row["i"], row["j"]):
                n, cells = n + row["n"], cells + own
            else:
                if key is not None:
                    yield _block(*key, n, cells)
                key, n, cells = (row["i"], row["j"]), row["n"], own
    if key is not None:
        yield _block(*key, n, cells)


def gram_blocks(vectors: DataFrame, vector: str, width: int, side: int = SIDE, cells: int = CELLS) -> DataFrame:
    """i, j (j >= i), n, cells: the blocks of the sum of x x', and as (-1, -1) count and sum of rows."""
    count = -(-width // side)
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    per_pass = max(1, cells // (side * side))
    v = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    passes = [v.mapInArrow(partial(_products, pairs=pairs[k : k + per_pass], width=width, side=side), BLOCK) for k in range(0, len(pairs), per_pass)]
    every = reduce(DataFrame.unionByName, passes)
    return every.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_summed, BLOCK)


def _times(batches: Iterator[pa.RecordBatch], q: np.ndarray, side: int) -> Iterator[pa.RecordBatch]:
    """Blocks times a thin matrix: the part of each block row."""
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            i, j = row["i"], row["j"]
            qi, qj = q[i * side : (i + 1) * side], q[j * side : (j + 1) * side]
            cells = np.frombuffer(row["cells"]).reshape(len(qi), len(qj))
            out[i] = out.get(i, 0) + cells @ qj
            if i != j:
                out[j] = out.get(j, 0) + cells.T @ qi
    for i, part in out.items():
        yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})


def top_eigenvalues(vectors: DataFrame, vector: str = "v", top: int = 16, more: int = 8, steps: int = 40, near: float = 1e-10, side: int = SIDE, cells: int = CELLS) -> DataFrame:
    """rank, eigenvalue: the largest eigenvalues of the sample covariance, falling.

    At most the width of the vectors; none for fewer than two rows. Steps go on until no value
    moves by more than its share ``near`` of the largest.
    """
    spark = vectors.sparkSession
    first = vectors.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    width = first[0] if first else 0
    empty = spark.createDataFrame([], "rank int, eigenvalue double")
    if not width:
        return empty
    blocks = stored(gram_blocks(vectors, vector, width, side, cells), "gram")
    head = blocks.where("i < 0").first()
    n, mean = head.n, np.frombuffer(head.cells) / head.n
    if n < 2:
        return empty
    body = blocks.where("i >= 0").select("i", "j", "cells")

    def covariance_times(q: np.ndarray) -> np.ndarray:
        out = np.zeros_like(q)
        for r in body.mapInArrow(partial(_times, q=q, side=side), "i int, part binary").toLocalIterator():  # width times a few columns
            rows = out[r.i * side : (r.i + 1) * side]
            rows += np.frombuffer(r.part).reshape(rows.shape)
        return (out - n * np.outer(mean, mean @ q)) / (n - 1)

    size = min(width, top + more)
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(width, size)))[0]
    basis, images, last = np.zeros((width, 0)), np.zeros((width, 0)), None
    for _ in range(steps):
        image = covariance_times(q)
        basis, images = np.hstack([basis, q]), np.hstack([images, image])
        values = np.sort(np.linalg.eigvalsh((basis.T @ images + images.T @ basis) / 2))[::-1][:top]
        if last is not None and len(values) == len(last) and np.abs(values - last).max() <= near * max(values[0], 1e-300):
            break
        last = values
        rest = image - basis @ (basis.T @ image)
        rest -= basis @ (basis.T @ rest)  # once more, for what rounding left
        left, scale, _ = np.linalg.svd(rest, full_matrices=False)
        q = left[:, scale > 1e-12 * max(scale[0], values[0], 1e-300)][:, : width - basis.shape[1]]
        if not q.shape[1]:
            break
    rows = [(i + 1, float(max(x, 0.0))) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "rank int, eigenvalue double")


def dimension_associations(rows: DataFrame, label: str = "label", by: str | None = None, top: int | None = None) -> DataFrame:
    """(by,) dim, eta_squared, dominant_label, rank: the share of a dimension's squares between labels.

    rows: v, label and by (a split, say). The dominant label has the largest mean, then the larger
    name. Ranks are by falling share, then by dimension; top keeps the first. Rows without a label
    are left out.
    """
    keys = [by] if by else []
    d = rows.where(F.col(label).isNotNull()).select(*keys, F.col(label).cast("string").alias("l"), F.posexplode("v").alias("dim", "x"))
    groups = d.groupBy(*keys, "dim", "l").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    total = groups.groupBy(*keys, "dim").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.col("m")).alias("sum"), F.sum(F.col("n") * F.col("s")).alias("within"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"), F.max_by("l", F.struct("m", "l")).alias("dominant_label"),
    )
    between = F.col("squares") - F.col("sum") * F.col("sum") / F.col("all")
    whole = between + F.col("within")
    eta = F.when(whole <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), between / whole)))
    found = total.select(*keys, "dim", F.round(eta, 9).alias("eta_squared"), "dominant_label")
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = found.withColumn("rank", F.row_number().over(order.orderBy(F.desc("eta_squared"), "dim")))  # a row for each dimension
    return ranked.where(F.col("rank") <= top) if top is not None else ranked


def stable_dimensions(associations: DataFrame, by: str) -> DataFrame:
    """dim: the dimensions that are among the reported ones of every split."""
    splits = associations.agg(F.count_distinct(by).alias("splits"))
    each = associations.groupBy("dim").agg(F.count_distinct(by).alias("n"))
    return each.crossJoin(splits).where("n = splits").select("dim")  # one row
