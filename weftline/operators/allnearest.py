"""The nearest other row of every row, by cosine: an exact join pruned by pivots.

Rows become unit vectors, so the largest cosine is the smallest distance. Each distinct vector
belongs to the cell of its nearest pivot; a cell's rows are packed in blocks. Within its block a
row finds a first neighbour, and with that distance it visits only cells that can hold a nearer
one, by two bounds from the triangle inequality: the plane between two pivots, and the ring of
distances to the pivot that a cell fills. Visits are sent to groups of
blocks, so a large cell is many keys and a visiting row is sent once for some blocks. Copies of a vector never meet as rows: they know their neighbour from their group.

How much the bounds save depends on the vectors: where they cluster a row visits few cells, where
they don't (many independent dimensions) most blocks meet, each pair of blocks in a step of its
own. Memory is bounded by two blocks in any case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of a block, and the most pivots (their vectors go to every task).
BLOCK, PIVOTS = 2048, 256
#: Blocks that a visit meets at once: the rows of a visit are sent once for all of them.
GROUP = 16
#: Distances are compared with this room for rounding; similarities are told apart by 9 digits.
ROOM = 1e-7
DIGITS = 9


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unpack(vectors: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(vectors).reshape(rows, -1)


def _placed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = _matrix(batch.column("u")) @ pivots.T
        cell = near.argmax(axis=1) if len(near) else np.zeros(0, np.int64)
        gap = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(cell)), cell], 0))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], [*batch.schema.names, "cell", "gap"]
        )


def _best(rows: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, id) of each row's nearest of the others: the smallest id of equal similarities."""
    both = rows @ others.T
    both[ids[:, None] == other_ids[None]] = -np.inf
    most = both.max(axis=1)
    i, j = np.nonzero(both >= (most - 2 * 10.0**-DIGITS)[:, None])
    value = np.round(both[i, j], DIGITS)
    order = np.lexsort((other_ids[j], -value, i))
    i, j, value = i[order], j[order], value[order]
    _, first = np.unique(i, return_index=True)
    return value[first], other_ids[j[first]]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (cell, part) as one row for each, with a first neighbour within it."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("id").to_numpy()
        rows = _matrix(table.column("u").combine_chunks())
        most, near = _best(rows, ids, rows, ids) if len(ids) > 1 else (np.full(1, -np.inf), np.full(1, -1))
        return pa.RecordBatch.from_pydict(
            {
                "cell": table.column("cell").slice(0, 1).combine_chunks(),
                "part": table.column("part").slice(0, 1).combine_chunks(),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "asks": pa.array([table.column("asks").to_numpy().tobytes()], pa.binary()),
                "most": pa.array([most.tobytes()], pa.binary()),
                "near": pa.array([near.astype(np.int64).tobytes()], pa.binary()),
                "rows": pa.array([rows.astype(np.float64).tobytes()], pa.binary()),
            }
        )

    key = None
    for batch in batches:
        cell, part = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
        borders = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
        for start, stop in zip([0, *borders], [*borders, len(cell)], strict=True):
            if start == stop:
                continue
            if held and key != (cell[start], part[start]):
                yield block()
                held.clear()
            key = (cell[start], part[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield block()


_BLOCK = "cell int, part int, ids binary, asks binary, most binary, near binary, rows binary"


def _visits(
    batches: Iterator[pa.RecordBatch], pivots: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The rows of a block that some cell may hold a nearer neighbour for, for each group of blocks.

    Blocks are numbered through all cells; [first, last] are those of a cell, GROUP of them a group.
    """
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    for batch in batches:
        for row in batch.to_pylist():
            ids, asks, most = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["asks"], np.int8), np.frombuffer(row["most"])
            rows = _unpack(row["rows"], len(ids))
            least = np.maximum(most, -1) - 2 * 10.0**-DIGITS  # ties after rounding count too
            reach = np.sqrt(np.maximum(2 - 2 * least, 0)) + ROOM
            gap = np.sqrt(np.maximum(2 - 2 * rows @ pivots.T, 0))
            own = gap[:, row["cell"]]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between[row["cell"]] > 0, (gap**2 - own[:, None] ** 2) / (2 * between[row["cell"]]), 0)
            open_ = (plane <= reach[:, None]) & (gap - reach[:, None] <= high) & (gap + reach[:, None] >= low) & (asks[:, None] > 0)
            cells = np.flatnonzero(open_.any(axis=0))
            groups: dict[int, list[int]] = {}
            for cell in cells.tolist():
                for group in range(int(first[cell]) // GROUP, int(last[cell]) // GROUP + 1):
                    groups.setdefault(group, []).append(cell)
            for group, members in groups.items():
                some = open_[:, members].any(axis=1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "group": pa.array([group], pa.int64()),
                        "cells": pa.array([members], pa.list_(pa.int32())),
                        "own": pa.array([row["block"]], pa.int64()),
                        "ask_ids": pa.array([ids[some].tobytes()], pa.binary()),
                        "ask_most": pa.array([most[some].tobytes()], pa.binary()),
                        "ask_rows": pa.array([rows[some].tobytes()], pa.binary()),
                    }
                )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a visited block has that isn't farther than what a row knows from its own."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, asks, known = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("ask_ids", np.int64), ("ask_most", float)))
            most, near = _best(_unpack(row["ask_rows"], len(asks)), asks, _unpack(row["rows"], len(ids)), ids)
            keep = most >= known
            yield _found(asks[keep], near[keep], most[keep])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, near, most = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("near", np.int64), ("most", float)))
            keep = (np.frombuffer(row["asks"], np.int8) > 0) & np.isfinite(most)
            yield _found(ids[keep], near[keep], most[keep])


def _found(ids: np.ndarray, near: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": pa.array(ids), "nearest": pa.array(near), "similarity": pa.array(most)})


_FOUND = "id long, nearest long, similarity double"


def unit_rows(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, u, zero: rows of finite vectors, scaled to length 1 (a zero vector stays zero)."""
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", F.greatest(norm, F.lit(1e-12)))
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm") + F.lit(0.0)).alias("u"), F.forall("v", lambda x: x == 0).alias("zero"))


def nearest_rows(vectors: DataFrame, ident: str, vector: str, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """id, nearest, similarity: for every row the other row of largest cosine, the smallest id of ties.

    Similarities are rounded to DIGITS; that of a zero vector with any other is 0. Ids are taken to
    be distinct; rows with a null id or a null or non-finite component take no part, and a single
    row has no neighbour. pivots: how many cells (by default one for each block of distinct
    vectors, at most PIVOTS).
    """
    rows = unit_rows(vectors, ident, vector).withColumn("k", F.struct(F.xxhash64("u").alias("a"), F.xxhash64(F.lit(1), "u").alias("b")))
    rows = stored(rows, "unit-rows")
    classes = rows.groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    known = rows.join(classes.where("n > 1"), "k").select("id", "first", "zero").where("not zero")
    copies = known.where("id <> first").select("id", F.col("first").alias("nearest"), F.lit(1.0).alias("similarity"))
    seconds = known.where("id <> first").groupBy(F.col("first").alias("id")).agg(F.min("id").alias("nearest"))
    copies = copies.unionByName(seconds.withColumn("similarity", F.lit(1.0)))

    alone = rows.where("not zero").join(classes.withColumnRenamed("first", "id"), ["k", "id"])
    alone = stored(alone.select("id", "u", (F.col("n") == 1).cast("tinyint").alias("asks")), "distinct-rows")
    zero = rows.where("zero")
    count = alone.count()
    found = copies
    if count:
        pivots = pivots or min(PIVOTS, math.ceil(count / block))
        center = alone.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(pivots).select("u").collect()  # bounded by PIVOTS
        center = np.array([r.u for r in center])
        placed = stored(alone.mapInArrow(partial(_placed, pivots=center), alone.schema.simpleString()[7:-1].replace(":", " ") + ", cell int, gap double"), "placed-rows")
        shape = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).orderBy("cell").collect()
        low, high = np.full(len(center), np.inf), np.full(len(center), -np.inf)
        first, last, number = np.zeros(len(center), np.int64), np.full(len(center), -1), 0
        for r in shape:  # a row for each pivot
            low[r.cell], high[r.cell] = r.low, r.high
            first[r.cell], number = number, number + math.ceil(r.n / block)
            last[r.cell] = number - 1
        by_cell = lambda xs: F.element_at(F.array(*(F.lit(int(x)) for x in xs)), F.col("cell") + 1)
        blocks_of = by_cell(last - first + 1)
        dealt = placed.withColumn("part", F.pmod(F.xxhash64("id"), blocks_of).cast("int"))
        packed = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_packed, _BLOCK)
        numbered = packed.withColumn("block", by_cell(first).cast("long") + F.col("part"))
        blocks = stored(numbered.withColumn("group", F.expr(f"block div {GROUP}")), "row-blocks")
        visits = blocks.select("cell", "block", "ids", "asks", "most", "rows").mapInArrow(
            partial(_visits, pivots=center, low=low, high=high, first=first, last=last),
            "group long, cells array<int>, own long, ask_ids binary, ask_most binary, ask_rows binary",
        )
        # a visit goes to a group once, and meets its blocks there; a block knows itself
        met = visits.join(blocks.select("group", "block", "cell", "ids", "rows"), "group")
        met = met.where("block <> own and array_contains(cells, cell)")
        met = met.select("ids", "rows", "ask_ids", "ask_most", "ask_rows").mapInArrow(_met, _FOUND)
        found = found.unionByName(met).unionByName(blocks.select("ids", "near", "most", "asks").mapInArrow(_first, _FOUND))
    best = found.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("nearest")).alias("less"))).alias("best"))
    best = best.select("id", (-F.col("best.less")).alias("nearest"), F.col("best.similarity").alias("similarity"))
    return _with_zeros(rows, best, zero)


def _with_zeros(rows: DataFrame, best: DataFrame, zero: DataFrame) -> DataFrame:
    """Zero vectors are at similarity 0 of all: theirs and the others' neighbours with them."""
    least = zero.agg(F.min("id").alias("z")).first()[0]
    if least is None:
        return best
    two = [r.id for r in rows.select("id").orderBy("id").limit(2).collect()]
    if len(two) < 2:
        return best
    own = zero.select("id", F.when(F.col("id") == two[0], two[1]).otherwise(two[0]).alias("nearest"), F.lit(0.0).alias("similarity"))
    every = rows.where("not zero").select("id").join(best, "id", "left")
    nearer = F.col("similarity").isNull() | (F.col("similarity") < 0) | (F.col("similarity") == 0) & (F.col("nearest") > least)
    others = every.select(
        "id", F.when(nearer, least).otherwise(F.col("nearest")).alias("nearest"), F.when(nearer, 0.0).otherwise(F.col("similarity")).alias("similarity")
    )
    return own.unionByName(others)


def neighbour_entropy(nearest: DataFrame) -> DataFrame:
    """One row: nearest_neighbor_entropy of how often rows are some row's nearest; 0 without any."""
    counts = nearest.groupBy("nearest").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # -sum p log p with p = n / N is log N - (sum n log n) / N
    sums = counts.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("x"))
    value = F.when(F.col("all") > 0, F.log("all") - F.col("x") / F.col("all")).otherwise(0.0)
    return sums.select(value.alias("nearest_neighbor_entropy"))
