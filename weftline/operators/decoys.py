"""The first rows of a group that differ from a row in two columns, without a self-join.

All rows of a group look for the first k others in one order, less those of their own column u
(say, the submission) and those of their own column v (the output). A row is of use to somebody
only if for some u and v fewer than k rows before it are neither: all else can be forgotten, and
what is left of two parts can be merged and reduced again. So each group has a short summary,
made in every task and merged once, and a row picks its own from it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds summaries of before it passes them on, and rows that wait in one.
HELD_GROUPS, WAITING = 50_000, 64

Row = tuple[str, str, str, str, str | None]  # order, id, u, v, and a note that is handed on


def summary(rows: list[Row], k: int) -> list[Row]:
    """The rows, in order, that are among the first k for some pair of excluded u and v."""
    kept: list[Row] = []
    own, us, vs = Counter(), Counter(), Counter()
    for row in sorted(rows, key=lambda r: r[:2]):
        u, v = row[2], row[3]
        if own[u, v] >= k:
            continue
        # the fewest rows before it that stay when one other u and one other v are excluded
        fewest = min(
            len(kept) - us[x] - vs[y] + own[x, y] for x in [None, *us] if x != u for y in [None, *vs] if y != v
        ) if len(kept) >= k else 0
        if fewest < k:
            kept.append(row)
            own[u, v] += 1
            us[u] += 1
            vs[v] += 1
    return kept


def _summaries(batches: Iterator[pa.RecordBatch], keys: list[str], k: int) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple, list[Row]] = {}
    schema = None

    def flushed() -> Iterator[pa.RecordBatch]:
        rows = [(*key, *row) for key, members in groups.items() for row in summary(members, k)]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)

    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            members = groups.setdefault(row[: len(keys)], [])
            members.append(row[len(keys) :])
            if len(members) >= WAITING and len(members) % WAITING == 0:
                members[:] = summary(members, k)
        if len(groups) > HELD_GROUPS:
            yield from flushed()
            groups.clear()
    if groups:
        yield from flushed()


def first_unlike(rows: DataFrame, keys: list[str], ident: str, u: str, v: str, note: str, order: Column, k: int) -> DataFrame:
    """keys, first: array of (order, id, u, v, note), the summary of each group.

    Rows with a null key, u or v are in no group. A task makes a summary of what it has of a
    group, so a group of any size is a short list for each task when it is merged.
    """
    slim = rows.select(*keys, order.alias("o"), F.col(ident).alias("id"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(note).alias("note"))
    slim = slim.select(*(F.col(c).cast("string").alias(c) for c in slim.columns)).na.drop(subset=[*keys, "u", "v"])
    if k == 1:  # of rows alike in both columns only the first can be anybody's
        alike = slim.groupBy(*keys, "u", "v").agg(F.min(F.struct("o", "id", "note")).alias("m"))
        slim = alike.select(*keys, "m.o", "m.id", "u", "v", "m.note")
    schema = ", ".join(f"{c} string" for c in slim.columns)
    step = partial(_summaries, keys=keys, k=k)
    parts = slim.mapInArrow(step, schema)
    # rows of a group are together and in the order of groups, so few groups are open at once
    merged = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(step, schema)
    # a group that was passed on half-way has two lists: the picks of both are in what is collected
    return merged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "id", "u", "v", "note"))).alias("first"))


def pick(first: Column, u: Column, v: Column, k: int) -> Column:
    """The first k of a summary that differ in both columns."""
    return F.slice(F.filter(first, lambda x: (x["u"] != u) & (x["v"] != v)), 1, k)
