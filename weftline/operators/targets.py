"""The place of each query's target, the nearest row of its label, among all rows; exact.

Blocks of queries meet blocks of rows twice: first rows of the query's own label only, for the
targets, then all rows, to count what comes before them. A matrix product of single precision
tells nearly all pairs apart; those within the bound of its error, and pairs with a missing,
non-finite or very large component, are computed one by one, summed and rounded as SQL does.
The pairs grow with queries times rows; memory is bounded by two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of a block, queries and rows of one product, pairs that are computed one by one at once.
CELLS, STEP, WIDE, PAIRS = 1 << 22, 256, 2048, 1 << 14
#: Of so many pairs one has to be asked for, so that a product of all is cheaper.
MANY = 32
#: Larger components don't go through the product; half of what two distances of equal digits may differ, with room.
FAR, HALF = 1e12, 0.3e-6
#: Distances travel as their bits, which have their order; then those that are no number, then missing ones.
INF, NAN, NONE = 0x7FF0 << 48, 0x7FF8 << 48, (1 << 63) - 1
#: Types of components, and the bits of a missing one in each: no number, told apart from all others.
KINDS = {"float": (np.float32, np.int32, 0x7FC00001), "double": (np.float64, np.int64, NAN + 1)}


def _as_bytes(kind: str):
    """Mapper: each vector v as bytes, so that rows are copied and not converted wherever they meet."""
    real, whole, missing = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, size = v.flatten(), np.diff(v.offsets.to_numpy())
            size[v.is_null().to_numpy(zero_copy_only=False)] = 0
            x = np.array(flat.fill_null(0).to_numpy(zero_copy_only=False), real)
            x[np.isnan(x)] = np.nan
            x.view(whole)[flat.is_null().to_numpy(zero_copy_only=False)] = missing
            ends = np.concatenate([[0], size.cumsum() * x.itemsize]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            yield batch.set_column(batch.schema.get_field_index("v"), "v", packed)

    return run


def _packed(names: list[str], prefix: str, kind: str):
    """Mapper: the rows of a part as blocks of at most CELLS components, each column packed.

    All rows are as wide as the widest; what they don't have is missing.
    """
    _, whole, missing = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        flat = [np.frombuffer(v, whole) for c in table.column("v").chunks for v in [b"".join(c.to_pylist())]]
        size = pc.binary_length(table.column("v")).to_numpy() // np.dtype(whole).itemsize
        x = np.full((len(size), max(1, size.max())), missing, whole)
        x[np.arange(x.shape[1]) < size[:, None]] = np.concatenate(flat)
        columns = {n: table.column(n).to_numpy() for n in names} | {"v": x}
        step = max(1, CELLS // x.shape[1])
        for at in range(0, len(x), step):
            yield pa.RecordBatch.from_pydict(
                {prefix + n: pa.array([c[at:at + step].tobytes()], pa.binary()) for n, c in columns.items()}
            )

    return run


def _blocks(rows: DataFrame, prefix: str, parts: int, kind: str) -> DataFrame:
    names = [n for n in rows.columns if n != "v"]
    packed = ", ".join(f"{prefix}{n} binary" for n in (*names, "v"))
    return rows.repartition(parts).mapInArrow(_packed(names, prefix, kind), packed)


def _parts(rows: DataFrame) -> int:
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return max(1, math.ceil(n * max(1, width or 1) / (0.75 * CELLS)))


class _Side:
    """The queries or the rows of a pair of blocks; columns of numbers are attributes."""

    def __init__(self, batch: pa.RecordBatch, at: int, prefix: str, kind: str):
        own = {n.removeprefix(prefix): batch.column(n)[at].as_buffer() for n in batch.schema.names if n.startswith(prefix)}
        self.kind, self.x = kind, np.frombuffer(own.pop("v"), KINDS[kind][0])
        self.__dict__ |= {n: np.frombuffer(b, np.int64) for n, b in own.items()}
        self.x = self.x.reshape(len(self.id), -1)

    def widen(self, width: int) -> None:
        real, whole, missing = KINDS[self.kind]
        bits, more = self.x.view(whole), width - self.x.shape[1]
        if more:
            bits = np.pad(bits, ((0, 0), (0, more)), constant_values=missing)
        self.x, self.lacks = bits.view(real), bits == missing
        self.odd = ~(np.abs(self.x).max(axis=1) < FAR)
        self.plain = np.where(self.odd[:, None], real(0), self.x)
        self.square = np.einsum("ij,ij->i", self.plain, self.plain, dtype=np.float64)


def _pairs(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[_Side, _Side]]:
    for batch in batches:
        for at in range(batch.num_rows):
            q, r = _Side(batch, at, "q_", kind), _Side(batch, at, "r_", kind)
            for side in (q, r):
                side.widen(max(q.x.shape[1], r.x.shape[1]))
            yield q, r


def _room(q: _Side, r: _Side, limit: np.ndarray | float = 0.0) -> np.ndarray:
    """How far x.y - y.y / 2 - limit of single precision may be off, for each query; and HALF."""
    most = math.sqrt(r.square.max())
    return (q.x.shape[1] + 16) * 2.0**-24 * (np.sqrt(q.square) * most + most * most / 2 + np.abs(limit)) + HALF


def _wide(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """x and further columns, in single precision."""
    out = np.empty((len(x), x.shape[1] + len(more)), np.float32)
    out[:, :x.shape[1]] = x
    for at, column in enumerate(more, x.shape[1]):
        out[:, at] = column
    return out


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal numbers."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(len(i)) + np.repeat(low - (np.cumsum(n) - n), n)]


def _single_keys(q: _Side, r: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        a, b = i[at:at + PAIRS], j[at:at + PAIRS]
        with np.errstate(invalid="ignore", over="ignore"):
            lacks, d = q.lacks[a] | r.lacks[b], q.x[a].astype(np.float64) - r.x[b]
            d *= d
            d[lacks] = 0
            d = d.cumsum(axis=1)[:, -1]  # one after the other
            y = d * 1e6
            near = (np.floor(y) + (y - np.floor(y) >= 0.5)) / 1e6
        d = np.where(np.isfinite(near), near, d)
        out[at:at + PAIRS] = np.where(lacks.all(axis=1), NONE, np.where(np.isnan(d), NAN, d.view(np.int64)))
    return out


def _keys(q: _Side, r: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs over the components that both have, to six digits, as bits.

    Where they are many of all pairs of their rows, as among copies, a product of double precision
    tells most; those that it leaves near the middle of two roundings are computed one by one.
    """
    asks, rows = (np.flatnonzero(np.bincount(x)) for x in (i, j))
    if MANY * len(i) < len(asks) * len(rows) or q.odd[asks].any() or r.odd[rows].any():
        return _single_keys(q, r, i, j)
    square = q.square[i] + r.square[j]
    both = q.plain[asks].astype(np.float64) @ r.plain[rows].astype(np.float64).T
    y = (square - 2 * both[np.searchsorted(asks, i), np.searchsorted(rows, j)]) * 1e6
    low = np.floor(y)
    key = ((low + (y - low >= 0.5)) / 1e6).view(np.int64)
    left = np.flatnonzero(np.abs(y - low - 0.5) <= (q.x.shape[1] + 8) * 2.0**-51 * 1e6 * square)
    key[left] = _single_keys(q, r, i[left], j[left])
    return key


def _odd_pairs(q: _Side, r: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs that the product leaves out."""
    every, plain = np.arange(len(r.id)), np.flatnonzero(~q.odd)
    for i in np.flatnonzero(q.odd):
        yield np.full(len(every), i), every
    for j in np.flatnonzero(r.odd):
        yield plain, np.full(len(plain), j)


def _candidates(q: _Side, r: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one label among which is the nearest row of each query."""
    ask, rows, room = _wide(q.plain, np.ones(len(q.id))), _wide(r.plain, -r.square / 2), _room(q, r)
    named = r.named > 0
    for label in np.intersect1d(q.label[~q.odd], r.label[named & ~r.odd]):
        some, j = np.flatnonzero((q.label == label) & ~q.odd), np.flatnonzero((r.label == label) & named & ~r.odd)
        other = np.ascontiguousarray(rows[j].T)
        step = max(1, STEP * WIDE // len(j))
        for i in (some[at:at + step] for at in range(0, len(some), step)):
            near = ask[i] @ other
            near[_same(q.id[i], r.id[j])] = -np.inf
            a, b = _where(near >= (near.max(axis=1) - 2 * room[i]).astype(np.float32)[:, None])
            yield i[a], j[b]
    for i, j in _odd_pairs(q, r):
        own = named[j] & (q.label[i] == r.label[j])
        yield i[own], j[own]


def _targets(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for q, r in _pairs(batches, kind):
        found = []
        for i, j in _candidates(q, r):
            i, j = (x[q.id[i] != r.id[j]] for x in (i, j))
            key = _keys(q, r, i, j)
            order = np.lexsort((r.id[j], key, i))
            i, j, key = i[order], j[order], key[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            found.append((q.id[i[first]], key[first], r.id[j[first]]))
        if found:
            ids, keys, targets = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "limit": pa.array(keys), "target": pa.array(targets)})


def _wins(q: _Side, r: _Side) -> np.ndarray:
    """How many rows of the block come before each query's target."""
    limit = np.where(q.limit < INF, np.minimum(q.limit, INF).view(np.float64), np.inf)
    limit = np.clip((q.square - limit) / 2, -1e30, 1e30)
    room = _room(q, r, limit)
    ask = _wide(q.plain, np.ones(len(q.id)), room - limit)
    rows = _wide(r.plain, np.where(r.odd, -1e35, -r.square / 2), np.ones(len(r.id)))
    sides = [np.ascontiguousarray(rows[at:at + WIDE].T) for at in range(0, len(rows), WIDE)]
    sure, wins, plain = (2 * room).astype(np.float32), np.zeros(len(q.id), np.int64), np.flatnonzero(~q.odd)

    def compared(i: np.ndarray, j: np.ndarray) -> None:
        key = _keys(q, r, i, j)
        before = (key < q.limit[i]) | (key == q.limit[i]) & (r.id[j] < q.target[i])
        wins[:] += np.bincount(i[before & (q.id[i] != r.id[j])], minlength=len(wins))

    for part in (plain[at:at + STEP] for at in range(0, len(plain), STEP)):
        some = ask[part]
        for at, side in zip(range(0, len(rows), WIDE), sides, strict=True):
            ahead = some @ side
            a, b = _where(ahead > 0)
            i, j, far = part[a], at + b, ahead[a, b] > sure[part[a]]
            wins += np.bincount(i[far & (q.id[i] != r.id[j])], minlength=len(wins))
            compared(i[~far], j[~far])
    for i, j in _odd_pairs(q, r):
        compared(i, j)
    return wins


def _counted(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for q, r in _pairs(batches, kind):
        others = len(r.id) - np.bincount(_same(q.id, r.id)[0], minlength=len(q.id))
        yield pa.RecordBatch.from_pydict({"id": pa.array(q.id), "wins": pa.array(_wins(q, r)), "others": pa.array(others)})


def nearest_target_ranks(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, rank, candidates: the place of the nearest row of the query's label among all rows.

    queries: query_id, q, label; rows: id, v, label (labels are whole numbers, ids are distinct).
    By squared distance to six digits, ties by id; a row isn't among its own query's. Components
    that either side lacks don't count, without any a distance is missing and comes last; a query
    without a label, or without another row of it, has no rank.
    """
    long = lambda c: F.col(c).cast("long")
    ask = queries.where("query_id is not null and label is not null").select(
        long("query_id").alias("id"), long("label").alias("label"), F.col("q").alias("v")
    )
    other = rows.where("id is not null").select(
        long("id").alias("id"),
        F.coalesce(long("label"), F.lit(0).cast("long")).alias("label"),
        F.col("label").isNotNull().cast("long").alias("named"),
        "v"
    )
    kind = "float" if all(df.schema["v"].dataType.elementType.typeName() == "float" for df in (ask, other)) else "double"
    parts, sides = [], []
    for df in (ask, other):
        parts.append(_parts(df))
        names = ", ".join(f"{n} {'binary' if n == 'v' else 'long'}" for n in df.columns)
        sides.append(df.withColumn("v", F.col("v").cast(f"array<{kind}>")).mapInArrow(_as_bytes(kind), names))
    ask, other = sides
    met = _blocks(other, "r_", parts[1], kind).hint("shuffle_replicate_nl")  # neither side is ever gathered
    found = met.crossJoin(_blocks(ask, "q_", parts[0], kind)).mapInArrow(
        partial(_targets, kind=kind), "id long, limit long, target long"
    )
    best = found.groupBy("id").agg(F.min(F.struct("limit", "target")).alias("t")).select("id", "t.limit", "t.target")
    known = ask.drop("label").join(best, "id")
    counted = met.crossJoin(_blocks(known, "q_", parts[0], kind)).mapInArrow(
        partial(_counted, kind=kind), "id long, wins long, others long"
    )
    return counted.groupBy(F.col("id").alias("query_id")).agg(
        (F.sum("wins") + 1).cast("int").alias("rank"), F.sum("others").alias("candidates")
    )
