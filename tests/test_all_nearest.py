"""The nearest other row of every row against the full matrix."""

import numpy as np
import pytest

from weftline.operators import allnearest


def full_matrix(rows):
    """(id, nearest, similarity) by the whole matrix; ids ascending, so the first of ties is the smallest."""
    rows = sorted(r for r in rows if r[1] is not None and np.isfinite([np.nan if x is None else x for x in r[1]]).all())
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    both = np.round(v @ v.T, 9)
    np.fill_diagonal(both, -np.inf)
    at = both.argmax(axis=1)
    return {(int(i), int(ids[j]), float(both[k, j]) + 0.0) for k, (i, j) in enumerate(zip(ids, at, strict=True))} if len(ids) > 1 else set()


def found(spark, rows, **how):
    frame = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None) for i, v in rows], "i long, v array<double>")
    return {(r.id, r.nearest, r.similarity) for r in allnearest.nearest_rows(frame.repartition(3), "i", "v", **how).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_full_matrix(spark, seed):
    rng = np.random.default_rng(seed)
    if seed == 0:  # no clusters
        v = rng.normal(size=(300, 8))
    else:  # clusters, copies, parallel vectors
        v = rng.normal(size=(12, 6))[rng.integers(0, 12, 300)] + rng.normal(size=(300, 6)) * 0.05
        v[50:120] = v[7]
        v[130:140] = v[20:30] * 4
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(300) + 5, v, strict=True)]
    got = found(spark, rows, pivots=9, block=16)
    want = full_matrix(rows)
    assert {x[0] for x in got} == {x[0] for x in want} and len(got) == len(want)
    assert got == want


def test_odd_rows(spark):
    rows = [(1, [0, 0]), (2, [1, 0]), (3, [-1, 0.1]), (4, [0, 0]), (5, None), (6, [float("nan"), 1]), (7, [None, 1.0])]
    assert found(spark, rows) == full_matrix(rows) == {(1, 2, 0.0), (2, 1, 0.0), (3, 1, 0.0), (4, 1, 0.0)}
    assert found(spark, [(1, [1, 2])]) == set() and found(spark, []) == set()
    assert found(spark, [(1, [0, 0])]) == set()
    assert found(spark, [(3, [1, 2]), (2, [1, 2]), (9, [1, 2])]) == {(2, 3, 1.0), (3, 2, 1.0), (9, 2, 1.0)}


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(1)
    centers = np.eye(16)[:16]
    v = np.repeat(centers, 32, axis=0) + rng.normal(size=(512, 16)) * 0.01
    pivots, low, high = centers, np.zeros(16), np.full(16, 0.2)
    import pyarrow as pa

    ids = np.arange(32, dtype=np.int64)
    most, near = allnearest._best(v[:32], ids, v[:32], ids)
    block = {"cell": 0, "block": 0, "ids": ids.tobytes(), "asks": np.ones(32, np.int8).tobytes(), "most": most.tobytes(), "near": near.tobytes(), "rows": v[:32].tobytes()}
    visits = [r for b in allnearest._visits(iter([pa.RecordBatch.from_pylist([block])]), pivots, low, high, np.arange(16), np.arange(16)) for r in b.to_pylist()]
    assert [(r["group"], r["cells"]) for r in visits] == [(0, [0])]


def test_entropy(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 1)], "id long, nearest long")
    p = np.array([0.25, 0.75])
    assert allnearest.neighbour_entropy(pairs).first()[0] == pytest.approx(-(p * np.log(p)).sum())
    assert allnearest.neighbour_entropy(pairs.limit(0)).first()[0] == 0.0
