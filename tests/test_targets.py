"""Ranks of targets: every row is asked, odd rows and ties as in SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weftline import catalogue
from weftline.operators import targets
from weftline.plans import evaluation

FOLDER = "/root/testdata/sf0.001"


def ranks_by_sql(path):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    metrics = c.sql(catalogue.ORACLES["retrieval_metrics"]).fetchall()[0]
    return metrics, sorted(c.sql(evaluation._scores_sql() + " SELECT query_id, rank, candidates FROM ranks").fetchall())


def compared(spark, folder, vectors, labels, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    table = pa.table(
        {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}
    )
    pq.write_table(table, folder / "embeddings.parquet")
    metrics, ranks = ranks_by_sql(folder / "embeddings.parquet")
    assert sorted(tuple(r) for r in evaluation.target_ranks(spark, str(folder)).collect()) == ranks
    assert tuple(catalogue.QUERIES["retrieval_metrics"](spark, str(folder)).first()) == pytest.approx(metrics)
    return ranks


def test_every_row_is_a_query(spark):
    m = catalogue.QUERIES["retrieval_metrics"](spark, FOLDER).first()
    assert m.n == spark.read.parquet(f"{FOLDER}/embeddings.parquet").count() == 500
    assert "%" not in catalogue.ORACLES["retrieval_metrics"] and "id % 50 = 0" in catalogue.ORACLES["rank_targets"]


def test_queries_by_id_that_no_sample_has(spark, tmp_path):
    rng = np.random.default_rng(1)
    got = compared(spark, tmp_path, rng.normal(size=(30, 4)).tolist(), rng.integers(0, 3, 30).tolist(), [50 * i + 7 for i in range(30)])
    assert len(got) == 30


def test_ties_and_halves(spark, tmp_path):
    rng = np.random.default_rng(2)
    some = (rng.integers(-2, 3, (150, 3)) / 16).tolist()  # squares are multiples of 1 / 256: many are equal, many end in a half
    compared(spark, tmp_path, some + [[0.5, 0.25, 0.125]] * 40, rng.integers(0, 4, 190).tolist())


def test_near_copies_and_targets_far_away(spark, tmp_path):
    rng = np.random.default_rng(3)
    near = np.ones(8) + rng.normal(size=(80, 8)) * 3e-4  # distances differ in the last of six digits
    far = rng.normal(size=(40, 8)) * 50
    compared(spark, tmp_path, np.vstack([near, far]).tolist(), [i % 7 for i in range(119)] + [99])


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, nan, inf = rng.normal(size=(60, 5)).tolist(), float("nan"), float("inf")
    rows[3], rows[4], rows[5], rows[6] = None, [], [None] * 5, [None, 1.0, 2.0, None, 0.5]
    rows[7], rows[8], rows[9], rows[10] = [1.0, 2.0], [1.0] * 7, [nan, 0.0, 0.0, 0.0, 0.0], [inf, 0.0, 0.0, 0.0, 0.0]
    rows[11], rows[12], rows[13] = [-inf] * 5, [1e20, 0.0, 0.0, 0.0, 0.0], [1e20, 0.0, 0.0, 0.0, 1.0]
    labels = [int(x) for x in rng.integers(0, 4, 60)]
    labels[3], labels[4], labels[9], labels[14], labels[15], labels[16], labels[17], labels[18] = 7, 7, 8, 8, None, None, 9, 0
    compared(spark, tmp_path, rows, labels, [*range(19), None, *range(20, 60)])


def test_only_odd_rows_or_none(spark, tmp_path):
    compared(spark, tmp_path, [None, [], [float("nan")]] * 3, [1, 1, 1, 2, 2, 2, 3, 3, None])
    pq.write_table(pq.read_table(tmp_path / "embeddings.parquet").slice(0, 0), tmp_path / "embeddings.parquet")
    assert catalogue.QUERIES["retrieval_metrics"](spark, str(tmp_path)).first().n == 0


def test_many_pairs_as_single_ones():
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(20, 4)), rng.integers(-3, 4, (40, 4)) / 16, np.ones((9, 4)), rng.normal(size=(20, 4)) * 1e7])
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(x))), "v": pa.array(x.tolist())})
    one = next(targets._packed(["id"], "r_", "double")(targets._as_bytes("double")(iter([batch]))))
    side = targets._Side(one, 0, "r_", "double")
    side.widen(4)
    i, j = (a.ravel() for a in np.indices((len(x), len(x))))
    assert (targets._keys(side, side, i, j) == targets._single_keys(side, side, i, j)).all()


@pytest.mark.parametrize("cells, step, wide, pairs, many", [(64, 3, 5, 7, 32), (4096, 256, 16, 11, 0), (1, 1, 1, 1, 1), (99, 9, 9, 9, 1 << 40)])
def test_blocks_of_any_size(monkeypatch, cells, step, wide, pairs, many):
    for name, x in (("CELLS", cells), ("STEP", step), ("WIDE", wide), ("PAIRS", pairs), ("MANY", many)):
        monkeypatch.setattr(targets, name, x)
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(70, 6)), rng.integers(0, 3, 70)
    ids = rng.permutation(70)

    def blocks(prefix, **columns):
        batch = pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()} | {"v": pa.array(x.tolist())})
        rows = targets._as_bytes("double")(iter([batch.slice(0, 30), batch.slice(30)]))
        return list(targets._packed(list(columns), prefix, "double")(rows))

    def met(left, right):
        for a in left:
            for b in right:
                yield pa.RecordBatch.from_arrays([*a.columns, *b.columns], [*a.schema.names, *b.schema.names])

    rows = blocks("r_", id=ids, label=label, named=np.ones(70, np.int64))
    best = {}
    for out in targets._targets(met(rows, blocks("q_", id=ids, label=label)), "double"):
        for one in out.to_pylist():
            best[one["id"]] = min(best.get(one["id"], (2**63, 0)), (one["limit"], one["target"]))
    limit, target = (np.array([best[i][k] for i in ids.tolist()]) for k in (0, 1))
    wins, others = np.zeros(70, np.int64), np.zeros(70, np.int64)
    for out in targets._counted(met(rows, blocks("q_", id=ids, limit=limit, target=target)), "double"):
        np.add.at(wins, out["id"].to_numpy(), out["wins"].to_numpy())
        np.add.at(others, out["id"].to_numpy(), out["others"].to_numpy())
    d = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 6)
    for i in range(70):
        order = sorted((j for j in range(70) if j != i), key=lambda j: (d[i, j], ids[j]))
        place = next(k for k, j in enumerate(order) if label[j] == label[i])
        assert (target[i], wins[ids[i]], others[ids[i]]) == (ids[order[place]], place, 69)
