"""Crossed reports against plain counts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import crossed


def test_histograms_by_one_scan(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "x string, y int")
    got = {tuple(r) for r in crossed.histograms(rows, ["x", "y"], {"x": ["a", "z"]}).collect()}
    assert got == {("x", "a", 2), ("x", "missing", 1), ("x", "z", 0), ("y", "1", 2), ("y", "missing", 1)}
    plan = crossed.histograms(rows, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Expand" in plan


def test_loader_report(spark):
    rows = spark.createDataFrame([([1, 2, 3], "ok", True), ([1], "ok", None), ([], "raised", False), (None, None, True)], "ids array<int>, status string, passed boolean")
    got = {tuple(r) for r in crossed.loader_report(rows, {"ids": 1}, ["status", "passed"], {"status": ["timeout"]}).collect()}
    assert got == {
        ("record_count", "", 4), ("truncated_ids", "", 1), ("status_histogram", "ok", 2), ("status_histogram", "raised", 1), ("status_histogram", "missing", 1),
        ("status_histogram", "timeout", 0), ("passed_histogram", "true", 2), ("passed_histogram", "false", 1), ("passed_histogram", "missing", 1),
    }
    assert {tuple(r) for r in crossed.loader_report(rows.limit(0), {"ids": 1}, ["status"]).collect()} == {("record_count", "", 0), ("truncated_ids", "", 0)}


def test_tables_have_every_cell(spark):
    data = [("train", True, "int"), ("train", True, "str"), ("val", False, "int"), ("val", None, None), ("test", True, "int")]
    rows = spark.createDataFrame(data, "split string, passed boolean, kind string")
    tables = {"split_passed": ("split", "passed"), "kind_passed": ("kind", "passed")}
    got = {(r.table, r.row, r.column): r.n for r in crossed.cross_tables(rows, tables).collect()}
    name = lambda x: "missing" if x is None else str(x).lower() if isinstance(x, bool) else x
    want = Counter()
    for split, passed, kind in data:
        want["split_passed", split, name(passed)] += 1
        want["kind_passed", name(kind), name(passed)] += 1
    assert {k: n for k, n in got.items() if n} == want and len(got) == 9 + 9 and got["split_passed", "test", "false"] == 0
    wide = {r.row: (r.true, r.other) for r in crossed.pivoted(crossed.cross_tables(rows, tables), "split_passed", ["true", "other"]).collect()}
    assert wide == {"train": (2, 0), "val": (0, 0), "test": (1, 0)}


@pytest.mark.parametrize(
    ("scores", "kind"),
    [
        ('{"m": 0.5}', "usable"), ('{"m": 3}', "usable"), ('{"m": 1e-3}', "usable"), ('{"m": -2.5, "x": "NaN"}', "usable"), ("{}", "missing"), (None, "missing"), ("{bad", "missing"),
        ('{"m": true}', "invalid"), ('{"m": null}', "invalid"), ('{"m": "0.5"}', "invalid"), ('{"m": [1]}', "invalid"), ('{"m": "NaN"}', "invalid"), ('{"m": {"a": 1}}', "invalid"),
        ('{"m": NaN}', "nonfinite"), ('{"a": 1, "m": -Infinity }', "nonfinite"), ('{"m": Infinity, "a": 1}', "nonfinite"),
    ],
)
def test_kinds_of_scores(spark, scores, kind):
    assert spark.createDataFrame([(scores,)], "s string").select(crossed.score_kind(F.col("s"), "m")).first()[0] == kind


def test_calibration_accounts(spark):
    rows = [
        (1, True, '{"m": 0.9}', "a", "val"), (2, False, '{"m": 0.2}', "a", "val"), (3, True, '{"m": 0.1}', "a", "test"), (4, False, '{"m": NaN}', "b", "val"),
        (5, True, '{"m": 4}', "b", "val"), (6, True, '{"m": "x"}', None, "val"), (7, False, "{}", None, "test"),
    ]
    df = spark.createDataFrame(rows, "row_id int, passed boolean, scores string, benchmark string, split string")
    got = {(r.baseline, r.slice, r.value): r for r in crossed.calibration_report(df, ["m", "n"]).collect()}
    whole = got["m", "overall", ""]
    assert (whole.row_count, whole.usable, whole.positive, whole.negative, whole.missing, whole.invalid, whole.nonfinite) == (7, 4, 3, 1, 1, 1, 1)
    assert whole.roc_auc == pytest.approx(2 / 3) and (whole.tp, whole.fp, whole.status) == (2, 0, "ok")
    p = 1 / (1 + 2.718281828459045**-4)
    assert whole.brier == pytest.approx((0.01 + 0.04 + 0.81 + (p - 1) ** 2) / 4)
    assert got["m", "benchmark", "b"].status == "single_class" and got["m", "benchmark", "b"].roc_auc is None
    assert got["m", "benchmark", "missing"].status == "no_finite_scores" and got["n", "overall", ""].status == "missing"
    assert got["m", "split", "test"].positive == 1 and got["m", "benchmark", "a"].roc_auc == pytest.approx(0.5) and len(got) == 2 * (1 + 3 + 2)
