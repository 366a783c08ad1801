"""Summaries of groups against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import decoys, pools, reports


def firsts(rows, u, v, k):
    return [r for r in sorted(rows, key=lambda r: r[:2]) if r[2] != u and r[3] != v][:k]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_summaries_are_enough_for_every_row(k):
    rng = random.Random(k)
    for _ in range(120):
        kinds = rng.randint(1, 6)
        rows = [(f"{rng.random():.6f}", str(i), f"u{rng.randint(0, kinds)}", f"v{rng.randint(0, kinds)}", None) for i in range(rng.randint(0, 60))]
        short = decoys.summary(rows, k)
        at = rng.randint(0, len(rows))
        merged = decoys.summary(decoys.summary(rows[:at], k) + decoys.summary(rows[at:], k), k)
        assert merged == short and decoys.summary(short, k) == short
        for u in {r[2] for r in rows} | {"new"}:
            for v in {r[3] for r in rows} | {"new"}:
                assert firsts(short, u, v, k) == firsts(rows, u, v, k)


def test_summaries_are_short():
    rng = random.Random(1)
    rows = [(f"{rng.random():.9f}", str(i), f"u{rng.randint(0, 200)}", f"v{rng.randint(0, 200)}", None) for i in range(3000)]
    assert len(decoys.summary(rows, 1)) <= 5 and len(decoys.summary(rows, 4)) <= 40


@pytest.fixture
def records(spark):
    rng = random.Random(9)
    rows = [(f"r{i}", f"p{rng.randint(0, 5) if i > 400 else 7}", f"s{rng.randint(0, 9)}", f"i{rng.randint(0, 3)}", rng.choice(["a", "b", "c", None])) for i in range(900)]
    rows += [("odd1", None, "s1", "i1", "a"), ("odd2", "p1", None, "i1", "a"), ("odd3", "p1", "s1", None, "b"), ("odd4", "", "s2", "i1", "a")]
    return spark.createDataFrame(rows, "record_id string, problem_id string, submission_id string, input_id string, output string").repartition(3)


@pytest.mark.parametrize(("category", "same"), [("same_problem_different_submission", True), ("same_problem_different_submission", False), ("same_code_different_input", True)])
@pytest.mark.parametrize("k", [1, 3])
def test_pairs_equal_a_self_join(spark, records, category, same, k, monkeypatch):
    rows = records.collect()
    code = category == "same_code_different_input"
    order = {r.record_id: r.o for r in records.select("record_id", F.sha2(F.concat_ws(":", F.lit("0"), "record_id"), 256).alias("o")).collect()}
    want = set()
    for q in rows:
        if not (q.submission_id if code else q.problem_id) or not q.input_id or q.output is None:
            continue
        some = []
        for d in rows:
            match = d.submission_id == q.submission_id and d.input_id not in (None, q.input_id) if code else (
                d.problem_id == q.problem_id and q.submission_id is not None and d.submission_id not in (None, q.submission_id) and (d.input_id == q.input_id or not same)
            )
            if match and d.output not in (None, q.output):
                some.append((order[d.record_id], d.record_id, "same_input_id" if d.input_id == q.input_id else "different_input_id"))
        want |= {(category, q.record_id, d, relation) for _, d, relation in sorted(some)[:k]}
    got = [tuple(r) for r in pools.decoy_pairs(records, category, k, same).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_plans_have_no_self_join(spark, records):
    plan = pools.decoy_pairs(records, "same_code_different_input")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert pools.decoy_pairs(records.limit(0), "same_code_different_input").count() == 0


def test_rejections_by_one_count(spark):
    entries = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "val"), ("d", None)], "id string, split string")
    got = {tuple(r) for r in pools.rejected_candidates(spark.createDataFrame([("a",), ("c",), ("x",)], "id string"), entries).collect()}
    assert got == {("a", 1, 1), ("c", 1, 2), ("x", 0, 2)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_one_of_rows_that_are_alike_reaches_python(spark, records):
    first = lambda k: decoys.first_unlike(records, ["problem_id"], "record_id", "submission_id", "output", "input_id", F.sha2("record_id", 256), k)
    assert "min(struct(o" in _plan(first(1)) and "min(struct(o" not in _plan(first(2))


def test_skips_are_counted_without_joins(spark, records):
    for category in ("same_problem_different_submission", "same_code_different_input"):
        found = pools.decoy_skips(records, category)
        assert "Join" not in _plan(found)
        pairs = pools.decoy_pairs(records, category).count()
        got = {r.reason: r.n for r in found.collect()}
        assert got["paired"] == pairs and got["missing_ids"] == (2 if category == "same_code_different_input" else 3)


def test_coverage_counts_pairs_by_decoy_first(spark):
    pairs = spark.createDataFrame([("c", "a", "x"), ("c", "b", "x"), ("c", "y", "x"), ("c", "a", "y"), ("d", "y", "y")], "category string, query_id string, decoy_id string")
    found = pools.scorable_coverage(pairs, spark.createDataFrame([("a",), ("b",), ("x",), ("x",)], "record_id string"))
    assert _plan(found).count("Aggregate") == 4  # the records twice, pairs by decoy, the counts
    assert sorted(map(tuple, found.collect())) == [("c", 4, 2, 2), ("d", 1, 0, 1)]


def test_baselines_sort_no_pool(spark):
    rows = [(t, i, i % 3 == 0, float(i % 4), f"f{i % 2}") for t in range(5) for i in range(t, 20)]
    c = spark.createDataFrame(rows, "task int, id int, passed boolean, x double, failure_class string")
    found = reports.pool_baselines(c, "task", {"up": [F.col("x"), F.col("id")], "down": [-F.col("x"), F.col("id")]})
    assert "Window" not in _plan(found)
    want = [sum(min((r for r in rows if r[0] == t), key=lambda r: (sign * r[3], r[1]))[2] for t in range(5)) / 5 for sign in (1, -1)]
    got = found.first()
    assert [got.up, got.down] == want and (got.problems, got.pool_min, got.pool_max) == (5, 16, 20)
