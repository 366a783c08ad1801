"""Places in an order over partitions and files; exact resampling streams."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import reports, resample
from weftline.sources import execution, ordered


@pytest.fixture
def small_pieces(spark):
    for k, v in (("maxPartitionBytes", "4k"), ("openCostInBytes", "1k")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_lines_over_files_and_pieces(spark, tmp_path, small_pieces):
    rng, want = random.Random(1), []
    for name, n in (("b.jsonl", 900), ("a.jsonl", 1500), ("c.jsonl", 0), ("d.jsonl", 3)):
        lines = [f"{name} {i} {'x' * rng.randint(0, 30)}" for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want.append((name, lines))
    want = [x for _, lines in sorted(want) for x in lines]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = ordered.input_lines(spark, str(tmp_path))
    assert [r.value for r in got.orderBy("ordinal").collect()] == want and sorted(r.ordinal for r in got.collect()) == list(range(2403))


@pytest.mark.parametrize("limit", [0, 1, 4, 5, 70, 1000])
def test_limits_in_order(spark, limit, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", 16)
    have = sorted(random.Random(3).sample(range(5000), 300))
    rows = spark.createDataFrame([(i,) for i in have], "ordinal long").repartition(5)
    assert sorted(r.ordinal for r in ordered.first_in_order(rows, limit).collect()) == have[:limit]


def test_submissions_in_input_order(spark, tmp_path, small_pieces):
    # more lines than one piece, names that sort otherwise than as numbers, repeated content
    for part, ids in (("p1", range(200, 120, -1)), ("p0", range(40))):
        rows = [{"task_id": i, "code": f"def add(a, b):\n    return a + b + {i % 50}\n", "test_list": [f"assert add(1, {i % 50}) == 3", "# " + "y" * 150]} for i in ids]
        (tmp_path / f"{part}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    order = [*range(40), *range(200, 120, -1)]
    load = lambda **how: [r.problem_id for r in execution.load_submissions(spark, "mbpp", str(tmp_path), **how).orderBy("ordinal").collect()]
    assert load() == [f"mbpp/{i}" for i in order]
    assert load(limit=55) == [f"mbpp/{i}" for i in order[:55]]
    assert load(limit=10_000) == load() and load(limit=0) == []
    # content holds the cases' ids, which hold the problem's: all differ
    assert load(deduplicate=True, limit=45) == load(limit=45)


def test_equal_submissions_once_in_input_order(spark, tmp_path):
    rows = [{"task_id": t, "code": "def f(a):\n    return a\n", "test_list": ["assert f(1) == 1"]} for t in (3, 2, 3, 1, 2, 10)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    load = lambda **how: [r.problem_id for r in execution.load_submissions(spark, "mbpp", str(tmp_path), **how).orderBy("ordinal").collect()]
    assert load(deduplicate=True) == ["mbpp/3", "mbpp/2", "mbpp/1", "mbpp/10"] and load(deduplicate=True, limit=3) == ["mbpp/3", "mbpp/2", "mbpp/1"]
    assert load(limit=3) == ["mbpp/3", "mbpp/2", "mbpp/3"]
    execution.register("loses", execution.SCHEMAS["mbpp"], lambda df: execution.assert_submissions(df).drop("ordinal"))
    with pytest.raises(ValueError, match="ordinal"):
        execution.load_submissions(spark, "loses", str(tmp_path))


def test_the_last_prompt_wins_over_files(spark, tmp_path, small_pieces):
    for name, word in (("1.jsonl", "first"), ("2.jsonl", "last"), ("0.jsonl", "none")):
        (tmp_path / name).write_text("".join(json.dumps({"problem_id": f"p{i % 100}", "prompt": f"{word} {i}"}) + "\n" for i in range(300)))
    got = {r.problem_id: r.prompt for r in execution.prompts(spark, str(tmp_path)).collect()}
    assert got == {f"p{i}": f"last {200 + i}" for i in range(100)}


def test_places_of_sorted_rows(spark):
    have = random.Random(2).sample(range(10**6), 2000)
    rows = spark.createDataFrame([(f"k{i:07d}", i) for i in have], "k string, v int").repartition(7)
    got = ordered.numbered(rows, "k").collect()
    assert {r.k: r.ordinal for r in got} == {k: i for i, k in enumerate(sorted(r.k for r in got))} and len(got) == 2000
    shifted = {r.k: r.shifted for r in reports.next_in_order(rows, "k", "v").collect()}
    keys = sorted(shifted)
    assert all(shifted[k] == int(keys[(i + 1) % 2000][1:]) for i, k in enumerate(keys))
    assert reports.next_in_order(rows.limit(0), "k", "v").count() == 0 and ordered.numbered(rows.limit(0), "k").count() == 0


def stream(seed):
    state = int(hashlib.sha256(str(seed).encode()).hexdigest()[:16], 16)
    while True:
        state = (1103515245 * state + 12345) % 2**31
        yield state


def test_jumps_equal_steps():
    steps = stream(7)
    want = [next(steps) for _ in range(1000)]
    for first, count in ((0, 1000), (0, 0), (1, 1), (333, 500), (999, 1)):
        assert resample.lcg_states(resample.lcg_start(7), first, count).tolist() == want[first : first + count]


def test_intervals_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(resample, "DRAWS", 1000)
    rng = random.Random(5)
    tasks = [f"t{rng.randint(0, 10**6)}" for _ in range(57)]
    rows = {(t, m): (rng.random(), float(rng.random() < 0.5)) for t in tasks for m in ("own", "a", "b")}
    df = spark.createDataFrame([(t, m, *v) for (t, m), v in rows.items()] + [("lone", "a", 1.0, 1.0)], "task string, method string, mrr double, hit double")
    got = {(r.baseline, r.metric): r for r in resample.lift_intervals(df.repartition(3), "task", "own", ["a", "b"], ["mrr", "hit"], rounds=150, seed=3).collect()}
    draw, ordered_tasks = stream(3), sorted(tasks)
    picks = [[ordered_tasks[next(draw) % 57] for _ in range(57)] for _ in range(150)]
    for (b, v), r in got.items():
        i = ("mrr", "hit").index(v)
        lift = {t: rows[t, "own"][i] - rows[t, b][i] for t in tasks}
        means = sorted(sum(lift[t] for t in p) / 57 for p in picks)
        assert r.tasks == 57 and r.lift == pytest.approx(sum(lift.values()) / 57)
        assert r.low == pytest.approx(means[math.floor(0.025 * 149)]) and r.high == pytest.approx(means[math.ceil(0.975 * 149)])
    assert len(got) == 4
    few = resample.lift_intervals(df.where(F.col("task").isin(tasks[:19])), "task", "own", ["a"], ["mrr"], rounds=150).first()
    assert few.tasks == 19 and few.low is None and few.high is None and few.lift is not None


def test_draws_are_not_broadcast(spark):
    rows = [(f"t{i}", m, float(i)) for i in range(30) for m in ("own", "a")]
    found = resample.lift_intervals(spark.createDataFrame(rows, "task string, method string, x double"), "task", "own", ["a"], ["x"], rounds=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [row" in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins)


def test_interval_gate(spark):
    rows = [("a", "mrr", 0.1, 0.05), ("a", "hit", 0.1, 0.0), ("b", "mrr", 0.1, None), ("b", "hit", -0.1, 0.2), ("c", "hit", None, None)]
    got = {(r.baseline, r.metric): r.blocker for r in reports.interval_gate(spark.createDataFrame(rows, "baseline string, metric string, lift double, low double")).collect()}
    assert got == {("a", "mrr"): None, ("a", "hit"): "interval_includes_zero", ("b", "mrr"): "interval_missing", ("b", "hit"): "lift_not_positive", ("c", "hit"): "lift_not_positive"}
