"""Submission, score, label and prompt readers, writers, manifests, patches and code states on small files."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.functions import diffs, pyast, pystate
from weftline.functions import text as T
from weftline.operators import calibrator, curation, pools, reports, resample, rows
from weftline.sources import execution, records, sinks


def lines(path, items):
    Path(path).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in items))
    return str(path)


def test_submission_sources(spark, tmp_path):
    code = "def add(a, b):\n    return a + b\n"
    path = lines(
        tmp_path / "m.jsonl",
        [
            {
                "task_id": i,
                "code": code,
                "test_list": [
                    "assert add(1, 2) == 3",
                    "assert math.add((1,), {2}) == [1]",
                    "assert add(x, 1) == 2",
                    "assert add(a=1) == 2",
                    "oops("
                ]
            } for i in (1, 2)
        ] + [{"task_id": 3, "code": "x = 1", "test_list": ["assert x == 1"]}]
    )
    got = execution.load_submissions(spark, "mbpp", path, deduplicate=False).orderBy("problem_id").collect()
    assert [r.problem_id for r in got] == ["mbpp/1", "mbpp/2"]
    assert [
        (c.input_id, c.input_repr, c.expected, c.function_name) for c in got[0].cases
    ] == [("mbpp/1/0", "[1, 2]", "3", "add"), ("mbpp/1/1", "[[1], [2]]", "[1]", "add")]
    path = lines(
        tmp_path / "h.jsonl",
        [
            {
                "task_id": "H/0",
                "prompt": "def f(a):\n    ",
                "canonical_solution": "    return a\n",
                "test": "def check(candidate):\n    assert candidate(1) == 1\n    assert candidate('x') == 'x'\n",
                "entry_point": "f"
            }
        ]
    )
    r = execution.load_submissions(spark, "humaneval", path).first()
    assert r.code == "def f(a):\n    return a\n" and r.held_out_for_eval and [(c.input_id, c.expected) for c in r.cases] == [
        ("humaneval/case-0", "1"), ("humaneval/case-1", "'x'")
    ]
    path = lines(
        tmp_path / "p.jsonl",
        [
            {
                "task_id": "P/1",
                "canonical_solution": code,
                "entry_point": "add",
                "base_input": ["[1, 2]"],
                "plus_input": ["[3, 4]", "[5, 6]"],
                "expected_output": ["3", "7"]
            }
        ]
    )
    assert [c.expected for c in execution.load_submissions(spark, "mbpp_plus", path).first().cases] == ["3", "7", ""]
    with pytest.raises(ValueError, match="unknown execution source"):
        execution.load_submissions(spark, "other", path)
    execution.register("mine", execution.SCHEMAS["mbpp"], lambda df: execution.assert_submissions(df, "mine"))
    assert execution.load_submissions(spark, "mine", str(tmp_path / "m.jsonl"), limit=1).first().dataset == "mine"
    with pytest.raises(Exception, match="(?i)malformed"):
        execution.load_submissions(spark, "mbpp", lines(tmp_path / "bad.jsonl", ["{no json"])).collect()


def test_ids_are_a_part_of_content(spark, tmp_path):
    rows_ = [{"task_id": f"P/{i}", "canonical_solution": "x", "entry_point": "f", "base_input": ["[1]"]} for i in (2, 1)]
    got = execution.load_submissions(spark, "mbpp_plus", lines(tmp_path / "p.jsonl", rows_), deduplicate=True)
    assert got.count() == 2  # the cases' ids tell them apart
    plain = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "c string, o int")
    assert sorted(r.o for r in records.first_of_content(plain, "c", "o").collect()) == [1, 3]


def test_score_files(spark, tmp_path):
    a = lines(tmp_path / "a.jsonl", [{"problem_id": "p", "completion_id": "1", "scores": {"m": 0.5, "n": 0.25}}])
    b = lines(
        tmp_path / "b.jsonl",
        [
            {"problem_id": "p", "completion_id": "2", "score": 0.75, "method": "m"},
            {"problem_id": "p", "completion_id": "3", "score": 1.0}
        ]
    )
    got = {(r.completion_id, r.method, r.score) for r in execution.completion_scores(spark, [a, b]).collect()}
    assert got == {("1", "m", 0.5), ("1", "n", 0.25), ("2", "m", 0.75), ("3", "score", 1.0)}
    path = lines(
        tmp_path / "c.jsonl",
        [
            {"completion_id": "c", "p_pass": 0.5, "label": "pass"},
            {"record_id": "r", "score": 0.1, "passed": False, "benchmark_id": "b", "split": "val"}
        ]
    )
    assert {
        tuple(r) for r in execution.pass_scores(spark, path, "x").collect()
    } == {("c", "x", "unknown", 0.5, 1), ("r", "b", "val", 0.1, 0)}
    path = lines(
        tmp_path / "d.jsonl",
        [{"problem_id": "p", "prompt": "old"}, "{bad", {"problem_id": "p", "prompt": "new"}, {"problem_id": "q"}]
    )
    assert [tuple(r) for r in execution.prompts(spark, path).collect()] == [("p", "new")]


def test_packs_and_indexes(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, "train" if i % 2 else "val", list(range(i % 4))) for i in range(25)], "id int, split string, ids array<long>"
    )
    sinks.write_shards(df, f"{tmp_path}/shards", per_file=5)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 25 and len(list((tmp_path / "shards").glob("part-*"))) >= 5
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_shards(df, f"{tmp_path}/shards")
    sinks.write_shards(df.limit(0), f"{tmp_path}/empty")
    assert spark.read.parquet(f"{tmp_path}/empty").count() == 0
    sinks.write_split_pack(df, f"{tmp_path}/pack", {"ids": 4})
    val = execution.pack_split(spark, f"{tmp_path}/pack", "val")
    assert val.count() == 13 and {len(r.ids) for r in val.collect()} == {4}
    with pytest.raises(Exception, match="longer"):
        sinks.write_split_pack(df, f"{tmp_path}/short", {"ids": 2})
    v = spark.createDataFrame([("a", [1.0, 2.0], "r")], "id string, vector array<double>, repo string")
    sinks.write_index(v, f"{tmp_path}/index", 2)
    assert execution.transition_index(spark, f"{tmp_path}/index", 2).first().vector == [1.0, 2.0]
    with pytest.raises(Exception, match="wide"):
        execution.transition_index(spark, f"{tmp_path}/index", 3).collect()
    sinks.write_json_lines(spark.createDataFrame([(1, 2)], "b int, a int"), f"{tmp_path}/j")
    assert "".join(x.read_text() for x in (tmp_path / "j").glob("part-*.json")) == '{"a":2,"b":1}\n'
    assert execution.packed_transitions(spark, f"{tmp_path}/j", "a int, b int").first() == (2, 1)


def test_reports_configs_and_views(spark, tmp_path):
    one = spark.createDataFrame([(1, 0.5)], "n long, auc double")
    sinks.write_report(one, f"{tmp_path}/r", ["n", "auc"])
    assert spark.read.json(f"{tmp_path}/r").first().auc == 0.5
    with pytest.raises(ValueError, match="lacks status"):
        sinks.write_report(one, f"{tmp_path}/r2", ["status"])
    for _ in range(2):
        sinks.append_events(one, f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 2
    assert sinks.read_config('{"a": {"b": 1}}', {"a"}) == {"a": {"b": 1}}
    with pytest.raises(ValueError, match="unknown keys: c"):
        sinks.read_config('{"a": 1, "c": 2}', {"a"})
    with pytest.raises(ValueError, match="run code: shell"):
        sinks.read_config('{"a": [{"shell": "x"}]}', {"a"})
    assert sinks.action_view("text", True) == "text"
    with pytest.raises(ValueError, match="headline"):
        sinks.action_view("patch", True)


def test_source_registry(spark, tmp_path):
    path = lines(tmp_path / "f.jsonl", [{"repo": "r", "before": "a", "after": "b"}, ""])
    assert records.load_source(spark, "fixture", path, source="mine").first().source == "mine"
    with pytest.raises(ValueError, match="unknown source"):
        records.load_source(spark, "other", path)


def test_codenet_verdicts(spark, tmp_path):
    path = lines(
        tmp_path / "c.jsonl",
        [
            {"problem_id": "p", "submission_id": str(i), "language": lang, "code": "x", "judge_verdict": v} for i,
            (lang, v) in enumerate(
                [("Python", "Time Limit Exceeded"), ("py", "wrong_answer"), ("C", "Accepted"), ("python3", "?")]
            )
        ]
    )
    assert {
        (r.submission_id, r.judge_verdict) for r in records.read_codenet(spark, path).collect()
    } == {("0", "time_limit_exceeded"), ("1", "wrong_answer"), ("3", "unknown")}


def test_patches(spark):
    a = "one\ntwo\nthree\nfour\n"
    b = "one\n2\nthree\nfour\nfive\n"
    good = spark.createDataFrame([(a, b)], "a string, b string").select(
        "a", "b", diffs.unified_diff("a", "b", F.lit("x")).alias("p")
    ).withColumn("r", diffs.apply_patch("a", "p")).first()
    assert good.r.text == b and good.r.error is None
    bad = [
        (a, good.p.replace("-two", "-tow")),
        (a, "no patch"),
        (a, "@@ -9,1 +9,1 @@\n-x\n"),
        (a, "@@ -1,3 +1,3 @@\n one\n"),
        (None, good.p)
    ]
    got = spark.createDataFrame(bad, "a string, p string").select(diffs.apply_patch("a", "p").alias("r")).collect()
    assert all(r.r.text is None and r.r.error for r in got)


def test_casefold_and_ids(spark):
    df = spark.createDataFrame([("  Straße \t X ",), (None,)], "t string")
    assert [r[0] for r in df.select(diffs.folded_action(F.col("t"))).collect()] == ["strasse x", None]
    want = int.from_bytes(hashlib.blake2b(b"word", digest_size=4).digest(), "big") & 0x7FFFFFFF
    assert spark.createDataFrame([("word",)], "t string").select(diffs.token_id("t")).first()[0] == want


def test_sampled_mutants_are_seeded_and_ordered(spark):
    df = spark.createDataFrame([("x = not (a < b and c is d)\ny += 1\n", 3, 7)], "c string, n int, s int")
    every, some, again = df.select(
        pyast.mutants("c"), pyast.sampled_mutants("c", "n", "s"), pyast.sampled_mutants("c", "n", "s")
    ).first()
    assert {m.operator for m in every} == {
        "compare", "boolop", "not", "augassign", "const"
    } and "Is->IsNot" in {m.description for m in every}
    assert len(some) == 3 and some == again and [m for m in every if m in some] == some


def test_code_states(spark):
    source = (
        "import os\n\nclass A(B):\n    def one(self):\n        return os.path.join(self.x)\n\n    def two(self):\n       "
        " return 2\n\n"
    ) + "\n".join(
        f"v{i} = {i}" for i in range(60)
    )
    df = spark.createDataFrame(
        [(source, [5]), (source, [40]), ("x = 1\n", [1]), ("def (:", [1]), (None, [1])], "t string, c array<int>"
    )
    method, region, small, broken, none = [r[0] for r in df.select(pystate.code_state("t", "c").alias("s")).collect()]
    assert (method.symbol, method.kind, method.enclosing_class, method.imports) == ("A.one", "method", "A", "import os")
    assert method.siblings == ["def two(self)"] and method.callees == ["os.path.join"] and method.changed == [False, True] and method.start_line == 4
    assert region.kind == "region" and region.start_line == 32 and len(region.changed) == 17 and region.siblings == ["class A(B)"]
    assert small.kind == "small_file" and small.primary == "x = 1\n" and broken.kind is None and none.kind is None


def test_pools_and_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, v string")
    assert [r.v for r in pools.fixture_pool(df.where("v <> 'c'"), [2, 1]).orderBy("position").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="missing id 9"):
        pools.fixture_pool(df, [9]).collect()
    with pytest.raises(Exception, match="repeated id 2"):
        pools.fixture_pool(df, [2]).collect()
    with pytest.raises(Exception, match="repeated candidate"):
        rows.benchmark_pack(
            spark.createDataFrame([(1, "mit")], "task_id int, license string"),
            *[spark.createDataFrame([(1, "c", "t", "pass")], "task_id int, candidate_id string, text string, label string")] * 2
        ).collect()
    with pytest.raises(Exception, match="doesn't parse"):
        rows.hard_negative_candidates(
            spark.createDataFrame([(1, "x", "def (")], "task_id int, before_text string, after_text string")
        ).collect()


def test_output_fingerprints(spark):
    df = spark.createDataFrame(
        [("x", "c", [1]), ("", "c", [1]), (None, None, [1, 2]), (None, None, None)], "a string, b string, t array<int>"
    )
    got = [r[0] for r in df.select(pools.output_fingerprint(F.col("a"), F.col("b"), F.col("t"))).collect()]
    assert got == ["x", "sha256:c", "tokens_sha256:" + hashlib.sha256(b"1,2").hexdigest(), ""]


def test_calibrator_recovers_weights(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    y = rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    df = spark.createDataFrame(
        [(int(i), float(a), float(b), int(c)) for i, (a, b), c in zip(range(600), x, y, strict=True)],
        "p long, a double, b double, y int"
    )
    folded = df.join(calibrator.fold_ids(df, "p"), "p")
    assert {r["count"] for r in folded.groupBy("fold").count().collect()} == {120}
    got = {r.p: (r.fold, r.probability) for r in calibrator.out_of_fold(folded, ["a", "b"], "y").collect()}
    for fold in range(2):  # the same optimum by plain gradient descent
        train = np.array([i for i in range(600) if got[i][0] != fold])
        mean, std = x[train].mean(axis=0), x[train].std(axis=0)
        z = np.c_[(x - mean) / std, np.ones(600)]
        w = np.zeros(3)
        for _ in range(3000):
            p = 1 / (1 + np.exp(-z[train] @ w))
            w -= 0.5 * (z[train].T @ (p - y[train]) + np.append(w[:2], 0)) / len(train)
        want = 1 / (1 + np.exp(-z @ w))
        assert all(got[i][1] == pytest.approx(want[i], abs=1e-6) for i in range(600) if got[i][0] == fold)


def test_lift_needs_tasks_and_lcg_is_fixed(spark):
    df = spark.createDataFrame(
        [(t, m, float(t % 2 if m == "a" else 0)) for t in range(19) for m in ("a", "b")], "task int, method string, v double"
    )
    r = resample.paired_lift_ci(df, "a", ["b"], "v", 50).first()
    assert r.lift == pytest.approx(9 / 19) and r.low is None and r.high is None
    state, want = int(hashlib.sha256(b"3").hexdigest()[:16], 16), []
    for _ in range(5):
        state = (1103515245 * state + 12345) % 2**31
        want.append(state % 7)
    assert resample.lcg_choices(3, 7, 5) == want


def test_near_before_budget(spark):
    df = spark.createDataFrame([(i, i % 8, f"a{i % 3}") for i in range(40)], "id long, s long, a string")
    whole = curation.near_before_pairs(df, "id", "s", "a", 3).first()
    cut = curation.near_before_pairs(df, "id", "s", "a", 3, budget=5).first()
    pairs = [
        (i, j) for i in range(40) for j in range(i) if i % 8 != j % 8 and ((i % 8) ^ (j % 8)).bit_count() <= 3 and i % 3 != j % 3
    ]
    assert (whole.state_pairs, whole.row_pairs, whole.scan_truncated) == (28, len(pairs), False)
    assert cut.state_pairs == 5 and cut.scan_truncated


def test_safe_patches(spark):
    rows_ = [
        ("--- a/x\n+++ b/x\n", True),
        ("--- /dev/null\n+++ b/x\n", True),
        ("--- /etc/x\n+++ b/x\n", False),
        ("--- a/../../x\n", False),
        ("+++ C:\\x\n", False),
        ("", True)
    ]
    df = spark.createDataFrame(rows_, "p string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", T.safe_patch(F.col("p"))).collect())


def test_representation_table(spark):
    p = spark.createDataFrame([(1, "t", 0.9), (1, "t", 0.8)], "seed int, target string, accuracy double")
    c = spark.createDataFrame([(1, "t", 0.5)], "seed int, target string, accuracy double")
    got = {
        (r.seed, r.target): (r.lift, r.status) for r in reports.representation_table(
            p, c, spark.createDataFrame([(1,), (2,)], "seed int"), ["t", "u"]
        ).collect()
    }
    assert got[1, "t"] == (0.4, "available") and all(got[k] == (None, "not_evaluable") for k in ((1, "u"), (2, "t"), (2, "u")))
