"""Sources, events, source-code functions and resampling on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import pyast
from weftline.operators import classify, latents, ranking, resample
from weftline.sources import records
from weftline.streaming import events


def test_commit_reader(spark, tmp_path):
    rows = [
        {
            "repos": "A/b, c/D",
            "commit": "1",
            "old_file": "./x.py",
            "new_file": "x.py",
            "old_contents": "a",
            "new_contents": "b",
            "subject": "m",
            "lang": "Python",
            "license": "mit"
        }
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    r = records.read_commits(spark, str(tmp_path)).first()
    assert (r.repo, r.path_before, r.before, r.message, r.license) == ("A/b,c/D", "x.py", "a", "m", "mit")
    (tmp_path / "b.jsonl").write_text(json.dumps(rows[0] | {"lang": "Go"}))
    with pytest.raises(Exception, match="another language"):
        records.read_commits(spark, str(tmp_path)).collect()


def test_fixture_and_apps(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"repo": "r", "before": "a", "after": "b", "metadata": {"k": "1"}}]))
    r = records.read_fixture(spark, str(tmp_path / "f.json")).first()
    assert r.source == "fixture" and r.metadata == {"k": "1"}
    (tmp_path / "a.jsonl").write_text(
        json.dumps({"problem_id": "p", "solutions": ["x", "y"], "input_output": {"inputs": ["1", "2"], "outputs": ["3", "4"]}})
    )
    got = records.read_apps(spark, str(tmp_path / "a.jsonl")).collect()
    assert {(r.solution_no, r.input, r.output) for r in got} == {(0, "1", "3"), (0, "2", "4"), (1, "1", "3"), (1, "2", "4")}


def test_completion_labels(spark, tmp_path):
    rows = [
        {"benchmark_id": "B", "problem_id": "p", "completion_id": "1", "completion_text": "c", "label": "pass"},
        {"benchmark_id": "b", "problem_id": "p", "completion_id": "2", "code": "c"},
        {"benchmark_id": "z", "problem_id": "p", "completion_id": "3", "code": "c", "passed": True}
    ]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [
        (r.completion_id, r.passed) for r in records.completion_labels(spark, [str(tmp_path / "l.jsonl")], "b").collect()
    ] == [("1", True)]


def test_first_of_content(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, "c")], "i int, c string")
    assert [r.i for r in records.first_of_content(df, "c", "i", 2).collect()] == [1, 3]


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    r = records.file_hashes(spark, str(tmp_path / "x.bin")).first()
    assert (r.bytes, r.sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def test_events_batch_equals_stream(spark, tmp_path):
    lines = [
        '12:00 JOB_EVENT {"event": "step", "fields": {"step": "1"}}',
        "noise",
        '{"event": "step", "fields": {"step": "2"}}',
        '{"event": "done"}'
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "log.txt").write_text("\n".join(lines))
    batch = sorted(map(str, events.parse_lines(spark.read.text(str(folder))).collect()))
    assert len(batch) == 3
    q = events.read_stream(spark, str(folder)).writeStream.format("memory").queryName("ev").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ck")
    ).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("ev").collect())) == batch
    with pytest.raises(Exception, match="not a job event"):
        events.parse_lines(spark.read.text(str(folder)), strict=True).collect()


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", kind) for h in (1, 2) for m in (1, 9, 31) for kind in ("view", "click")]
    df = spark.createDataFrame(rows, "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    df.repartition(2).write.parquet(f"{tmp_path}/events")
    batch = sorted(map(str, events.tumbling_counts(df).collect()))
    assert len(batch) == 8
    stream = events.tumbling_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True)
    query.option("checkpointLocation", f"{tmp_path}/ck").start().awaitTermination(60)
    assert sorted(map(str, spark.table("windows").collect())) == batch


def test_parse_and_edits(spark):
    df = spark.createDataFrame([("x = 1\n", "x = 2\n"), ("def f(:\n", None)], "a string, b string")
    rows = df.select(
        pyast.parsed("a").alias("p"),
        pyast.edit_measure("a", "b").alias("e"),
        pyast.abstract_edits("a", "b", F.lit("SMALL"), F.lit(32)).alias("t")
    ).collect()
    assert rows[0].p.ok and rows[0].e.changed_lines == 2 and 0 < rows[0].e.ratio < 1 and [x.split()[:2] for x in rows[0].t] == [
        ["OP_UPDATE", "NODE_Module"], ["OP_UPDATE", "NODE_Assign"], ["OP_UPDATE", "NODE_Constant"]
    ]
    assert not rows[1].p.ok and rows[1].p.line == 1


def test_mutants(spark):
    df = spark.createDataFrame([("def f(a):\n    return a + 1 < 3 and True",), ("(",), (None,)], "c string")
    first, *rest = [r[0] for r in df.select(pyast.mutants("c")).collect()]
    assert len(first) == len({m.source for m in first}) == 9 and any(
        "a - 1" in m.source for m in first
    ) and all(r == [] for r in rest)
    assert [m.description for m in first if m.operator == "compare"] == ["Lt->LtE", "Lt->Gt", "Lt->GtE"]


def test_simhash(spark):
    df = spark.createDataFrame([("a b c",), ("A B C",), ("",), (None,)], "t string")
    a, b, c, d = [r[0] for r in df.select(pyast.simhash("t")).collect()]
    assert a == b != 0 and c == d == 0


def test_bootstrap_and_rank(spark):
    df = spark.range(400).select(F.lit("m").alias("method"), (F.col("id") % 4 == 0).cast("double").alias("x"), "id")
    r = resample.bootstrap_ci(df, "method", "x", rounds=200).first()
    assert r.mean == pytest.approx(0.25) and r.low < 0.25 < r.high and r.high - r.low < 0.15
    v = spark.createDataFrame([([1.0, 0.0],), ([-1.0, 0.0],), ([0.0, 1.0],), ([0.0, -1.0],)], "v array<double>")
    assert resample.effective_rank(v).first().effective_rank == pytest.approx(2)


def test_ranks_and_gate(spark):
    s = spark.createDataFrame(
        [("q", 0, 0.6, False), ("q", 1, 0.6, True), ("q", 2, 0.1, False)],
        "query_id string, position int, score double, target boolean"
    )
    assert ranking.target_ranks(s).first()["rank"] == 2
    m = spark.createDataFrame(
        [("prediction", 0.5, 0.6), ("random", 0.1, 0.2), ("no_action", 0.5, 0.4)], "method string, r1 double, mrr double"
    )
    assert {r.method: r.gate_open for r in ranking.claim_gate(m).collect()} == {"random": True, "no_action": False}


def test_known_retrieval_values(spark):
    r = spark.createDataFrame([(x, 12) for x in (1, 2, 6, 11)], "rank int, candidates int")
    m = ranking.retrieval_metrics(r).first()
    assert (
        m.r1, m.r5, m.r10, m.median_rank
    ) == (0.25, 0.5, 0.75, 4.0) and m.mrr == pytest.approx((1 + 1 / 2 + 1 / 6 + 1 / 11) / 4)


def test_auc_without_a_class_is_null(spark):
    rows = spark.createDataFrame(
        [("m", 1, 0.1), ("m", 1, 0.5), ("k", 0, 0.2), ("k", 1, 0.2)], "method string, label int, score double"
    )
    assert {r.method: r.auc for r in classify.roc_auc(rows).collect()} == {"m": None, "k": 0.5}
    assert latents.mean_pair_cosine(spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "v array<double>")).first()[0] == 0
