"""Live states of runs: the stream equals the batch for late, repeated and missing steps."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.streaming import runs

T0 = datetime.datetime(2026, 1, 1)
EVENTS = "run_id string, event string, step int, ts timestamp"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_ranges_of_steps():
    rng = random.Random(3)
    for _ in range(50):
        steps = [rng.randint(1, 40) for _ in range(rng.randint(0, 40))]
        cut = rng.randint(0, len(steps))
        got = runs.add_steps(runs.add_steps([], steps[:cut]), steps[cut:])
        assert sorted(set(steps)) == [i for a, b in got for i in range(a, b + 1)] and all(b[0] > a[1] + 1 for a, b in zip(got, got[1:], strict=False))


@pytest.fixture
def batches():
    """Three micro-batches: steps out of order and late, some twice, some never, runs that end."""
    rng, rows = random.Random(4), []
    for r in range(6):
        for s in range(1, 31):
            if r == 2 and s in (5, 17):
                continue  # missing
            rows.append((f"run{r}", "step", s, at(s + rng.random() * 40)))
        rows.append((f"run{r}", "start", None, at(0)))
        if r < 3:
            rows.append((f"run{r}", "completed" if r else "failed", None, at(200)))
    rows += rng.sample(rows, 25)  # repeated, in any batch
    rng.shuffle(rows)
    return [rows[:60], rows[60:120], rows[120:]]


def stream(spark, tmp_path, batches, **how):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    files = sorted((tmp_path / "in").glob("b*/part-*.parquet"))
    assert len(files) == len(batches)
    (tmp_path / "src").mkdir()
    for i, f in enumerate(files):
        f.rename(tmp_path / "src" / f"{i}.parquet")
        import os

        os.utime(tmp_path / "src" / f"{i}.parquet", (1000 + i, 1000 + i))
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    got = []
    query = runs.live_runs(events, **how).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
    query.foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
    last = {}
    for r in got:
        if r.run_id not in last or r.updates > last[r.run_id].updates:
            last[r.run_id] = r
    return last, got


def test_stream_equals_batch(spark, tmp_path, batches):
    last, got = stream(spark, tmp_path, batches)
    whole = {r.run_id: r for r in runs.run_states(spark.createDataFrame([r for b in batches for r in b], EVENTS)).collect()}
    assert set(last) == set(whole) and len(got) > len(whole)
    for run, r in whole.items():
        assert all(r[c] == last[run][c] for c in ("events", "steps", "contiguous", "highest", "missing", "latest_event", "status")), run
        assert r.latest_ts == last[run].latest_ts
    assert whole["run2"].contiguous == 4 and whole["run2"].missing == 2 and whole["run0"].status == "failed" and whole["run5"].status == "running"
    assert whole["run1"].contiguous == 30 and whole["run1"].latest_event == "completed"


def test_silent_runs_time_out(spark, tmp_path):
    first = [("quiet", "step", 1, at(0)), ("done", "completed", None, at(0)), ("busy", "step", 1, at(0))]
    then = [("busy", "step", 2, at(5000))]
    more = [("busy", "step", 3, at(5001))]
    last, got = stream(spark, tmp_path, [first, then, more], late="10 seconds", idle_seconds=60)
    assert last["quiet"].status == "timed_out" and last["done"].status == "completed" and last["done"].updates == 2
    # its own silence ended the state of busy too; what came after it began anew
    assert [r.status for r in got if r.run_id == "busy"][0] == "running" and last["busy"].latest_ts >= at(0)


def test_odd_events(spark):
    rows = [("a", "start", None, at(1)), ("a", "step", 0, at(2)), ("a", "step", -3, at(3)), (None, "step", 1, at(1))]
    got = {r.run_id: r for r in runs.run_states(spark.createDataFrame(rows, EVENTS)).collect()}
    assert (got["a"].events, got["a"].steps, got["a"].contiguous, got["a"].latest_event) == (3, 0, 0, "step") and set(got) == {"a"}
    assert runs.run_states(spark.createDataFrame([], EVENTS)).count() == 0
    assert runs.run_states(spark.createDataFrame(rows, EVENTS)).where(F.col("missing") < 0).count() == 0
