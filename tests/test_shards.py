"""Pair pools against listed pairs, readiness, areas of slices."""

import hashlib
import random
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from weftline.functions import pystate
from weftline.functions import text as T
from weftline.operators import rows, shards

ROW = "row_id int, split string, before_hash string, state long, after_hash string, repo string, path string, commit string, license string, action string, edit_size int, diff_shape string, action_text_tokens int, action_abs_tokens int"


@pytest.fixture
def data():
    rng = random.Random(6)
    return [
        (i, rng.choice(["train", "val", None]), f"b{rng.randint(0, 9)}", rng.choice([0, 1, 3, 255, 2**63 - 1, -1]), f"a{rng.randint(0, 3)}", rng.choice(["r", "s", None]), rng.choice(["p", ""]),
         rng.choice(["c", None]), "mit", f"x{rng.randint(0, 4)}", rng.randint(0, 200), rng.choice(["d", "e", None]), rng.randint(0, 2), rng.choice([None, 1]))
        for i in range(80)
    ]


def test_pools_equal_listed_pairs(spark, data):
    got = {r.pool: r for r in shards.pair_pools(spark.createDataFrame(data, ROW)).collect()}
    bucket = lambda n: sum(n > b for b in (2, 10, 50, 150))
    keys = {
        "same_before_different_after": lambda r: r[2], "same_file": lambda r: (r[5] or "", r[6] or ""), "action_cluster": lambda r: r[9],
        "edit_size_controlled": lambda r: bucket(r[10]), "diff_shape_controlled": lambda r: r[11] or "",
    }
    for pool, key in keys.items():
        assert got[pool].pair_count == sum(key(a) == key(b) and a[4] != b[4] for a, b in combinations(data, 2)), pool
        assert got[pool].groups == len({key(r) for r in data}) and not got[pool].scan_truncated
    near = sum(a[3] != b[3] and ((a[3] ^ b[3]) & (2**64 - 1)).bit_count() <= 3 and a[4] != b[4] for a, b in combinations(data, 2))
    assert got[shards.NEAR_POOL].pair_count == near > 0
    assert len(got) == 6


def test_readiness(spark, data):
    table = spark.createDataFrame(data, ROW)
    quality = shards.metadata_quality(table)
    q = quality.first()
    assert (q.row_count, q.heldout_rows, q.rows_with_commit, q.rows_with_repo) == (80, sum(r[1] == "val" for r in data), sum(r[7] == "c" for r in data), sum(bool(r[5]) for r in data))
    assert q.action_text_nonempty_ratio == pytest.approx(sum(r[12] > 0 for r in data) / 80)
    got = {r.check: r.failure for r in shards.claim_readiness(quality, shards.pair_pools(table)).collect()}
    assert {c for c, why in got.items() if why} == {"action_text_nonempty_ratio", "action_abs_nonempty_ratio"}
    none = table.limit(0)
    assert all(r.failure for r in shards.claim_readiness(shards.metadata_quality(none), shards.pair_pools(none)).collect()) and shards.pair_pools(none).count() == 6


def test_areas_of_slices(spark):
    rows = [(1, "m", 0.9, 1, "E", "a"), (2, "m", 0.1, 0, None, "a"), (3, "m", 0.5, 1, "E", "b"), (4, "m", 0.7, 0, "", "a"), (1, "n", 0.2, 1, "E", "a"), (2, "n", None, 0, None, "a")]
    df = spark.createDataFrame(rows, "row_id int, method string, score double, label int, exception_class string, source string")
    got = {(r.slice, r.value, r.method): (r.samples, r.auc) for r in shards.slice_areas(df, {"exception_class": "none", "source": "unknown"}).collect()}
    assert got["source", "a", "m"] == (3, 1.0) and got["source", "b", "m"] == (1, None) and got["exception_class", "E", "m"] == (2, None)
    assert got["exception_class", "none", "m"] == (2, None) and got["source", "a", "n"] == (3, None)


def test_crash_scores(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", [rng.random() for _ in range(3)], [rng.random() for _ in range(3)], rng.randint(0, 9), rng.choice(["exception", "value", None])) for i in range(20)]
    df = spark.createDataFrame(rows, "record_id string, before array<double>, predicted array<double>, tokens int, output_kind string")
    got = {(r.record_id, r.method): r.score for r in shards.crash_scores(df, 7).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for method, of in (("linear_code", lambda r: norm(r[1])), ("linear_predicted_output", lambda r: norm(r[2])), ("lexical", lambda r: r[3]),
                       ("linear_code_input", lambda r: norm([a + b for a, b in zip(r[1], r[2], strict=True)]))):
        low, high = min(map(of, rows)), max(map(of, rows))
        assert all(got[r[0], method] == pytest.approx((of(r) - low) / (high - low)) for r in rows)
    digest = hashlib.blake2b(b"7:r3", digest_size=8).digest()
    assert got["r3", "random"] == int.from_bytes(digest, "big") / float(2**64 - 1) and len(got) == 120
    assert all(got[r[0], "static"] == (r[4] == "exception") for r in rows)
    same = {r.method: r.score for r in shards.crash_scores(df.limit(1)).collect()}
    assert same["linear_code"] == same["lexical"] == 0.5 and shards.crash_scores(df.limit(0)).count() == 0


def test_covering_seed_of_targets(spark):
    data = [(i, i % 2, None if i % 9 else "big", "x" if i % 4 == 1 else None) for i in range(60)]
    df = spark.createDataFrame(data, "p int, l int, magnitude string, length string")
    for targets in ((), ("magnitude",), ("magnitude", "length")):
        seed = rows.covering_seed(df, "p", "l", targets=targets)
        for s in range(seed + 1):
            split = {r.p: r.s for r in df.select("p", T.split_name(F.col("p").cast("string"), seed=str(s), train=0.8, val=0.1).alias("s")).collect()}
            whole = all(
                len({r[1] for r in data if split[r[0]] == name}) == 2 and all(any(r[{"magnitude": 2, "length": 3}[t]] for r in data if split[r[0]] == name) for t in targets)
                for name in ("val", "test")
            )
            assert whole == (s == seed)
    with pytest.raises(ValueError, match="no seed"):
        rows.covering_seed(df.withColumn("none", F.lit(None).cast("string")), "p", "l", 70, targets=("none",))


def test_text_decoys(spark):
    df = spark.createDataFrame([("t1", "value = other + value"), ("t2", "1 + 2"), ("t3", ""), ("t4", None)], "id string, text string")
    got = {r.id: [tuple(d) for d in r.d] for r in df.select("id", pystate.text_decoys(3, 5)("id", "text").alias("d")).collect()}
    draw = random.Random(int.from_bytes(hashlib.sha256(b"5|t1|mutation").digest()[:8], "big"))
    want = []
    for i in range(3):
        found = draw.choice([(0, 5), (8, 13), (16, 21)])
        other = draw.choice(pystate.SUBSTITUTES)
        while other == "value = other + value"[slice(*found)]:
            other = draw.choice(pystate.SUBSTITUTES)
        want.append((i, "value = other + value"[: found[0]] + other + "value = other + value"[found[1] :]))
    assert got["t1"] == want and got["t2"][0] == (0, "1 + 2 # mutation") and got["t3"][2] == (2, " # mutation") and got["t4"] == []


def test_slices_rank_counts_and_not_rows(spark, monkeypatch):
    seen = []
    counted = shards.classify.counted_auc
    monkeypatch.setattr(shards.classify, "counted_auc", lambda rows, by: seen.append(rows.count()) or counted(rows, by), raising=True)
    table = [(f"r{i}", "m", float(i % 2), i % 3 % 2, "k") for i in range(300)]
    found = shards.slice_areas(spark.createDataFrame(table, "row_id string, method string, score double, label int, kind string"), {"kind": "none"}).first()
    assert seen == [2] and found.samples == 300 and found.auc == pytest.approx(0.5)
