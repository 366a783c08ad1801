"""What keeps memory and work of a step in proportion to its input."""

import hashlib
import re

import numpy as np
from weftline import catalogue
from weftline.functions import pyast
from weftline.functions.text import CODE_TOKEN

FOLDER = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_simhash_equals_a_plain_version(spark):
    texts = ["", "a", "A b", "a b\na b C_1 12 ++ ß SS", "x = y" * 99, "été 字 1a", None]

    def plain(text):
        votes, tokens = [0] * 64, re.findall(CODE_TOKEN, text or "")
        for t in tokens:
            bits = int.from_bytes(hashlib.blake2b(t.casefold().encode(), digest_size=8).digest(), "big")
            votes = [v + (1 if bits >> (63 - i) & 1 else -1) for i, v in enumerate(votes)]
        key = sum(1 << (63 - i) for i, v in enumerate(votes) if v >= 0) if tokens else 0
        return key - (1 << 64) if key >= 1 << 63 else key

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pyast.simhash("t").alias("k")).collect()
    assert {r.i: r.k for r in rows} == {i: plain(t) for i, t in enumerate(texts)}
    tokens = re.findall(CODE_TOKEN, texts[4])
    assert pyast._simhash(tokens, pyast._Digests(), 7) == plain(texts[4])


def test_near_split_makes_its_keys_once(spark):
    df = catalogue.QUERIES["split_dedup_near"](spark, FOLDER)
    assert "ArrowEvalPython" not in plan(df) and "documents.parquet" not in plan(df)


def test_block_distances_go_by_steps(monkeypatch):
    import pyarrow as pa
    from weftline.operators import ranking

    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(7, 3)), rng.normal(size=(5, 3))
    packed = {
        "id": np.arange(5), "own": np.arange(5) % 2, "v": v, "query_id": np.arange(7) + 100, "label": np.arange(7) % 2, "q": q
    }
    batch = pa.RecordBatch.from_pydict({c: pa.array([x.tobytes()] * 2, pa.binary()) for c, x in packed.items()})
    monkeypatch.setattr(ranking, "QUERY_STEP", 3)
    steps = list(ranking._steps([batch]))
    assert [len(x["query_id"]) for x in steps] == [3, 3, 1] * 2
    assert np.array_equal(np.concatenate([x["q"] for x in steps[:3]]), q) and all(np.array_equal(x["v"], v) for x in steps)
    for c in ("query_id", "label"):
        assert np.array_equal(np.concatenate([x[c] for x in steps[:3]]), packed[c])
    assert all(np.array_equal(x["own"], packed["own"]) and not x["v"].flags.owndata for x in steps)


def test_a_normal_source_is_parsed_once(monkeypatch):
    import ast

    from weftline.functions import codepack, pystate

    plain, marked = "def f(a):\n    x = g(a) + 1\n    return x", "def f(a):\n    'doc'\n    return 1234567890123456"
    for text in (plain, marked, "x = '%s'" % ("a" * 97), "class A:\n    y = 'a'", "'doc'"):
        tree = ast.parse(text)
        assert pystate.is_normal(tree) == (ast.dump(tree) == ast.dump(pystate._Normal().visit(ast.parse(text))))
    parses = []
    monkeypatch.setattr(codepack.ast, "parse", lambda text, f=ast.parse: parses.append(text) or f(text))
    assert codepack.normal_primary(plain, [False, True, False]) == (plain.splitlines(), [False, True, False])
    assert parses == [plain]
    assert codepack.normal_primary(marked, [False, False, True])[1] == [False, True]


def test_counted_cases_equal_records(spark):
    from pyspark.sql import functions as F
    from weftline.operators import reports

    c = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("r", "d"), ("q", "e")], "problem_id string, completion_id string")
    e = spark.createDataFrame(
        [("p", 0, "x"), ("p", 1, "y"), ("p", 2, None), ("q", 0, "x"), ("s", 0, "x")], "problem_id string, input_id int, expected_hash string"
    )
    r = spark.createDataFrame(
        [("a", 0, "x"), ("a", 1, "z"), ("b", 0, "x"), ("b", 1, "y"), ("b", 2, None), ("c", 1, "x"), ("d", 0, "x"), ("f", 0, "x")],
        "completion_id string, input_id int, output_hash string"
    )
    want = reports.pass_fail_records(c, e, r).groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("p"))
    got = {tuple(x) for x in reports.pass_fail_counts(c, e, r).collect()}
    assert got == {tuple(x) for x in want.collect()} == {("p", 6, 3), ("q", 2, 0)}


def test_sources_of_a_small_file_are_spread(spark):
    from weftline.plans import code

    f = code.files(spark, FOLDER)
    assert f.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert f.count() == spark.read.parquet(f"{FOLDER}/supplier.parquet").count()


def test_calibrator_writes_each_row_once(spark, monkeypatch):
    from weftline.operators import calibrator

    rows = spark.range(40).selectExpr("id", "cast(id % 5 as int) AS fold", "cast(id as double) AS a", "cast(id % 3 = 0 as int) AS y")
    written = []
    monkeypatch.setattr(calibrator, "stored", lambda df, name, f=calibrator.stored: written.append(f(df, name)) or written[-1])
    assert calibrator.out_of_fold(rows, ["a"], "y").count() == 40
    assert [x.count() for x in written] == [40]
