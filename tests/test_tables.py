"""Table functions in SQL, and a caller's own rewrite."""

import ast

import pytest
from pyspark.sql import functions as F

from weftline.functions import pyast, pystate, tables

TEXT = "def f(value):\n    x = set([1, 2])\n    return value < 3\n"


@pytest.fixture
def code(spark):
    spark.createDataFrame([(1, TEXT), (2, "y = 2\n"), (3, "def ("), (4, None), (5, "def g():\n    pass\n")], "i int, text string").createOrReplaceTempView("code")
    tables.register(spark)


def test_rewrites_from_sql(spark, code):
    got = {(r.i, r.transform_id): r.after for r in spark.sql("SELECT i, r.* FROM code, LATERAL code_rewrites(text) r").collect()}
    assert set(got) == {(1, "rename-value-arg-to-result"), (1, "modernize-set-literal"), (5, "add-explicit-return-none")}
    assert got[1, "modernize-set-literal"] == TEXT.replace("set([1, 2])", "{1, 2}") and "result < 3" in got[1, "rename-value-arg-to-result"]
    each = spark.table("code").select("i", F.explode(pystate.rewrites("text")).alias("r")).select("i", "r.transform_id", "r.after").collect()
    assert {(r.i, r.transform_id): r.after for r in each} == got


def test_a_registered_rewrite(spark, code, monkeypatch):
    def double_numbers(tree):  # what workers can't import has to be local
        found = [n for n in ast.walk(tree) if isinstance(n, ast.Constant) and type(n.value) is int]
        for n in found:
            n.value *= 2
        return bool(found)

    monkeypatch.setattr(pystate, "_added", [])
    pystate.register_rewrite("double-numbers", "Double all numbers.", double_numbers)
    with pytest.raises(ValueError, match="already"):
        pystate.register_rewrite("double-numbers", "again", double_numbers)
    tables.register(spark)
    own = spark.sql("SELECT i, r.message, r.after FROM code, LATERAL code_rewrites(text) r WHERE transform_id = 'double-numbers'").collect()
    assert {r.i: r.after for r in own} == {1: TEXT.replace("1, 2", "2, 4").replace("< 3", "< 6"), 2: "y = 4\n"} and own[0].message == "Double all numbers."
    files = spark.table("code").select(F.lit("r").alias("repo"), F.lit("a.py").alias("path"), "text", F.lit("mit").alias("license"))
    assert pystate.synthetic_edits(files).where("commit like '%:double-numbers'").count() == 2


def test_mutants_from_sql(spark, code):
    got = [r.source for r in spark.sql("SELECT m.* FROM code, LATERAL code_mutants(text, NULL, NULL) m WHERE i = 1 ORDER BY position").collect()]
    assert got == [m[0] for m in pyast._mutants(TEXT)] and len(got) > 5
    some = spark.sql("SELECT i, m.position, m.source FROM code, LATERAL code_mutants(text, 3, 7) m").collect()
    want = spark.table("code").select("i", pyast.sampled_mutants("text", F.lit(3), F.lit(7)).alias("m")).collect()
    assert {r.i: [m.source for m in r.m] for r in want if r.m} == {i: [r.source for r in sorted(some, key=lambda r: r.position) if r.i == i] for i in {r.i for r in some}}


@pytest.mark.parametrize("head", ["value", "value, /", "*, value", "a, *, value=1"])
def test_all_kinds_of_arguments_are_renamed(head):
    got = dict((n, a) for n, _, a in pystate.rewritten(f"def f({head}):\n    return value\n"))
    assert got["rename-value-arg-to-result"] == f"def f({head.replace('value', 'result')}):\n    return result\n"
