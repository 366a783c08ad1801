"""Execution sources, score and label files, packs and indexes as DataFrames.

Readers fix their schema; a registry names them. Submissions have one row each, with their
input cases as an array.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import first_in_order, input_lines
from .records import first_of_content

CASE = T.StructType([T.StructField(c, T.StringType()) for c in ("input_repr", "expected", "function_name")])


def _literal_cases(tree: ast.AST, names: set[str], shown: str) -> list[tuple[str, str, str]]:
    """(arguments as JSON, expected, function) of asserts ``name(literals) == literal``."""
    found = []
    for node in ast.walk(tree):
        test = getattr(node, "test", None) if isinstance(node, ast.Assert) else None
        if not (
            isinstance(test, ast.Compare) and [
                type(o) for o in test.ops
            ] == [ast.Eq] and isinstance(test.left, ast.Call) and not test.left.keywords
        ):
            continue
        called = test.left.func
        if getattr(called, "id", getattr(called, "attr", None)) not in names:
            continue
        try:
            args = json.dumps(
                [ast.literal_eval(a) for a in test.left.args], ensure_ascii=False, default=lambda v: sorted(v, key=repr)
            )
            found.append((args, repr(ast.literal_eval(test.comparators[0])), shown))
        except (ValueError, SyntaxError, TypeError):
            continue
    return found


def _parse(text: str | None) -> ast.Module | None:
    try:
        return None if text is None else ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(CASE))
def assert_cases(code: pd.Series, tests: pd.Series) -> pd.Series:
    """Cases of single asserts on the first function of a source."""
    out = []
    for text, asserts in zip(code, tests, strict=True):
        tree = _parse(text)
        first = next(
            (n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), None
        ) if tree else None
        trees = [t for x in ([] if asserts is None else asserts) if (t := _parse(x)) is not None and len(t.body) == 1]
        out.append([c for t in trees for c in _literal_cases(t, {first}, first)] if first else [])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(CASE))
def check_cases(test: pd.Series, entry: pd.Series) -> pd.Series:
    """Cases of the asserts on ``candidate`` in a check function."""
    return pd.Series(
        [_literal_cases(t, {"candidate"}, e) if (t := _parse(x)) is not None else [] for x, e in zip(test, entry, strict=True)]
    )


def _submissions(rows: DataFrame, dataset: str, problem, cases, code, held_out: bool, prefix) -> DataFrame:
    numbered = F.transform(
        cases,
        lambda c,
        i: F.struct(
            F.concat(prefix, i.cast("string")).alias("input_id"),
            c["input_repr"].alias("input_repr"),
            c["expected"].alias("expected"),
            c["function_name"].alias("function_name")
        )
    )
    out = rows.select(
        F.lit(dataset).alias("dataset"),
        problem.alias("problem_id"),
        code.alias("code"),
        numbered.alias("cases"),
        F.lit("accepted").alias("verdict"),
        F.lit(held_out).alias("held_out_for_eval"),
        *(c for c in ("ordinal",) if c in rows.columns),
    )
    return out.where(F.col("code").isNotNull() & F.col("problem_id").isNotNull() & (F.size("cases") > 0))


def assert_submissions(rows: DataFrame, dataset: str = "mbpp") -> DataFrame:
    """rows: task_id, code, test_list (asserts on the code's first function)."""
    task = F.col("task_id").cast("string")
    problem = F.concat(F.lit(f"{dataset}/"), task)
    return _submissions(
        rows, dataset, problem, assert_cases("code", "test_list"), F.col("code"), False, F.concat(problem, F.lit("/"))
    )


def array_submissions(rows: DataFrame, dataset: str = "mbpp_plus") -> DataFrame:
    """rows: task_id, canonical_solution, entry_point, base_input, plus_input, expected_output (JSON texts)."""
    inputs = F.concat(F.coalesce("base_input", F.array()), F.coalesce("plus_input", F.array()))
    expected = F.coalesce("expected_output", F.array().cast("array<string>"))
    case = lambda x, i: F.struct(
        x.alias("input_repr"),
        F.coalesce(F.try_element_at(expected, i + 1), F.lit("")).alias("expected"),
        F.col("entry_point").alias("function_name")
    )
    return _submissions(
        rows,
        dataset,
        F.col("task_id"),
        F.transform(inputs, case),
        F.col("canonical_solution"),
        True,
        F.concat(F.col("task_id"), F.lit("/case-"))
    )


def check_submissions(rows: DataFrame, dataset: str = "humaneval") -> DataFrame:
    """rows: task_id, prompt, canonical_solution, test (a check function), entry_point."""
    code = F.concat(F.regexp_replace("prompt", r"[ \t]+\z", ""), F.col("canonical_solution"))
    return _submissions(
        rows, dataset, F.col("task_id"), check_cases("test", "entry_point"), code, True, F.lit(f"{dataset}/case-")
    )


SCHEMAS = {
    "mbpp": "task_id string, code string, test_list array<string>",
    "mbpp_plus": (
        "task_id string, canonical_solution string, entry_point string, base_input array<string>, plus_input array<string>, "
        "expected_output array<string>"
    ),
    "humaneval": "task_id string, prompt string, canonical_solution string, test string, entry_point string",
}
BUILDERS = {"mbpp": assert_submissions, "mbpp_plus": array_submissions, "humaneval": check_submissions}


def register(kind: str, schema: str, builder) -> None:
    """A further execution source: its JSON schema and what makes submissions of its rows.

    The builder hands on the column ``ordinal`` (the line's place in the input).
    """
    SCHEMAS[kind], BUILDERS[kind] = schema, builder


def load_submissions(
    spark: SparkSession, kind: str, path: str | list[str], limit: int | None = None, deduplicate: bool = False
) -> DataFrame:
    """Submissions of a registered source with their ordinal: the place of their line in the input.

    Input order is that of the files' names and of their lines, over all splits. With deduplicate
    the first of equal code and cases stays; the limit counts what stays. A line that is no JSON
    is an error, empty lines are skipped.
    """
    if kind not in BUILDERS:
        raise ValueError(f"unknown execution source {kind!r}; known: {', '.join(sorted(BUILDERS))}")
    lines = input_lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", SCHEMAS[kind], {"mode": "FAILFAST"})
    rows = lines.select("ordinal", parsed.alias("x")).select("x.*", "ordinal")
    out = BUILDERS[kind](rows)
    if "ordinal" not in out.columns:
        raise ValueError(f"the builder of {kind!r} doesn't hand on ordinal")
    out = out.withColumn("raw_hash", F.sha2(F.to_json(F.struct("code", "cases")), 256))
    return first_of_content(out, "raw_hash", "ordinal", limit) if deduplicate else out if limit is None else first_in_order(out, limit)


def packed_transitions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a pack, strictly by schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def pack_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A Parquet pack, or one split of it: only that folder is read."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def completion_scores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """problem_id, completion_id, method, score of several score files, nested or top-level."""
    schema = (
        "problem_id string, completion_id string, benchmark_id string, split string, scores map<string,double>, score double, "
        "method string"
    )
    rows = spark.read.schema(schema).json(paths)
    every = F.map_concat(
        F.coalesce("scores", F.create_map().cast("map<string,double>")),
        F.when(
            F.col("score").isNotNull(), F.create_map(F.coalesce("method", F.lit("score")), "score")
        ).otherwise(F.create_map().cast("map<string,double>"))
    )
    return rows.select("benchmark_id", "split", "problem_id", "completion_id", F.explode(every).alias("method", "score"))


def pass_scores(spark: SparkSession, path: str, benchmark: str = "unknown") -> DataFrame:
    """Scores with labels: id, benchmark and split fall back to what names the row; label as 0 or 1."""
    schema = (
        "record_id string, completion_id string, candidate_id string, benchmark_id string, benchmark string, split string, "
        "p_pass double, score double, passed boolean, label string"
    )
    rows = spark.read.schema(schema).json(path)
    label = F.coalesce(F.col("passed").cast("int"), F.when(F.col("label") == "pass", 1).when(F.col("label") == "fail", 0))
    return rows.select(
        F.coalesce("record_id", "completion_id", "candidate_id").alias("id"), F.coalesce(
            "benchmark_id", "benchmark", F.lit(benchmark)
        ).alias("benchmark"),
        F.coalesce(
            "split", F.lit("unknown")
        ).alias("split"), F.coalesce("p_pass", "score").alias("score"), label.alias("label"),
    )


def prompts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """problem_id, prompt: bad JSON lines are skipped, the last line of a problem wins.

    Lines are in the order of the files' names and of their places in them.
    """
    parsed = input_lines(spark, path).select(
        "ordinal", F.from_json("value", "problem_id string, prompt string").alias("x")
    ).where("x.problem_id is not null and x.prompt is not null")
    return parsed.groupBy("x.problem_id").agg(F.max_by("x.prompt", "ordinal").alias("prompt"))


def candidate_blockers(rows: DataFrame, safe, secret) -> DataFrame:
    """Adds blocker to candidates (candidate_id, task_id, patch, text): null where one may enter."""
    blocker = (
        F.when(F.col("candidate_id").isNull() | F.col("task_id").isNull(), "missing_id")
        .when(F.col("patch").isNull() & F.col("text").isNull(), "missing_content")
        .when(~safe(F.col("patch")), "unsafe_path")
        .when(F.coalesce(F.col("patch"), F.col("text")).rlike(secret), "secret_found")
    )
    return rows.withColumn("blocker", blocker)


def transition_index(spark: SparkSession, path: str, width: int) -> DataFrame:
    """id, vector and attributes of an index; a vector of another width is an error."""
    rows = spark.read.parquet(path)
    checked = F.when(F.size("vector") == width, F.col("vector")).otherwise(
        F.raise_error(F.lit(f"vector isn't {width} wide")).cast("array<double>")
    )
    return rows.withColumn("vector", checked)
