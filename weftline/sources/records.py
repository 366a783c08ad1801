"""Readers of edit records, execution sources and score files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import first_in_order

RAW = (
    "source string, repo string, commit string, path_before string, path_after string, before string, after string, message "
    "string, license string, timestamp string, metadata map<string,string>"
)
# Names under which commit rows carry each field.
ALIASES = {
    "repo": ("repo", "repos", "repository", "repo_name"),
    "commit": ("commit", "commit_hash", "sha"),
    "path_before": ("old_file", "old_path", "path_before"),
    "path_after": ("new_file", "new_path", "path_after"),
    "before": ("old_contents", "before"),
    "after": ("new_contents", "after"),
    "message": ("message", "subject")
}


def read_fixture(spark: SparkSession, path: str, source: str = "fixture") -> DataFrame:
    """A JSON list or JSON lines of edit records; blank lines are skipped."""
    rows = spark.read.schema(RAW).json(path, multiLine=path.endswith(".json"))
    return rows.where("before is not null or after is not null").na.fill({"source": source})


def read_commits(spark: SparkSession, folder: str, source: str = "commits", language: str = "python") -> DataFrame:
    """JSON lines (gz too) below a folder; the first alias of a field that isn't null counts.

    A row of another language is an error, not a filtered row.
    """
    names = sorted({a for own in ALIASES.values() for a in own} | {"lang", "license"})
    rows = spark.read.schema(
        ", ".join(f"`{n}` string" for n in names)
    ).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").json(folder)
    checked = F.when(
        F.coalesce(F.lower("lang"), F.lit(language)) == language, F.lit(source)
    ).otherwise(F.raise_error(F.lit("row of another language")))
    pick = {field: F.coalesce(*own) for field, own in ALIASES.items()}
    repo = F.array_join(F.filter(F.transform(F.split(pick["repo"], ","), lambda x: F.trim(x)), lambda x: x != ""), ",")
    return rows.select(
        checked.alias("source"),
        repo.alias("repo"),
        pick["commit"].alias("commit"),
        T.normal_path(pick["path_before"]).alias("path_before"),
        T.normal_path(pick["path_after"]).alias("path_after"),
        pick["before"].alias("before"),
        pick["after"].alias("after"),
        pick["message"].alias("message"),
        "license",
        F.input_file_name().alias("file")
    )


def read_apps(spark: SparkSession, path: str) -> DataFrame:
    """One row per problem, solution and input: problem_id, solution_no, input_no, code, input, output."""
    schema = (
        "problem_id string, difficulty string, solutions array<string>, input_output struct<inputs: array<string>, outputs: "
        "array<string>>, license string"
    )
    rows = spark.read.schema(schema).json(path).select(
        "problem_id", "license", F.posexplode("solutions").alias("solution_no", "code"), "input_output"
    )
    return rows.select(
        "problem_id",
        "license",
        "solution_no",
        "code",
        F.posexplode(F.arrays_zip("input_output.inputs", "input_output.outputs")).alias("input_no", "case")
    ).select(
        "problem_id",
        "license",
        "solution_no",
        "code",
        "input_no",
        F.col("case.inputs").alias("input"),
        F.col("case.outputs").alias("output")
    )


def read_codenet(spark: SparkSession, path: str) -> DataFrame:
    """Python submissions with normal verdicts and their string test cases."""
    schema = (
        "problem_id string, submission_id string, language string, license string, license_url string, code string, judge_verdict "
        "string, test_cases array<struct<input_id: string, input: string, expected_output: string>>"
    )
    rows = spark.read.schema(schema).json(path).where(F.lower("language").isin("python", "python3", "py"))
    return rows.withColumn("judge_verdict", T.verdict(F.col("judge_verdict"))).withColumn(
        "test_cases", F.filter("test_cases", lambda x: x["input"].isNotNull())
    )


def load_source(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """The rows of a source of a registered kind."""
    if kind not in READERS:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)


READERS = {"fixture": read_fixture, "commits": read_commits, "apps": read_apps, "codenet": read_codenet}


def first_of_content(rows: DataFrame, content: str, ordinal: str, limit: int | None = None) -> DataFrame:
    """The first row of each content; with a limit the first so many of them by ordinal."""
    firsts = rows.groupBy(content).agg(F.min(ordinal).alias(ordinal))
    kept = rows.join(firsts, [content, ordinal], "left_semi")
    return first_in_order(kept, limit, ordinal) if limit is not None else kept


def completion_labels(spark: SparkSession, paths: list[str], benchmark: str, strict: bool = False) -> DataFrame:
    """Labels of one benchmark: code or completion_text, passed or label pass/fail."""
    schema = (
        "benchmark_id string, problem_id string, completion_id string, code string, completion_text string, llm_order_rank "
        "int, passed boolean, label string"
    )
    rows = spark.read.schema(schema).json(paths)
    passed = F.coalesce("passed", F.when(F.col("label") == "pass", True).when(F.col("label") == "fail", False))
    out = rows.where(F.lower("benchmark_id") == benchmark.lower()).select(
        "problem_id",
        "completion_id",
        F.coalesce("code", "completion_text").alias("code"),
        "llm_order_rank",
        passed.alias("passed")
    )
    if strict:
        return out.withColumn(
            "passed", F.coalesce("passed", F.raise_error(F.lit("completion without a label")).cast("boolean"))
        )
    return out.where("passed is not null and problem_id is not null and completion_id is not null and code is not null")


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """path, bytes, sha256 of files: the content of a manifest."""
    return spark.read.format("binaryFile").load(glob).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
