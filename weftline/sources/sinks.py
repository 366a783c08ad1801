"""Writers of shards, packs, indexes, reports and manifests, and their verification."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Keys that a config mustn't have, since nothing here runs code.
FORBIDDEN_KEYS = ("exec", "eval", "execute_code", "run_code", "shell", "subprocess")


def write_shards(rows: DataFrame, path: str, per_file: int = 10_000, overwrite: bool = False) -> None:
    """Parquet of at most per_file rows each; an existing output is only replaced on request."""
    rows.write.option("maxRecordsPerFile", per_file).mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_split_pack(rows: DataFrame, path: str, widths: dict[str, int], overwrite: bool = False) -> None:
    """Padded arrays by split; an array that is too long is an error, never cut."""
    for name, width in widths.items():
        rows = rows.withColumn(name, T.checked_width(F.col(name), width))
    rows.write.partitionBy("split").mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with columns in sorted order."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)


def write_index(rows: DataFrame, path: str, width: int) -> None:
    """id, vector and four attributes as Parquet; a vector of another width is an error."""
    checked = F.when(F.size("vector") == width, F.col("vector")).otherwise(
        F.raise_error(F.lit(f"vector isn't {width} wide")).cast("array<double>")
    )
    rows.select(
        "id", checked.alias("vector"), *[c for c in ("repo", "path", "message", "license") if c in rows.columns]
    ).write.mode("errorifexists").parquet(path)


def write_report(report: DataFrame, path: str, required: list[str]) -> None:
    """A one-row report as JSON; a missing field is an error before anything is written."""
    lacking = [c for c in required if c not in report.columns]
    if lacking:
        raise ValueError(f"report lacks {', '.join(lacking)}")
    report.limit(1).coalesce(1).write.mode("errorifexists").json(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Log events, appended as JSON lines."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def dataset_manifest(rows: DataFrame) -> DataFrame:
    """One row: counts by split (zeros too) and source, licences by source, records."""
    by = lambda c: rows.groupBy(F.coalesce(c, F.lit("missing")).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(c)
    )
    pairs = rows.groupBy("source", F.coalesce("license", F.lit("missing")).alias("license")).agg(F.count(F.lit(1)).alias("n"))
    licences = pairs.agg(F.array_sort(F.collect_list(F.struct("source", "license", "n"))).alias("licenses"))
    splits = rows.agg(
        *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")), F.count(F.lit(1)).alias("records")
    )
    return splits.crossJoin(by("source").withColumnRenamed("source", "sources")).crossJoin(licences)  # one row each


def publish_gate(
    pack: DataFrame, manifest_records: int, attributions: DataFrame, licenses: tuple[str, ...] = T.PERMISSIVE_LICENSES
) -> DataFrame:
    """check, ok: what has to hold before a pack is published.

    pack: source, license; attributions: source, url.
    """
    one = pack.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("license").isin(*licenses), F.lit(False))).alias("other")
    )
    lacking = pack.select("source").distinct().join(
        attributions.where("url is not null").select("source"), "source", "left_anti"
    ).agg(F.count(F.lit(1)).alias("lacking"))
    checks = F.array(
        F.struct(F.lit("record_count_nonzero").alias("check"), (F.col("n") > 0).alias("ok")),
        F.struct(F.lit("record_count_matches").alias("check"), (F.col("n") == manifest_records).alias("ok")),
        F.struct(F.lit("all_licenses_permissive").alias("check"), (F.col("other") == 0).alias("ok")),
        F.struct(F.lit("every_source_has_attribution").alias("check"), (F.col("lacking") == 0).alias("ok")),
    )
    return one.crossJoin(lacking).select(F.explode(checks).alias("x")).select("x.*")  # one row each


def read_config(text: str, known: set[str]) -> dict:
    """A JSON config; unknown keys, and keys anywhere in it that ask to run code, are errors."""
    config = json.loads(text)
    odd = sorted(set(config) - known)
    if odd:
        raise ValueError(f"unknown keys: {', '.join(odd)}")
    waiting = [config]
    while waiting:
        x = waiting.pop()
        waiting += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        for key in x if isinstance(x, dict) else ():
            if key.lower() in FORBIDDEN_KEYS:
                raise ValueError(f"config asks to run code: {key}")
    return config


def action_view(view: str, headline: bool) -> str:
    """The action view of a report; a headline report mustn't use patches, which tell the answer."""
    if headline and view == "patch":
        raise ValueError("a headline report can't use the patch action")
    return view
