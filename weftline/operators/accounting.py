"""Row accounts of a run of stages, counted by the jobs that write them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import stored

ACCOUNT = "position int, stage string, read long, written long, dropped map<string,long>, source string"


def run_stages(
    source: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], reasons: dict[str, list[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows of the last stage, accounts): each stage is written, and counts what it reads and keeps.

    A stage gets what the one before it has written, and reads it once. One with reasons returns
    all its rows with a column ``drop_reason`` (null: kept); those that have a reason are counted
    by it and go, and a reason that isn't listed is counted as ``other``. Counts come from
    observations of the writing job itself, so an account costs no further scan.
    """
    rows, accounts, before = source, [], "source"
    for position, (name, stage) in enumerate(stages):
        read, wrote = Observation(f"{name} read"), Observation(f"{name} wrote")
        out = stage(rows.observe(read, F.count(F.lit(1)).alias("n")))
        listed = (reasons or {}).get(name)
        if listed is not None:
            reason = F.col("drop_reason")
            known = [F.count_if(reason == r).alias(f"r{i}") for i, r in enumerate(listed)]
            other = F.count_if(reason.isNotNull() & ~reason.isin(*listed)).alias("other")
            out = out.observe(wrote, F.count_if(reason.isNull()).alias("n"), other, *known).where(reason.isNull()).drop("drop_reason")
        else:
            out = out.observe(wrote, F.count(F.lit(1)).alias("n"))
        rows = stored(out, name)
        seen = wrote.get
        dropped = {r: seen[f"r{i}"] for i, r in enumerate(listed or [])} | ({"other": seen["other"]} if seen.get("other") else {})
        accounts.append((position, name, read.get["n"], seen["n"], dropped, before))
        before = name
    return rows, source.sparkSession.createDataFrame(accounts, ACCOUNT)


def equalities(accounts: DataFrame, loaded: int | None = None) -> DataFrame:
    """equality, left, right, holds: each stage reads what was written before it, and a stage that
    drops by reason reads what it keeps and drops. loaded: rows of the source, if they are known."""
    after = accounts.select(F.col("stage").alias("source"), F.col("written").alias("left"))
    chain = accounts.join(after, "source").select(
        F.concat(F.col("source"), F.lit("_output_equals_"), "stage", F.lit("_input")).alias("equality"), "left", F.col("read").alias("right")
    )
    first = accounts.where("position = 0").select(
        F.concat(F.lit("loaded_equals_"), "stage", F.lit("_input")).alias("equality"), F.lit(loaded).cast("long").alias("left"), F.col("read").alias("right")
    )
    total = F.aggregate(F.map_values("dropped"), F.col("written"), lambda a, x: a + x)
    own = accounts.where(F.size("dropped") > 0).select(
        F.concat("stage", F.lit("_kept_and_dropped_equal_input")).alias("equality"), total.alias("left"), F.col("read").alias("right")
    )
    every = chain.unionByName(own) if loaded is None else first.unionByName(chain).unionByName(own)
    return every.withColumn("holds", F.col("left") == F.col("right"))
