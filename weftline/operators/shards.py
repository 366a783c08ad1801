"""Reports on shards of transitions: pools of pairs side by side, readiness for claims, slices of areas."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as types_

from ..functions import text as T
from . import classify
from .crossed import _sets
from .curation import near_before_pairs

# Pools and what they group by, and the least that a claim needs.
POOLS = {
    "same_before_different_after": "before_hash",
    "same_file": "file",
    "action_cluster": "action",
    "edit_size_controlled": "edit_bucket",
    "diff_shape_controlled": "diff_shape",
}
NEAR_POOL = "near_before_different_after"
THRESHOLDS = {
    "heldout_rows": (2, "insufficient_heldout_rows"),
    "same_file_or_near_before_pairs": (1, "missing_same_file_or_near_before_negatives"),
    "action_cluster_pairs": (1, "missing_action_cluster_negatives"),
    "edit_size_bucket_pairs": (1, "missing_edit_size_controlled_negatives"),
    "action_text_nonempty_ratio": (0.95, "low_action_text_coverage"),
    "action_abs_nonempty_ratio": (0.95, "low_action_abs_coverage"),
}


def pair_pools(rows: DataFrame, near_bits: int = 3, near_budget: int = 100_000) -> DataFrame:
    """pool, pair_count, groups, shared_groups, scan_truncated: pairs of rows whose after differs, by pool.

    rows: before_hash, state (64 bits), after_hash, repo, path, action, edit_size, diff_shape. Five
    pools are counted by one scan of grouping sets, without making a pair; the pairs of near
    states are those of :func:`curation.near_before_pairs`. ``groups`` counts the keys of a pool,
    ``shared_groups`` those of several rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = rows.select(
        text("before_hash").alias("before_hash"), F.concat_ws("\0", text("repo"), text("path")).alias("file"), text("action").alias("action"),
        T.edit_size_bucket(F.col("edit_size")).alias("edit_bucket"), text("diff_shape").alias("diff_shape"), text("after_hash").alias("after_hash"),
    )
    keys = list(POOLS.values())
    cells = _sets(keyed, [[k, "after_hash"] for k in keys], [F.count(F.lit(1)).alias("m")])
    cells = cells.withColumn("key", F.element_at(F.array(*keys), F.col("s") + 1))
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    groups = cells.groupBy("s", "key").agg(F.sum("m").alias("n"), F.sum(pairs("m")).alias("same"))
    counts = groups.groupBy("s").agg(
        F.sum(pairs("n") - F.col("same")).alias("pair_count"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("shared_groups")
    )
    names = F.array(*map(F.lit, POOLS))
    exact = counts.select(F.element_at(names, F.col("s") + 1).alias("pool"), "pair_count", "groups", "shared_groups", F.lit(False).alias("scan_truncated"))
    none = F.lit(None).cast("long")
    near = near_before_pairs(rows, "row_id", "state", "after_hash", near_bits, near_budget).select(
        F.lit(NEAR_POOL).alias("pool"), F.col("row_pairs").cast("long").alias("pair_count"), none.alias("groups"), none.alias("shared_groups"), "scan_truncated"
    )
    found = exact.unionByName(near)
    every = rows.sparkSession.createDataFrame([(p,) for p in (*POOLS, NEAR_POOL)], "pool string")  # an empty table has all pools too
    return every.join(found, "pool", "left").fillna(0, ["pair_count"]).fillna(False, ["scan_truncated"])


def metadata_quality(rows: DataFrame) -> DataFrame:
    """One row: rows, held-out rows, rows with each kind of metadata, and shares of actions that aren't empty."""
    has = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"rows_with_{c}")
    full = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(0)) > 0)
    one = rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("split").isin("val", "test")).alias("heldout_rows"),
        *(has(c) for c in ("repo", "path", "commit", "license")), full("action_text_tokens").alias("t"), full("action_abs_tokens").alias("a"),
    )
    share = lambda c, name: F.round(F.when(F.col("row_count") == 0, 0.0).otherwise(F.col(c) / F.col("row_count").cast("double")), 9).alias(name)
    return one.select("*", share("t", "action_text_nonempty_ratio"), share("a", "action_abs_nonempty_ratio")).drop("t", "a")


def claim_readiness(quality: DataFrame, pools: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """check, observed, least, failure: what a claim about the use of actions needs; failure is null where it has it."""
    count = lambda *names: F.coalesce(F.sum(F.when(F.col("pool").isin(*names), F.col("pair_count"))), F.lit(0)).cast("double")
    counts = pools.agg(
        count("same_file", "same_before_different_after", NEAR_POOL).alias("same_file_or_near_before_pairs"),
        count("action_cluster").alias("action_cluster_pairs"), count("edit_size_controlled").alias("edit_size_bucket_pairs"),
    )
    one = quality.crossJoin(counts)  # one row each
    rules = F.array(
        *(
            F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("observed"), F.lit(float((thresholds or {}).get(c, least))).alias("least"), F.lit(why).alias("why"))
            for c, (least, why) in THRESHOLDS.items()
        )
    )
    each = one.select(F.explode(rules).alias("x")).select("x.*")
    return each.select("check", "observed", "least", F.when(F.col("observed") < F.col("least"), F.col("why")).alias("failure"))


def slice_areas(rows: DataFrame, slices: dict[str, str]) -> DataFrame:
    """slice, value, method, samples, auc: areas of every method within the values of some columns.

    rows: row_id, method, score, label. slices: columns and how their null or empty value is named.
    A value whose samples have one label has no area. Slices are counted over distinct row_ids.
    """
    stack = F.array(*(F.struct(F.lit(c).alias("slice"), F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(other)).otherwise(F.col(c)).alias("value")) for c, other in slices.items()))
    # rows come once for each method: what is counted over rows is counted over distinct ones
    told = rows.select("row_id", *slices).distinct().select("row_id", F.explode(stack).alias("x"))
    sizes = told.groupBy("x.slice", "x.value").agg(F.count_distinct("row_id").alias("samples"))
    label = F.col("label").cast("long")
    named = rows.groupBy("method", "score", *slices).agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg"))
    named = named.select("method", "score", "pos", "neg", F.explode(stack).alias("x")).select("method", "score", "pos", "neg", "x.slice", "x.value")
    named = named.withColumn("group", F.concat_ws("\0", "slice", "value", "method"))
    areas = classify.counted_auc(named.where("score is not null").select("group", "score", "pos", "neg"), "group")
    keys = named.select("group", "slice", "value", "method").distinct()
    return keys.join(areas, "group", "left").join(sizes, ["slice", "value"]).select("slice", "value", "method", "samples", "auc")


def crash_scores(rows: DataFrame, seed: int = 0) -> DataFrame:
    """record_id, method, score: what may foretell that a record raises, each within 0 and 1.

    rows: record_id, before and predicted (vectors), tokens (count of active tokens), output_kind.
    Lengths of both vectors and of their sum and the token count are scaled by their extremes over
    all rows (0.5 where all are equal); random is a hash, static whether the output is an exception.
    """
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = F.zip_with("before", "predicted", lambda x, y: x + y)
    raw = {"linear_code": length("before"), "linear_code_input": length(both), "linear_predicted_output": length("predicted"), "lexical": F.col("tokens").cast("double")}
    each = rows.select("record_id", "output_kind", *(c.alias(n) for n, c in raw.items()))
    ends = each.agg(*(F.struct(F.min(n).alias("low"), F.max(n).alias("high")).alias(f"e_{n}") for n in raw))  # one row
    scaled = [F.when(F.col(f"e_{n}.high") == F.col(f"e_{n}.low"), 0.5).otherwise((F.col(n) - F.col(f"e_{n}.low")) / (F.col(f"e_{n}.high") - F.col(f"e_{n}.low"))).alias(n) for n in raw]
    static = F.when(F.coalesce(F.col("output_kind"), F.lit("")) == "exception", 1.0).otherwise(0.0)
    found = each.crossJoin(ends).select("record_id", *scaled, static.alias("static"), unit_hash(F.concat(F.lit(f"{seed}:"), "record_id")).alias("random"))
    methods = (*raw, "static", "random")
    return found.select("record_id", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods))).alias("x")).select("record_id", "x.*")


@F.pandas_udf(types_.DoubleType())
def unit_hash(text: pd.Series) -> pd.Series:
    """A number from 0 to 1: eight bytes of a text's blake2b."""
    return pd.Series([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / float(2**64 - 1) for x in text.fillna("")], dtype="float64")
