"""Candidate pools: hard negatives, contrast pools, decoy pairs, seeded samples and problem splits.

Queries are a stated, bounded set (``MAX_QUERIES``), so they may be broadcast against all rows.
A seeded shuffle is a hash order here: the same rows in the same order on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import decoys

MAX_QUERIES = 100
MAX_NEGATIVES = 10
MAX_PER_POOL = 5
NEAR_BITS = 3
POOLS = ("exact_same_before", "near_before", "same_file", "action_cluster", "edit_shape", "mutation", "random")
#: Columns of a pool entry.
ENTRY = (
    "id",
    "split",
    "source",
    "repo",
    "path",
    "before",
    "after",
    "state",
    "edit_size",
    "cluster",
    "shape",
    "mutated",
    "similarity"
)


def held_out_queries(entries: DataFrame, limit: int = MAX_QUERIES, seed: str = "0") -> DataFrame:
    """At most limit rows outside train, in seeded order."""
    return entries.where("split <> 'train'").orderBy(T.hash_order(F.col("id"), seed=seed), "id").limit(limit)


def _pairs(queries: DataFrame, entries: DataFrame) -> DataFrame:
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in ENTRY))
    return entries.select(*ENTRY).join(F.broadcast(q), F.col("id") != F.col("q_id"))  # MAX_QUERIES rows


def different_after() -> Column:
    """Null-safe: where a hash is missing the ids decide."""
    known = F.col("q_after").isNotNull() & F.col("after").isNotNull()
    return F.when(known, F.col("q_after") != F.col("after")).otherwise(F.col("q_id") != F.col("id"))


def _near(bits: int) -> Column:
    return F.coalesce(T.hamming(F.col("state"), F.col("q_state")) <= bits, F.lit(False))


def _same_file() -> Column:
    repo = (F.coalesce("q_repo", F.lit("")) == "") | (F.col("repo") == F.col("q_repo"))
    return F.coalesce((F.col("q_path") != "") & (F.col("path") == F.col("q_path")) & repo, F.lit(False))


def hard_negatives(
    queries: DataFrame,
    entries: DataFrame,
    target: str = "q_id",
    limit: int = MAX_NEGATIVES,
    bits: int = NEAR_BITS,
    bucket: int = 10,
    seed: str = "0"
) -> DataFrame:
    """query_id, rank, id, reasons: for each query the rows that have most in common with it.

    Rows of train and the target itself never enter. Order: number of reasons, similarity
    (null last), seeded order, id.
    """
    equal = lambda c: F.coalesce(F.col(c) == F.col(f"q_{c}"), F.lit(False))
    other = F.coalesce(F.col("after") != F.col("q_after"), F.lit(False))
    size = lambda c: F.floor(F.col(c) / bucket)
    same = equal("before") & other
    rules = (
        ("same_before_different_after", same),
        ("near_before_different_after", ~same & other & _near(bits)),
        ("same_file", _same_file()),
        ("same_source", equal("source")),
        ("same_edit_size_bucket", F.coalesce(size("edit_size") == size("q_edit_size"), F.lit(False))),
        ("same_action_cluster", equal("cluster")),
    )
    reasons = F.filter(F.array(*(F.when(rule, name) for name, rule in rules)), lambda x: x.isNotNull())
    open_rows = _pairs(
        queries, entries.where("split <> 'train'")
    ).where(F.col("id") != F.col(target)).withColumn("reasons", reasons)
    tie = T.hash_order(F.col("q_id"), F.col("id"), seed=seed)
    order = Window.partitionBy("q_id").orderBy(F.size("reasons").desc(), F.col("similarity").desc_nulls_last(), tie, "id")
    ranked = open_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select(F.col("q_id").alias("query_id"), "rank", "id", F.array_join("reasons", ",").alias("reasons"))


def rejected_candidates(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, true_target, train_leakage: what hard_negatives leaves out for each query.

    Every train row but the query's own is left out for it: one count serves all queries.
    """
    train = entries.agg(F.count_if(F.col("split") == "train").alias("train"))  # one row
    own = entries.groupBy("id").agg(F.count(F.lit(1)).alias("true_target"), F.count_if(F.col("split") == "train").alias("own"))
    each = queries.select("id").join(own, "id", "left").fillna(0, ["true_target", "own"]).crossJoin(train)
    each = each.select(F.col("id").alias("query_id"), "true_target", (F.col("train") - F.col("own")).alias("train_leakage"))
    return each.where("true_target + train_leakage > 0")


def hard_pool(queries: DataFrame, negatives: DataFrame) -> DataFrame:
    """query_id, position, id: the target first, then the negatives by rank."""
    target = queries.select(F.col("id").alias("query_id"), F.lit(0).alias("position"), F.col("id"))
    return target.unionByName(negatives.select("query_id", F.col("rank").alias("position"), "id"))


def contrast_pools(
    queries: DataFrame, entries: DataFrame, cap: int = MAX_PER_POOL, bits: int = NEAR_BITS, seed: str = "0"
) -> DataFrame:
    """query_id, pool, id: held-out rows of each pool, at most cap in seeded order."""
    other = different_after()
    equal = lambda c: F.coalesce(F.col(c) == F.col(f"q_{c}"), F.lit(False))
    rules = {
        "exact_same_before": equal("before") & other,
        "near_before": ~equal("before") & other & _near(bits),
        "same_file": _same_file() & other,
        "action_cluster": equal("cluster") & other,
        "edit_shape": equal("shape") & other,
        "mutation": F.coalesce(F.col("mutated"), F.lit(False)) & other,
        "random": F.lit(True),
    }
    named = F.filter(F.array(*(F.when(rules[p], p) for p in POOLS)), lambda x: x.isNotNull())
    each = _pairs(queries, entries.where("split <> 'train'")).select("q_id", "id", F.explode(named).alias("pool"))
    order = Window.partitionBy("q_id", "pool").orderBy(T.hash_order(F.col("q_id"), F.col("pool"), F.col("id"), seed=seed), "id")
    kept = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    return kept.select(F.col("q_id").alias("query_id"), "pool", "id")


def output_fingerprint(shown: Column, checksum: Column, tokens: Column) -> Column:
    """The shown output, else its checksum, else the hash of its tokens, else empty."""
    joined = F.array_join(F.transform(tokens, lambda x: x.cast("string")), ",")
    return F.when(F.length(shown) > 0, shown).when(F.length(checksum) > 0, F.concat(F.lit("sha256:"), checksum)).when(
        tokens.isNotNull(), F.concat(F.lit("tokens_sha256:"), F.sha2(joined, 256))
    ).otherwise("")


def decoy_pairs(
    records: DataFrame, category: str, per_query: int = 1, same_input_only: bool = True, seed: str = "0"
) -> DataFrame:
    """category, query_id, decoy_id, relation: records whose output differs, in seeded order.

    records: record_id, problem_id, submission_id, input_id, output. same_problem_different_
    submission looks within the problem (and input), same_code_different_input within the
    submission. Each group has a short summary that its records pick from, so no pairs are made
    but those of the result.
    """
    present = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    if category == "same_code_different_input":
        keys, unlike = ["submission_id"], "input_id"
        asked = records.where(present("submission_id") & present("input_id"))
    else:
        keys, unlike = ["problem_id", "input_id"] if same_input_only else ["problem_id"], "submission_id"
        asked = records.where(present("problem_id") & present("input_id"))
    first = decoys.first_unlike(records, keys, "record_id", unlike, "output", "input_id", T.hash_order(F.col("record_id"), seed=seed), per_query)
    found = asked.join(first, keys)
    found = found.withColumn("d", F.explode(decoys.pick(F.col("first"), F.col(unlike), F.col("output"), per_query)))
    relation = F.when(F.col("input_id") == F.col("d.note"), "same_input_id").otherwise("different_input_id")
    return found.select(
        F.lit(category).alias("category"),
        F.col("record_id").alias("query_id"),
        F.col("d.id").alias("decoy_id"),
        relation.alias("relation")
    )


def decoy_skips(records: DataFrame, category: str, same_input_only: bool = True) -> DataFrame:
    """reason, n: why records have no decoy, and how many were eligible; counts only, no pairs."""
    code = category == "same_code_different_input"
    key = ["submission_id"] if code else ["problem_id", "input_id"] if same_input_only else ["problem_id"]
    unlike = "input_id" if code else "submission_id"
    absent = F.lit(False)
    for c in {key[0], "input_id"}:
        absent = absent | (F.coalesce(F.col(c), F.lit("")) == "")
    known = records.where(~absent)
    # rows are counted first; of the counts: rows of the group, of the own side, and those with the same output
    over = lambda *c: F.sum("both_n").over(Window.partitionBy(*key, *c))
    counts = known.groupBy(*key, unlike, "output").agg(F.count(F.lit(1)).alias("both_n"))
    counts = counts.withColumn("group_n", over()).withColumn("side_n", over(unlike)).withColumn("alike_n", over("output"))
    counts = counts.na.drop(subset=[unlike, "output"])
    others = F.col("group_n") - F.col("side_n")
    differing = others - (F.col("alike_n") - F.col("both_n"))
    none = "no_other_input" if code else "no_other_submission"
    reason = F.when(others == 0, none).when(differing == 0, "outputs_identical").otherwise("paired")
    return counts.select(reason.alias("reason"), "both_n").unionByName(
        records.where(absent).select(F.lit("missing_ids").alias("reason"), F.lit(1).cast("long").alias("both_n"))
    ).groupBy("reason").agg(F.sum("both_n").alias("n"))


def semantic_decoys(records: DataFrame, per_query: int = 1, seed: str = "0") -> DataFrame:
    """Both kinds of decoys within each split, with the leak that a pair shows (null: none).

    records has split and dataset besides the columns of :func:`decoy_pairs`.
    """
    found = None
    for split in ("val", "test"):
        own = records.where(F.col("split") == split)
        for category, same in (("same_problem_different_submission", False), ("same_code_different_input", True)):
            pairs = decoy_pairs(own, category, per_query, same, seed)
            found = pairs if found is None else found.unionByName(pairs)
    side = lambda p: records.select(
        *(
            F.col(c).alias(f"{p}_{c}") for c in (
                "record_id", "split", "dataset", "problem_id", "submission_id", "input_id", "output"
            )
        )
    )
    both = found.join(
        side("a"), F.col("query_id") == F.col("a_record_id")
    ).join(side("b"), F.col("decoy_id") == F.col("b_record_id"))
    problem = F.col("category") == "same_problem_different_submission"
    equal = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    leak = (
        F.when((F.col("a_split") == "train") | (F.col("b_split") == "train"), "train_split")
        .when(~equal("dataset"), "dataset_mismatch")
        .when(problem & ~equal("problem_id"), "problem_mismatch")
        .when(problem & equal("submission_id"), "same_submission")
        .when(~problem & equal("input_id"), "same_input")
        .when(equal("output"), "identical_outputs")
    )
    return both.select(
        "category",
        "query_id",
        "decoy_id",
        "relation",
        F.col("a_split").alias("split"),
        F.col("a_problem_id").alias("problem_id"),
        leak.alias("leak")
    )


def scorable_coverage(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """category, pairs, scorable, skipped: pairs whose two records are both among the rows."""
    have = rows.select(F.col("record_id").alias("r")).distinct().withColumn("there", F.lit(True))
    joined = pairs.join(have.withColumnRenamed("there", "q_there"), F.col("query_id") == F.col("r"), "left").drop("r")
    # a few records are the decoy of many, so pairs are counted by theirs before it is looked up
    counted = joined.groupBy("category", "decoy_id", "q_there").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(have.withColumnRenamed("there", "d_there"), F.col("decoy_id") == F.col("r"), "left")
    both = F.col("q_there").isNotNull() & F.col("d_there").isNotNull()
    among = lambda rule: F.sum(F.when(rule, F.col("n")).otherwise(0))
    return counted.groupBy("category").agg(F.sum("n").alias("pairs"), among(both).alias("scorable"), among(~both).alias("skipped"))


def surprise_decoys(queries: DataFrame, entries: DataFrame, per_category: int = 3, seed: str = "0") -> DataFrame:
    """query_id, category, id: random, same_file and action_cluster decoys in seeded order.

    Where a query has no row of its file or cluster, rows of the whole corpus stand in.
    """
    other = (F.col("id") != F.col("q_id")) & different_after()
    pairs = _pairs(queries, entries).where(other)
    own = F.array(
        F.lit("random"), F.when(_same_file(), "same_file"), F.when(F.col("cluster") == F.col("q_cluster"), "action_cluster")
    )
    each = pairs.select("q_id", "id", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("category"))
    have = each.select("q_id", "category").distinct()
    want = queries.select(
        F.col("id").alias("q_id"), F.explode(F.array(F.lit("same_file"), F.lit("action_cluster"))).alias("category")
    )
    lacking = want.join(have, ["q_id", "category"], "left_anti")
    fallback = pairs.select("q_id", "id").join(F.broadcast(lacking), "q_id").select("q_id", "id", "category")  # two rows a query
    order = Window.partitionBy("q_id", "category").orderBy(
        T.hash_order(F.col("q_id"), F.col("category"), F.col("id"), seed=seed), "id"
    )
    kept = each.unionByName(fallback).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_category)
    return kept.select(F.col("q_id").alias("query_id"), "category", "id")


def seeded_head(rows: DataFrame, ident: str, limit: int, seed: str = "0") -> DataFrame:
    """limit rows in seeded order; the easy pool."""
    return rows.orderBy(T.hash_order(F.col(ident), seed=seed), ident).limit(limit)


def fixture_pool(rows: DataFrame, ids: list) -> DataFrame:
    """The rows of given ids, in their order; a missing or repeated id is an error."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["id"]
    listed = spark.createDataFrame(list(enumerate(ids)), f"position int, wanted {kind}")
    joined = listed.join(rows, F.col("wanted") == F.col("id"), "left")
    counted = joined.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("wanted")))
    bad = F.concat(F.when(F.col("id").isNull(), "missing id ").otherwise("repeated id "), F.col("wanted").cast("string"))
    checked = F.when(F.col("id").isNotNull() & (F.col("n") == 1), F.col("position")).otherwise(F.raise_error(bad).cast("int"))
    return counted.withColumn("position", checked).drop("wanted", "n")


def per_split_sample(rows: DataFrame, ident: str, limit: int, seed: str = "0") -> DataFrame:
    """At most limit rows of each split, in seeded order.

    Each task keeps its own best rows of a split before any exchange (a group limit).
    """
    order = Window.partitionBy("split").orderBy(T.hash_order(F.col(ident), seed=seed), ident)
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def problem_splits(problems: DataFrame, ident: str, train: float = 0.8, val: float = 0.1, seed: str = "0") -> DataFrame:
    """Splits by seeded order: the first share of the problems train, the next val, the rest test.

    Every split gets one problem at least, while there are three. Places come from counts per
    bucket of the order, so no task sorts all problems.
    """
    order = T.hash_order(F.col(ident), seed=seed)
    keyed = problems.select(ident).distinct().withColumn("o", order).withColumn("bucket", F.substring("o", 1, 3))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # 4096 buckets at most
    before = sizes.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    before = before.withColumn("total", F.sum("n").over(Window.partitionBy())).drop("n")
    placed = keyed.join(F.broadcast(before), "bucket")  # 4096 rows at most
    place = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("o", ident))
    n = F.col("total")
    n_val = F.greatest(F.lit(1), F.floor(n * val))
    n_test = F.greatest(F.lit(1), n - F.greatest(F.lit(1), F.floor(n * train)) - n_val)
    n_train = n - n_val - n_test
    return placed.withColumn("place", place).select(
        ident,
        F.when(F.col("place") <= n_train, "train").when(
            F.col("place") <= n_train + n_val, "val"
        ).otherwise("test").alias("split")
    )


def padded_token_decoy(ids: Column, vocabulary: int) -> Column:
    """The ids with their first active one moved on by one in the vocabulary: a token decoy."""
    at = F.array_position(F.transform(ids, lambda x: F.when(x > 0, 1).otherwise(0)), 1)
    return F.transform(ids, lambda x, i: F.when(i + 1 == at, F.pmod(x, F.lit(vocabulary - 1)) + 1).otherwise(x))
