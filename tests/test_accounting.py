"""Row accounts counted by the jobs that write the stages."""

from pyspark.sql import functions as F

from weftline.operators import accounting, curation


def flagged(df):
    return df.withColumn("drop_reason", F.when(F.col("id") % 3 == 0, "third").when(F.col("id") % 7 == 0, "odd"))


def test_accounts_of_a_run(spark):
    stages = [("filter", flagged), ("double", lambda df: df.select(F.explode(F.array("id", "id")).alias("id"))), ("once", lambda df: df.distinct())]
    rows, accounts = accounting.run_stages(spark.range(100), stages, {"filter": ["third"]})
    got = {r.stage: (r.read, r.written, r.dropped) for r in accounts.collect()}
    kept = sum(i % 3 != 0 and i % 7 != 0 for i in range(100))
    assert got == {"filter": (100, kept, {"third": 34, "other": 66 - kept}), "double": (kept, 2 * kept, {}), "once": (2 * kept, kept, {})} and rows.count() == kept
    held = {r.equality: r.holds for r in accounting.equalities(accounts, 100).collect()}
    assert held == dict.fromkeys(["loaded_equals_filter_input", "filter_output_equals_double_input", "double_output_equals_once_input", "filter_kept_and_dropped_equal_input"], True)
    assert not accounting.equalities(accounts, 99).where("equality like 'loaded%'").first().holds


def test_a_lost_row_shows(spark):
    accounts = spark.createDataFrame([(0, "a", 10, 7, {"x": 2}, "source"), (1, "b", 6, 6, {}, "a")], accounting.ACCOUNT)
    assert {r.equality: (r.left, r.right) for r in accounting.equalities(accounts).where("not holds").collect()} == {
        "a_kept_and_dropped_equal_input": (9, 10), "a_output_equals_b_input": (7, 6),
    }


def test_split_deduplication_reads_once(spark):
    rows = spark.createDataFrame([(i, ("train", "val", "test")[i % 3], f"p{i // 2}", f"t{i // 4}") for i in range(60)], "i long, split string, pair string, transition string")
    stage = lambda df: curation.split_dedup(df, "transition", "pair", "i")
    out, accounts = accounting.run_stages(rows, [("split_dedup", stage)], {"split_dedup": ["train_leakage", "exact_duplicate"]})
    row = accounts.first()
    assert row.read == 60 and row.written == out.count() and row.written + sum(row.dropped.values()) == 60


def test_empty_input(spark):
    rows, accounts = accounting.run_stages(spark.range(0), [("filter", flagged)], {"filter": ["third"]})
    assert rows.count() == 0 and accounts.first().dropped == {"third": 0} and accounts.first().read == 0
