"""Surprise, downstream and coverage reports, their gates, and pack accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.ordered import numbered

# The anti-saturation limits.
LEAST_PROBLEMS, SMALLEST_POOL, LARGEST_POOL = 100, 6, 12
BASELINE_CEILINGS = {"no_action": 0.85, "lexical": 0.85, "llm_order": 0.90}
LEAST_DUAL_SHARE = 0.70
# The collapse limits.
COLLAPSE_FLOORS = {"effective_rank_ratio": 0.20, "per_dim_variance_median": 1e-8, "nearest_neighbor_entropy": 0.10}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0; nine digits."""
    return F.round(F.when(whole == 0, 0.0).otherwise(part / whole.cast("double")), 9)


def true_ranks(scores: DataFrame) -> DataFrame:
    """query_id, true_rank: 1 + better decoys + ties // 2, lower scores being better."""
    better, ties = F.count_if(F.col("decoy_score") < F.col("true_score")), F.count_if(
        F.col("decoy_score") == F.col("true_score")
    )
    return scores.groupBy("query_id").agg((1 + better + F.floor(ties / 2)).cast("long").alias("true_rank"))


def surprise_metrics(scores: DataFrame) -> DataFrame:
    """category (and overall), pairs, auc: how often the true one beats a decoy, ties half."""
    won = F.when(F.col("true_score") < F.col("decoy_score"), 1.0).when(
        F.col("true_score") == F.col("decoy_score"), 0.5
    ).otherwise(0.0)
    each = scores.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"), F.sum(won).alias("won"))
    whole = each.agg(F.lit("overall").alias("category"), F.sum("pairs").alias("pairs"), F.sum("won").alias("won"))
    return each.unionByName(whole).select("category", "pairs", F.round(F.col("won") / F.col("pairs"), 9).alias("auc"))


def surprise_rank_summary(scores: DataFrame) -> DataFrame:
    rank = F.col("true_rank")
    return true_ranks(scores).agg(
        F.count(F.lit(1)).alias("examples"),
        F.round(F.avg(rank), 9).alias("mean_true_rank"),
        F.median(rank).alias("median_true_rank"),
        F.round(F.avg(F.when(rank == 1, 1.0).otherwise(0.0)), 9).alias("recall_at_1"),
    )


def pair_count_gates(metrics: DataFrame, least: dict[str, int], floor: float = 0.5) -> DataFrame:
    """category, status, reason: open where there are enough pairs and the area exceeds the floor."""
    spark = metrics.sparkSession
    need = spark.createDataFrame(list(least.items()), "category string, least int")
    joined = need.join(metrics, "category", "left")
    pairs = F.coalesce("pairs", F.lit(0))
    reason = F.when(pairs < F.col("least"), "too_few_pairs").when(~(F.col("auc") > floor), "auc_not_above_floor")
    return joined.select(
        "category",
        pairs.alias("pairs"),
        F.when(reason.isNull(), "open").otherwise("blocked").alias("status"),
        reason.alias("reason")
    )


def min_max(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Adds scaled: the value between its group's extremes, 0.5 where all are equal."""
    span = rows.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = rows.join(span, by)
    scaled = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return joined.withColumn("scaled", scaled).drop("lo", "hi")


def method_report(areas: DataFrame, latent: list[str], least_lift: float = 0.02) -> DataFrame:
    """The best latent method against the best other one: areas, lift, and whether it suffices.

    Areas come from explicit labels and scores; a score that is the label itself proves nothing.
    """
    kind = F.when(F.col("method").isin(*latent), "latent").otherwise("other")
    best = areas.where("auc is not null").groupBy(kind.alias("kind")).agg(F.max(F.struct("auc", "method")).alias("b"))
    one = best.agg(*(F.max(F.when(F.col("kind") == k, F.col("b"))).alias(k) for k in ("latent", "other")))
    lift = F.round(F.col("latent.auc") - F.col("other.auc"), 9)
    return one.select(
        F.col("latent.method").alias("best_latent"),
        F.col("latent.auc").alias("latent_auc"),
        F.col("other.method").alias("best_other"),
        F.col("other.auc").alias("other_auc"),
        lift.alias("lift"),
        F.coalesce(lift >= least_lift, F.lit(False)).alias("lift_ok"),
    )


def error_last(score: str, ident: str) -> list[Column]:
    """Order by rising score; rows without a finite one come last, by id."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(F.col(score)) == float("inf"))
    return [bad.cast("int"), F.when(~bad, F.col(score)), F.col(ident)]


def order_metrics(candidates: DataFrame, task: str, order: list[Column], k: int = 3) -> DataFrame:
    """One row per task: pass_at_1, pass_at_k, mrr, first_pass_rank, valid_rate, check_rate.

    candidates: passed, static_ok and check_ok (booleans) besides what the order needs.
    """
    place = F.row_number().over(Window.partitionBy(task).orderBy(*order))
    first = F.min(F.when(F.col("passed"), F.col("place")))
    n = F.count(F.lit(1))
    each = candidates.withColumn("place", place).groupBy(task).agg(
        first.alias("first_pass_rank"),
        ratio(F.count_if("static_ok"), n).alias("valid_rate"),
        ratio(F.count_if(F.col("static_ok") & F.col("check_ok")), n).alias("check_rate"),
    )
    hit = lambda m: F.when(F.col("first_pass_rank") <= m, 1.0).otherwise(0.0)
    mrr = F.round(F.coalesce(1.0 / F.col("first_pass_rank"), F.lit(0.0)), 9)
    return each.select(
        task,
        hit(1).alias("pass_at_1"),
        hit(k).alias("pass_at_k"),
        mrr.alias("mrr"),
        "first_pass_rank",
        "valid_rate",
        "check_rate"
    )


def downstream_aggregate(tasks: DataFrame) -> DataFrame:
    """Macro means over tasks; the mean first passing rank ignores tasks without one."""
    mean = lambda c: F.round(F.avg(c), 9).alias(c)
    columns = [mean(c) for c in ("pass_at_1", "pass_at_k", "mrr", "valid_rate", "check_rate")]
    return tasks.agg(
        F.count(F.lit(1)).alias("tasks"), *columns, F.round(F.avg("first_pass_rank"), 9).alias("mean_first_pass_rank")
    )


def availability(candidates: DataFrame, scores: dict[str, str]) -> DataFrame:
    """baseline, finite_scores, status: blocked where no candidate has a finite score."""
    finite = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    one = candidates.agg(
        F.array(*(F.struct(F.lit(b).alias("baseline"), finite(c).alias("finite_scores")) for b, c in scores.items())).alias("x")
    )
    return one.select(F.explode("x").alias("x")).select(
        "x.baseline", "x.finite_scores", F.when(F.col("x.finite_scores") > 0, "completed").otherwise("blocked").alias("status")
    )


def next_in_order(tasks: DataFrame, task: str, value: str) -> DataFrame:
    """task, shifted: the value of the next task in order, the last one's the first: a control."""
    placed = numbered(tasks.select(task, value), task, name="place")
    n = placed.agg(F.max("place") + 1).first()[0] or 1
    following = placed.select(F.pmod(F.col("place") - 1, F.lit(n)).alias("place"), F.col(value).alias("shifted"))
    return placed.join(following, "place").select(task, "shifted")


def pool_baselines(candidates: DataFrame, task: str, orders: dict[str, list[Column]]) -> DataFrame:
    """One row: problems, pool sizes, expected random pass@1, dual-class share, pass@1 of each order.

    candidates: passed, failure_class. An order is a list of columns, each rising with nulls first;
    of each only the first candidate counts, so every task keeps one for each order and no pool is
    sorted or gathered.
    """
    first = lambda order: F.min(F.struct(*order, F.col("passed")))["passed"]
    firsts = [F.when(first(order), 1.0).otherwise(0.0).alias(n) for n, order in orders.items()]
    classes = F.size(F.collect_set(F.when(~F.col("passed"), F.col("failure_class"))))
    each = candidates.groupBy(task).agg(
        F.count(F.lit(1)).alias("pool"), F.count_if("passed").alias("passes"), classes.alias("classes"), *firsts
    )
    return each.agg(
        F.count(F.lit(1)).alias("problems"),
        F.min("pool").alias("pool_min"),
        F.max("pool").alias("pool_max"),
        F.round(F.avg(F.col("passes") / F.col("pool")), 9).alias("expected_random"),
        F.round(F.avg(F.when(F.col("classes") >= 2, 1.0).otherwise(0.0)), 9).alias("dual_share"),
        *(F.round(F.avg(n), 9).alias(n) for n in orders),
    )


def anti_saturation_gate(baselines: DataFrame, upstream: dict[str, bool] | None = None) -> DataFrame:
    """eligible, blocked_reasons: the typed reasons why a benchmark is too easy or too thin."""
    rules = [
        ("problem_count_below_minimum", F.col("problems") < LEAST_PROBLEMS),
        ("candidate_pool_size_out_of_range", (F.col("pool_min") < SMALLEST_POOL) | (F.col("pool_max") > LARGEST_POOL)),
        *((f"saturated_baseline_{b}", F.col(b) > top) for b, top in BASELINE_CEILINGS.items() if b in baselines.columns),
        ("dual_hard_negative_coverage_below_minimum", F.col("dual_share") < LEAST_DUAL_SHARE),
        *((f"{name}_not_ok", F.lit(not ok)) for name, ok in (upstream or {}).items()),
    ]
    reasons = F.filter(F.array(*(F.when(rule, name) for name, rule in rules)), lambda x: x.isNotNull())
    return baselines.select((F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, ",").alias("blocked_reasons"))


def strict_gate(metrics: DataFrame, method: str, baselines: list[str], values: list[str]) -> DataFrame:
    """baseline, deltas of each value, better: open only if the method is strictly better in all."""
    own = metrics.where(F.col("method") == method).select(*(F.col(v).alias(f"own_{v}") for v in values))
    rows = metrics.where(F.col("method").isin(*baselines)).join(F.broadcast(own.limit(1)))  # one row
    better = F.lit(True)
    for v in values:
        better = better & (F.col(f"own_{v}") > F.col(v))
    deltas = [F.round(F.col(f"own_{v}") - F.col(v), 9).alias(f"delta_{v}") for v in values]
    return rows.select(F.col("method").alias("baseline"), *deltas, better.alias("better"))


def interval_gate(intervals: DataFrame) -> DataFrame:
    """baseline, metric, lift, low, blocker: whether a lift is above zero with its whole interval.

    intervals: of :func:`resample.lift_intervals`. A lift that isn't positive blocks a claim, as do
    an interval that is missing or begins at or below zero.
    """
    blocker = (
        F.when(~F.coalesce(F.col("lift") > 0, F.lit(False)), "lift_not_positive")
        .when(F.col("low").isNull(), "interval_missing")
        .when(F.col("low") <= 0, "interval_includes_zero")
    )
    return intervals.select("baseline", "metric", "lift", "low", blocker.alias("blocker"))


def collapse_gate(report: DataFrame) -> DataFrame:
    """metric, observed, comparison: failures of a one-row collapse report."""
    rows = F.array(
        *(
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).cast("double").alias("observed"),
                F.lit(COLLAPSE_FLOORS.get(m)).cast("double").alias("floor")
            ) for m in report.columns
        )
    )
    each = report.select(F.explode(rows).alias("x")).select("x.*")
    odd = F.isnan("observed") | (F.abs(F.col("observed")) == float("inf"))
    kind = F.when(odd, "finite").when(F.col("observed") < F.col("floor"), "minimum")
    return each.select("metric", "observed", kind.alias("comparison")).where("comparison is not null")


def label_coverage(rows: DataFrame, targets: list[str], least_classes: int = 2, least_rows: int = 1) -> DataFrame:
    """target, train_classes, val_rows, test_rows, status: whether a probe target can be evaluated."""
    stack = F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("label")) for t in targets))
    long = rows.select("split", F.explode(stack).alias("x")).select("split", "x.target", "x.label")
    count = lambda s: F.count_if((F.col("split") == s) & F.col("label").isNotNull())
    c = long.groupBy("target").agg(
        F.count_distinct(F.when(F.col("split") == "train", F.col("label"))).alias("train_classes"),
        count("val").alias("val_rows"),
        count("test").alias("test_rows")
    )
    ok = (F.col("train_classes") >= least_classes) & (F.col("val_rows") >= least_rows) & (F.col("test_rows") >= least_rows)
    return c.withColumn("status", F.when(ok, "available").otherwise("blocked"))


def representation_table(probes: DataFrame, controls: DataFrame, seeds: DataFrame, targets: list[str]) -> DataFrame:
    """seed, target, best_probe, best_control, lift, status for every seed and wanted target.

    probes, controls: seed, target, accuracy.
    """
    want = seeds.select("seed", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    best = lambda df, name: df.groupBy("seed", "target").agg(F.max("accuracy").alias(name))
    joined = want.join(best(probes, "best_probe"), ["seed", "target"], "left").join(
        best(controls, "best_control"), ["seed", "target"], "left"
    )
    return joined.withColumn("lift", F.round(F.col("best_probe") - F.col("best_control"), 12)).withColumn(
        "status", F.when(F.col("best_probe").isNotNull(), "available").otherwise("not_evaluable")
    )


def survivor_reason(exit_code: Column, deterministic: Column, shown: Column, truncated: Column) -> Column:
    """Why a sandbox result doesn't enter a pack; null if it does."""
    return (
        F.when(~exit_code.isin("ok", "raised"), F.concat(F.lit("sandbox_"), exit_code))
        .when(~deterministic, "nondeterministic")
        .when(shown.isNull() & (exit_code == "ok"), "missing_output_repr")
        .when(truncated, "output_truncated")
    )


def record_kind(output_kind: Column, output_type: Column) -> Column:
    """The coarse category of an execution record."""
    return (
        F.when(output_kind.isin("exception", "stdout"), output_kind)
        .when(output_type == "int", "value-int")
        .when(output_type == "float", "value-numeric")
        .when(output_type == "str", "value-string")
        .when(output_type.isin("list", "tuple", "dict", "set", "bytes"), "value-collection")
        .when(output_type == "bool", "value-bool")
        .when(output_type == "none", "value-none")
        .otherwise("other")
    )


def magnitude_bucket(value: Column) -> Column:
    return F.when(value < 0, "negative").when(value == 0, "zero").when(value <= 10, "small").when(
        value <= 1000, "medium"
    ).when(value > 1000, "large")


def length_bucket(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n <= 5, "short").when(n <= 50, "medium").when(n <= 1000, "long").when(n > 1000, "huge")


def probe_labels(rows: DataFrame) -> DataFrame:
    """Adds the execution probe labels: passed, will_raise, output type, kind and buckets.

    will_raise follows status raised or type exception, not the kind of the output.
    """
    raised = (F.col("execution_status") == "raised") | (F.col("output_type") == "exception")
    return (
        rows.withColumn("will_raise", F.coalesce(raised, F.lit(False)))
        .withColumn("record_kind", record_kind(F.col("output_kind"), F.col("output_type")))
        .withColumn(
            "output_magnitude_bucket",
            F.when(F.col("output_type").isin("int", "float"), magnitude_bucket(F.col("output_value").cast("double")))
        )
        .withColumn(
            "output_length_bucket",
            F.when(
                F.col("output_type").isin("str", "list", "tuple", "dict", "set", "bytes"), length_bucket(F.col("output_length"))
            )
        )
    )


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n for each of several columns, in one pass; null is 'missing'."""
    stack = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value")
            ) for c in columns
        )
    )
    return rows.select(F.explode(stack).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def loader_diagnostics(rows: DataFrame, ids: str, width: int) -> DataFrame:
    """rows, truncated, empty, active ids: what padding to a width keeps and cuts."""
    n = F.size(F.col(ids))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(n > width).alias("truncated"),
        F.count_if(n == 0).alias("empty"),
        F.sum(F.least(n, F.lit(width))).cast("long").alias("active"),
        F.sum(F.greatest(n - width, F.lit(0))).cast("long").alias("cut"),
    )


def pass_fail_records(completions: DataFrame, expected: DataFrame, results: DataFrame) -> DataFrame:
    """Completions x inputs of their problem with results: passed is equality of output hashes.

    completions: problem_id, completion_id; expected: problem_id, input_id, expected_hash;
    results: completion_id, input_id, output_hash. A completion without a result fails.
    """
    cases = completions.join(expected, "problem_id").join(results, ["completion_id", "input_id"], "left")
    return cases.withColumn("passed", F.coalesce(F.col("output_hash") == F.col("expected_hash"), F.lit(False)))


def pass_fail_counts(completions: DataFrame, expected: DataFrame, results: DataFrame) -> DataFrame:
    """problem_id, cases, passed: :func:`pass_fail_records` counted for each problem with a case.

    The same columns, and at most one result for a completion and input. Cases are completions
    times inputs of a problem, and results are counted by input and hash before they meet what
    is expected, so no case is a row of its own.
    """
    n = lambda name: F.count(F.lit(1)).alias(name)
    cases = completions.groupBy("problem_id").agg(n("_c")).join(expected.groupBy("problem_id").agg(n("_e")), "problem_id")
    found = completions.select("problem_id", "completion_id").join(results, "completion_id")
    hashes = found.groupBy("problem_id", "input_id", F.col("output_hash").alias("expected_hash")).agg(n("_n"))
    passed = hashes.join(
        expected, ["problem_id", "input_id", "expected_hash"]
    ).groupBy("problem_id").agg(F.sum("_n").alias("passed"))
    return cases.join(passed, "problem_id", "left").select(
        "problem_id", (F.col("_c") * F.col("_e")).alias("cases"), F.coalesce("passed", F.lit(0)).cast("long").alias("passed")
    )


def candidate_labels(cases: DataFrame, ident: str) -> DataFrame:
    """ident, label: pass only if every case is ok and its output equal."""
    good = F.coalesce((F.col("exit_code") == "ok") & (F.col("output") == F.col("expected")), F.lit(False))
    return cases.groupBy(ident).agg(
        F.when(F.bool_and(good), "pass").otherwise("fail").alias("label"), F.count(F.lit(1)).alias("cases")
    )


def mutation_pack(references: DataFrame, mutants: DataFrame, pool_size: int = 6, seed: str = "0") -> DataFrame:
    """problem_id, candidate_id, passed, rank: the passing reference with failing mutants, shuffled.

    references, mutants: problem_id, candidate_id, passed, ordinal. Problems whose reference
    fails or that have too few failing mutants are dropped.
    """
    failing = mutants.where(~F.col("passed")).withColumn(
        "n", F.row_number().over(Window.partitionBy("problem_id").orderBy("ordinal", "candidate_id"))
    ).where(F.col("n") <= pool_size - 1)
    enough = failing.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == pool_size - 1)
    good = references.where("passed").join(enough.select("problem_id"), "problem_id", "left_semi")
    both = good.select("problem_id", "candidate_id", "passed").unionByName(
        failing.join(good.select("problem_id"), "problem_id", "left_semi").select("problem_id", "candidate_id", "passed")
    )
    order = Window.partitionBy("problem_id").orderBy(
        T.hash_order(F.col("problem_id"), F.col("candidate_id"), seed=seed), "candidate_id"
    )
    return both.withColumn("rank", F.row_number().over(order) - 1)


def readiness(candidates: DataFrame, task: str, least_tasks: int = 20) -> DataFrame:
    """tasks, labelled, both_labels, blockers of a benchmark pack."""
    each = candidates.groupBy(task).agg(
        F.count_if(F.col("label").isNotNull()).alias("labelled"),
        F.count_if(F.col("label") == "pass").alias("good"),
        F.count_if(F.col("label") == "fail").alias("bad")
    )
    one = each.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("labelled").alias("labelled"),
        F.count_if((F.col("good") > 0) & (F.col("bad") > 0)).alias("both_labels")
    )
    rules = [
        ("too_few_tasks", F.col("tasks") < least_tasks),
        ("no_labels", F.col("labelled") == 0),
        ("no_task_with_both_labels", F.col("both_labels") == 0)
    ]
    return one.withColumn(
        "blockers", F.array_join(F.filter(F.array(*(F.when(r, n) for n, r in rules)), lambda x: x.isNotNull()), ",")
    )


def prompt_or_id(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds prompt by problem_id: the last written one; without any, the problem's id."""
    last = prompts.where("prompt is not null").groupBy("problem_id").agg(F.max_by("prompt", "ordinal").alias("prompt"))
    return rows.join(last, "problem_id", "left").withColumn("prompt", F.coalesce("prompt", "problem_id"))


def timeline(steps: DataFrame) -> DataFrame:
    """run_id, steps, status, duration_ms, problem: one row per run.

    steps: run_id, step (from 1), status, duration_ms, failure. A run failed if a step did;
    orders with gaps and failed steps without a typed failure are named in problem.
    """
    c = steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"), F.min("step").alias("lo"), F.max("step").alias("hi"), F.count_distinct("step").alias("distinct"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(
            (F.col("status") == "failed") & F.col("failure").isNull()
        ).alias("untyped"),
        F.sum("duration_ms").alias("duration_ms"),
    )
    gaps = (F.col("lo") != 1) | (F.col("hi") != F.col("steps")) | (F.col("distinct") != F.col("steps"))
    problem = F.when(gaps, "step_order_not_contiguous").when(F.col("untyped") > 0, "failed_step_without_typed_failure")
    return c.select(
        "run_id",
        "steps",
        F.when(F.col("failed") > 0, "failed").otherwise("completed").alias("status"),
        "duration_ms",
        problem.alias("problem")
    )


def ablation(completed: DataFrame, variants: list[str]) -> DataFrame:
    """A row for every wanted variant: its metric, or blocked; none is dropped."""
    want = completed.sparkSession.createDataFrame([(v,) for v in variants], "variant string")
    return want.join(completed, "variant", "left").withColumn(
        "status", F.when(F.col("metric").isNull(), "blocked").otherwise("completed")
    )


def claim_audit(gates: DataFrame, required: list[str]) -> DataFrame:
    """eligible, missing, wording: what a set of strict gates (baseline, better) lets one claim."""
    seen = F.collect_set("baseline")
    missing = F.array_except(F.array(*map(F.lit, required)), seen)
    one = gates.agg(missing.alias("missing"), F.coalesce(F.bool_and("better"), F.lit(False)).alias("better"))
    eligible = (F.size("missing") == 0) & F.col("better")
    wording = F.when(eligible, "improves_over_required_baselines").when(
        F.size("missing") > 0, "inconclusive_missing_baselines"
    ).otherwise("no_improvement_claim")
    return one.select(
        eligible.alias("eligible"), F.array_join(F.array_sort("missing"), ",").alias("missing"), wording.alias("wording")
    )
