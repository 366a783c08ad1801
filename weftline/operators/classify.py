"""Binary scores against labels: areas, thresholds, calibration, baselines, F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

BINS = 10


#: Ranges of scores that running sums are cut into, for each group.
RANGES = 256


def _ranges(rows: DataFrame, by: str) -> Column:
    """The range of a row's score in its group: 0 has the lowest scores.

    Borders are approximate percentiles, at most ``RANGES`` numbers a group; groups are few
    (methods), so their borders may be literals of the plan.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    found = rows.groupBy(by).agg(F.percentile_approx("score", shares, 10_000).alias("cuts")).collect()  # a row for each method
    chosen = F.lit(0)
    for r in found:
        cuts = sorted(set(r.cuts or []))
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("score"))) if cuts else F.lit(0)
        chosen = F.when(F.col(by) == r[by], place).otherwise(chosen)
    return chosen.cast("int")


def _before(sums: DataFrame, by: str, columns: list[str], falling: bool = False) -> DataFrame:
    """For each group and range: the sums of all ranges before it, as before_<column>."""
    order = F.desc("range") if falling else F.asc("range")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    return sums.select(by, "range", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c in columns))


def roc_auc(rows: DataFrame, by: str = "method") -> DataFrame:
    """Area by average ranks (ties count half); null if a group has one class.

    Counts of each score are taken first; running sums go over the scores of one range, plus
    the sums of the ranges below, so no group is one task.
    """
    label = F.col("label").cast("long")
    return counted_auc(rows.groupBy(by, "score").agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg")), by)


def counted_auc(rows: DataFrame, by: str) -> DataFrame:
    """:func:`roc_auc` of counts: by, score, pos, neg; a score may come in several rows."""
    sums = rows.groupBy(by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = stored(sums, "scores")  # once for the ranges, once for the sums
    counts = counts.withColumn("range", _ranges(counts, by))
    before = _before(counts.groupBy(by, "range").agg(F.sum("neg").alias("neg")), by, ["neg"])
    inside = F.coalesce(
        F.sum("neg").over(Window.partitionBy(by, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    joined = counts.withColumn("inside", inside).join(before, [by, "range"])
    wins = joined.withColumn("wins", F.col("pos") * (F.col("before_neg") + F.col("inside") + F.col("neg") / 2.0))
    total = wins.groupBy(by).agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(
        by,
        F.round(
            F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n")).cast("double")), 9
        ).alias("auc")
    )


def precision_areas(rows: DataFrame, by: str = "method", ident: str = "row_id") -> DataFrame:
    """Average precision and the step-wise area, by falling score, ties by id.

    Places and true positives are counted within ranges of scores, plus those of higher ranges.
    """
    label = F.col("label").cast("long")
    ranged = rows.withColumn("range", _ranges(rows, by)).withColumn("one", F.lit(1))
    sums = ranged.groupBy(by, "range").agg(F.sum("one").alias("one"), F.sum(label).alias("label"))
    before = _before(sums, by, ["one", "label"], falling=True)
    w = Window.partitionBy(by, "range").orderBy(F.desc("score"), ident)
    placed = ranged.withColumn("place", F.row_number().over(w)).withColumn(
        "tp", F.sum(label).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = placed.join(before, [by, "range"])
    precision = F.when(
        F.col("label") == 1, (F.col("tp") + F.col("before_label")) / (F.col("place") + F.col("before_one")).cast("double")
    )
    return joined.groupBy(by).agg(
        F.round(F.avg(precision), 9).alias("average_precision"),
        F.round(F.sum(precision) / F.sum(label), 9).alias("pr_auc_step")
    )


def threshold_metrics(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a denominator is empty; Brier score."""
    yes, pos = F.col("p") >= threshold, F.col("label") == 1
    c = rows.groupBy(*by).agg(
        F.count_if(yes & pos).alias("tp"),
        F.count_if(yes & ~pos).alias("fp"),
        F.count_if(~yes & pos).alias("fn"),
        F.count_if(~yes & ~pos).alias("tn"),
        F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier")
    )
    ratio = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b.cast("double")), 9)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.round("brier", 9).alias("brier")
    )


def calibration_bins(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """bin, n, mean_p, share: equal widths; empty bins have n 0 and nulls."""
    filled = rows.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("p"), 9).alias("mean_p"),
        F.round(F.avg(F.col("label").cast("double")), 9).alias("share")
    )
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(filled), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "share")


def expected_calibration_error(rows: DataFrame, bins: int = BINS) -> DataFrame:
    b = calibration_bins(rows, bins).where("n > 0")
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n"), 6).alias("ece"))


def majority(rows: DataFrame, label: str, *by: str) -> DataFrame:
    """Commonest label (ties: the smallest) of each group."""
    counts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("v"))).alias("m")
    ).select(*by, F.col("m.v").alias("majority"))


def macro_f1(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """accuracy and macro_f1 over all labels that occur on either side."""
    pair = rows.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = pair.select(
        F.explode(
            F.array(
                F.struct(
                    F.col(actual).alias("label"),
                    F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("act"),
                    F.lit(0).cast("long").alias("pred")
                ),
                F.struct(
                    F.col(predicted).alias("label"),
                    F.lit(0).cast("long").alias("tp"),
                    F.lit(0).cast("long").alias("act"),
                    F.col("n").alias("pred")
                )
            )
        ).alias("x")
    ).select("x.*")
    each = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("act").alias("act"), F.sum("pred").alias("pred"))
    f1 = F.when(F.col("act") + F.col("pred") == 0, 0.0).otherwise(2.0 * F.col("tp") / (F.col("act") + F.col("pred")))
    return each.agg(
        F.round(F.sum("tp") / F.sum("act").cast("double"), 9).alias("accuracy"), F.round(F.avg(f1), 9).alias("macro_f1")
    )
