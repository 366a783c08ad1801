"""Reports that count one table many ways in one scan: grouping sets, pivots, zero cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import classify

#: How a report names a null value.
MISSING = "missing"


def _sets(rows: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """Aggregates of rows over several lists of columns at once, with the number of the list as ``s``."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    ids = {sum(1 << len(columns) - 1 - i for i, c in enumerate(columns) if c not in s): n for n, s in enumerate(sets)}
    number = F.element_at(F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)), F.grouping_id().cast("int"))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(number.alias("s"), *measures)


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def histograms(rows: DataFrame, columns: list[str], domains: dict[str, list[str]] | None = None) -> DataFrame:
    """column, value, n of every column, by one scan; values of a column's domain that don't occur have 0."""
    found = _sets(rows, [[c] for c in columns], [F.count(F.lit(1)).alias("n")])
    pick = lambda of: F.element_at(F.array(*of), F.col("s") + 1)
    found = found.select(pick([F.lit(c) for c in columns]).alias("column"), pick([_name(c) for c in columns]).alias("value"), "n")
    return _with_zeros(found, [(c, v) for c, vs in (domains or {}).items() for v in vs], "column string, value string")


def _with_zeros(found: DataFrame, cells: list[tuple], schema: str) -> DataFrame:
    if not cells:
        return found
    keys = [part.split()[0] for part in schema.split(", ")]
    zero = found.sparkSession.createDataFrame(cells, schema).withColumn("n", F.lit(0).cast("long"))
    return found.unionByName(zero).groupBy(*keys).agg(F.sum("n").alias("n"))


def loader_report(rows: DataFrame, widths: dict[str, int], columns: list[str], domains: dict[str, list[str]] | None = None) -> DataFrame:
    """report, value, n: rows, how many arrays are longer than their width, and histograms; one scan.

    widths: array columns and what they are cut to. Reports are record_count, truncated_<column>
    (both with an empty value) and <column>_histogram.
    """
    measures = [F.count(F.lit(1)).alias("n"), *(F.count_if(F.size(c) > w).alias(f"truncated_{c}") for c, w in widths.items())]
    found = _sets(rows, [[c] for c in columns] + [[]], measures)
    whole = F.array(
        *(F.struct(F.lit(name).alias("report"), F.lit("").alias("value"), F.col(c).alias("n"))
          for name, c in [("record_count", "n"), *((f"truncated_{c}", f"truncated_{c}") for c in widths)])
    )
    each = F.array(*(F.struct(F.lit(f"{c}_histogram").alias("report"), _name(c).alias("value"), F.col("n")) for c in columns))
    last = F.col("s") == len(columns)
    rows_ = found.select(F.explode(F.when(last, whole).otherwise(F.array(F.get(each, F.col("s"))))).alias("x")).select("x.*")
    always = [("record_count", ""), *((f"truncated_{c}", "") for c in widths)]  # an empty table has no grand total
    return _with_zeros(rows_, always + [(f"{c}_histogram", v) for c, vs in (domains or {}).items() for v in vs], "report string, value string")


def cross_tables(rows: DataFrame, tables: dict[str, tuple[str, str]]) -> DataFrame:
    """table, row, column, n: several tables of two columns by one scan, with every cell of each.

    A table has a row and a column for each value that occurs in it, so pairs that never meet
    have 0. Nulls are named ``missing``.
    """
    names = list(tables)
    found = _sets(rows, [list(tables[t]) for t in names], [F.count(F.lit(1)).alias("n")])
    pick = lambda of: F.element_at(F.array(*of), F.col("s") + 1)
    cells = found.select(
        pick([F.lit(t) for t in names]).alias("table"),
        pick([_name(tables[t][0]) for t in names]).alias("row"),
        pick([_name(tables[t][1]) for t in names]).alias("column"),
        "n",
    )
    every = cells.select("table", "row").distinct().join(cells.select("table", "column").distinct(), "table")
    return every.join(cells, ["table", "row", "column"], "left").fillna(0, ["n"])


def pivoted(cells: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One table of :func:`cross_tables` as rows with a column for each of some values, 0 without a cell."""
    return cells.where(F.col("table") == table).groupBy("row").pivot("column", columns).agg(F.sum("n")).fillna(0)


def _parsed(scores: Column) -> Column:
    """A JSON object as a variant; numbers that JSON doesn't have are objects in it."""
    return F.try_parse_json(F.regexp_replace(scores, r':\s*-?(NaN|Infinity)\s*(?=[,}])', ': {"nonfinite": true}'))


def score_kind(scores: Column, name: str) -> Column:
    """missing, invalid, nonfinite or usable: what a JSON object has under a name.

    A number is usable; true, null, texts and lists are invalid; NaN and infinities, which some
    writers of JSON put in, are nonfinite. An object that can't be read has nothing.
    """
    value = F.variant_get(_parsed(scores), f"$['{name}']", "variant")
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    huge = F.abs(F.try_variant_get(value, "$", "double")) == float("inf")
    return (
        F.when(value.isNull(), "missing")
        .when(number & ~F.coalesce(huge, F.lit(False)), "usable")
        .when(number | F.try_variant_get(value, "$.nonfinite", "boolean"), "nonfinite")
        .otherwise("invalid")
    )


def score_value(scores: Column, name: str) -> Column:
    return F.try_variant_get(_parsed(scores), f"$['{name}']", "double")


def calibration_report(rows: DataFrame, baselines: list[str], slices: tuple[str, ...] = ("benchmark", "split"), threshold: float = 0.5) -> DataFrame:
    """baseline, slice, value: accounts, areas and threshold metrics over all rows and over slices.

    rows: row_id, passed (boolean), scores (a JSON object as text) and the columns of the slices.
    Counts of all slices come from one scan of grouping sets. status is ``missing`` if no row has
    the score, ``no_finite_scores``, ``single_class`` (no areas then) or ``ok``.
    """
    each = rows.withColumn("b", F.explode(F.array(*(F.struct(F.lit(b).alias("baseline"), score_kind(F.col("scores"), b).alias("kind"), score_value(F.col("scores"), b).alias("score")) for b in baselines))))
    each = each.select("row_id", F.col("passed").cast("int").alias("label"), *slices, "b.baseline", "b.kind", F.when(F.col("b.kind") == "usable", F.col("b.score")).alias("score"))
    each = each.withColumn("p", T.probability(F.col("score")))
    usable, pos, yes = F.col("kind") == "usable", F.col("label") == 1, F.col("p") >= threshold
    counts = _sets(
        each,
        [["baseline"], *(["baseline", s] for s in slices)],
        [
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(usable).alias("usable"),
            F.count_if(usable & pos).alias("positive"),
            F.count_if(usable & ~pos).alias("negative"),
            *(F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "invalid", "nonfinite")),
            F.count_if(usable & yes & pos).alias("tp"),
            F.count_if(usable & yes & ~pos).alias("fp"),
            F.avg(F.when(usable, F.pow(F.col("p") - F.col("label"), 2))).alias("brier"),
        ],
    )
    named = F.element_at(F.array(*map(F.lit, ("overall", *slices))), F.col("s") + 1)
    value = F.element_at(F.array(F.lit(""), *(_name(s) for s in slices)), F.col("s") + 1)
    counts = counts.withColumn("slice", named).withColumn("value", value)
    status = (
        F.when((F.col("usable") == 0) & (F.col("missing") == F.col("row_count")), "missing")
        .when(F.col("usable") == 0, "no_finite_scores")
        .when((F.col("positive") == 0) | (F.col("negative") == 0), "single_class")
        .otherwise("ok")
    )
    stack = F.array(F.struct(F.lit("overall").alias("slice"), F.lit("").alias("value")), *(F.struct(F.lit(s).alias("slice"), _name(s).alias("value")) for s in slices))
    sliced = each.where(usable).withColumn("x", F.explode(stack)).withColumn("group", F.concat_ws("\0", "baseline", "x.slice", "x.value"))
    areas = classify.roc_auc(sliced.select("group", "score", "label", "row_id"), "group").join(
        classify.precision_areas(sliced.select("group", "score", "label", "row_id"), "group").select("group", "average_precision"), "group"
    )
    joined = counts.withColumn("group", F.concat_ws("\0", "baseline", "slice", "value")).join(areas, "group", "left")
    ok = status == "ok"
    return joined.select(
        "baseline", "slice", "value", status.alias("status"), "row_count", "usable", "positive", "negative", "missing", "invalid", "nonfinite",
        F.when(ok, F.col("auc")).alias("roc_auc"), F.when(ok, F.col("average_precision")).alias("average_precision"), F.round("brier", 9).alias("brier"), "tp", "fp",
    )
