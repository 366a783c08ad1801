"""Queries of crossed reports: loader diagnostics, cross tables, calibration accounts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounting as A
from ..operators import crossed as C
from ..operators.curation import keep_first
from ..streaming import runs
from .common import LICENSED_SQL, read, records

ROLES = ["assistant", "system", "tool", "user"]
KINDS = 8


def loader_histograms(s, d):
    """Turns as records: tokens cut to 16, words to 40, by role, first letter's class and turn."""
    rows = read(s, d, "conversations").select(
        T.tokens(F.col("text"), T.NAME_TOKEN).alias("ids"),
        F.split("text", " ").alias("words"),
        "role",
        F.when(F.col("text").rlike("^[A-Z]"), "upper").when(F.col("text").rlike("^[a-z]"), "lower").alias("first_letter"),
        F.least("turn", F.lit(5)).alias("turn"),
    )
    return C.loader_report(rows, {"ids": 16, "words": 40}, ["role", "first_letter", "turn"], {"role": ROLES})


def cross_tables(s, d):
    li = read(s, d, "lineitem").join(read(s, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    tables = {"flag_status": ("l_returnflag", "l_linestatus"), "priority_flag": ("o_orderpriority", "l_returnflag"), "line_status": ("l_linenumber", "l_linestatus")}
    return C.cross_tables(li, tables)


def flag_status_pivot(s, d):
    cells = C.cross_tables(read(s, d, "lineitem"), {"flag_status": ("l_returnflag", "l_linestatus")})
    return C.pivoted(cells, "flag_status", ["F", "O", "X"]).select(F.col("row").alias("l_returnflag"), F.col("F").alias("f"), F.col("O").alias("o"), F.col("X").alias("x"))


def calibration_report(s, d):
    """Documents as scored rows: passed by length, scores that are numbers, odd or missing by id."""
    k = F.col("doc_id") % KINDS
    length = F.format_string("%.6f", F.col("n_chars") / 20000.0)
    long = (
        F.when(k == 0, "{}").when(k == 1, '{"length": true}').when(k == 2, '{"length": NaN, "other": 1}').when(k == 3, '{"length": "0.5"}')
        .when(k == 4, '{"length": null}').otherwise(F.concat(F.lit('{"length": '), length, F.lit(', "other": 3}')))
    )
    rows = read(s, d, "documents").select(
        F.col("doc_id").alias("row_id"), (F.col("doc_id") % 3 == 0).alias("passed"), long.alias("scores"), F.col("lang").alias("benchmark"), F.col("source").alias("split")
    )
    report = C.calibration_report(rows, ["length", "other", "none"])
    return report.withColumns({c: F.round(c, 6) for c in ("average_precision", "brier")})


def observed_accounting(s, d):
    """Documents through the licence gate and exact deduplication: what each job counted while it wrote."""
    gate = lambda df: df.withColumn("drop_reason", F.when(~F.col("decision.allowed"), F.col("decision.reason")))
    once = lambda df: keep_first(df, "pair", "doc_id").withColumn("drop_reason", F.when(F.col("first_id") != F.col("doc_id"), "exact_duplicate"))
    docs = records(s, d)
    _, accounts = A.run_stages(docs, [("gate", gate), ("once", once)], {"gate": ["missing_license", "license_not_allowed"], "once": ["exact_duplicate"]})
    return A.equalities(accounts, docs.count())


def run_states(s, d):
    """Each user's events as a run: every fifth event and every eleventh step has lost its number, errors end it."""
    e = read(s, d, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    event = F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    known = (F.col("event_id") % 5 != 0) & (F.col("step") % 11 != 0)
    steps = e.select(F.col("user_id").cast("string").alias("run_id"), event.alias("event"), F.when(known, F.col("step")).alias("step"), "ts")
    return runs.run_states(steps).select("run_id", "events", "steps", "contiguous", "highest", "missing", "latest_event", "status")


QUERIES = {f.__name__: f for f in (loader_histograms, cross_tables, flag_status_pivot, calibration_report, observed_accounting, run_states)}

ORACLES = {
    "loader_histograms": r"""WITH r AS (SELECT len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS ids, len(string_split(text, ' ')) AS words, role,
        CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'upper' WHEN regexp_matches(text, '^[a-z]') THEN 'lower' ELSE 'missing' END AS fl, least(turn, 5)::VARCHAR AS turn
        FROM conversations), h AS (SELECT 'role_histogram' AS report, role AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'first_letter_histogram', fl, count(*) FROM r
        GROUP BY ALL UNION ALL SELECT 'turn_histogram', turn, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'role_histogram', unnest(['assistant', 'system', 'tool', 'user']), 0)
        SELECT report, value, sum(n)::BIGINT AS n FROM h GROUP BY ALL UNION ALL SELECT 'record_count', '', count(*) FROM r UNION ALL SELECT 'truncated_ids', '', count(*)
        FILTER (WHERE ids > 16) FROM r UNION ALL SELECT 'truncated_words', '', count(*) FILTER (WHERE words > 40) FROM r""",
    "cross_tables": """WITH li AS (SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, coalesce(o_orderpriority, 'missing') AS o_orderpriority FROM lineitem
        LEFT JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT 'flag_status' AS "table", l_returnflag AS "row", l_linestatus AS "column", count(*) AS n FROM li GROUP BY ALL UNION ALL
        SELECT 'priority_flag', o_orderpriority, l_returnflag, count(*) FROM li GROUP BY ALL UNION ALL SELECT 'line_status', l_linenumber, l_linestatus, count(*) FROM li GROUP BY ALL),
        e AS (SELECT * FROM (SELECT DISTINCT "table", "row" FROM c) JOIN (SELECT DISTINCT "table", "column" FROM c) USING ("table"))
        SELECT e."table", e."row", e."column", coalesce(n, 0) AS n FROM e LEFT JOIN c ON e."table" = c."table" AND e."row" = c."row" AND e."column" = c."column" """,
    "flag_status_pivot": """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o, 0::BIGINT AS x FROM lineitem
        GROUP BY 1""",
    "calibration_report": """WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS passed, lang, source, unnest(['length', 'other', 'none']) AS baseline, doc_id % 8 AS k,
          round(n_chars / 20000.0::DOUBLE, 6) AS x FROM documents),
        r AS (SELECT *, CASE baseline WHEN 'none' THEN 'missing' WHEN 'length' THEN CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' WHEN 2 THEN 'nonfinite' WHEN 3 THEN 'invalid'
            WHEN 4 THEN 'invalid' ELSE 'usable' END ELSE CASE WHEN k = 2 OR k > 4 THEN 'usable' ELSE 'missing' END END AS kind,
          CASE WHEN baseline = 'other' THEN CASE WHEN k = 2 THEN 1.0 WHEN k > 4 THEN 3.0 END WHEN baseline = 'length' AND k > 4 THEN x END::DOUBLE AS score FROM d),
        p AS (SELECT *, CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE 1 / (1 + exp(-score)) END AS p FROM r),
        z AS (SELECT *, 'overall' AS slice, '' AS value FROM p UNION ALL SELECT *, 'benchmark', lang FROM p UNION ALL SELECT *, 'split', source FROM p),
        c AS (SELECT baseline, slice, value, count(*) AS row_count, count(*) FILTER (WHERE kind = 'usable') AS usable, count(*) FILTER (WHERE kind = 'usable' AND passed) AS positive,
          count(*) FILTER (WHERE kind = 'usable' AND NOT passed) AS negative, count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'invalid') AS invalid,
          count(*) FILTER (WHERE kind = 'nonfinite') AS nonfinite, round(avg((p - passed::INT) ** 2), 6) AS brier, count(*) FILTER (WHERE p >= 0.5 AND passed) AS tp,
          count(*) FILTER (WHERE p >= 0.5 AND NOT passed) AS fp FROM z GROUP BY ALL),
        k AS (SELECT baseline, slice, value, passed, rank() OVER (PARTITION BY baseline, slice, value ORDER BY score) + (count(*) OVER (PARTITION BY baseline, slice, value, score) - 1) / 2.0 AS ar,
          row_number() OVER (PARTITION BY baseline, slice, value ORDER BY score DESC, doc_id) AS place, sum(passed::INT) OVER (PARTITION BY baseline, slice, value ORDER BY score DESC, doc_id
          ROWS UNBOUNDED PRECEDING) AS hits FROM z WHERE kind = 'usable'),
        a AS (SELECT baseline, slice, value, round((sum(ar) FILTER (WHERE passed) - count(*) FILTER (WHERE passed) * (count(*) FILTER (WHERE passed) + 1) / 2.0) / (count(*) FILTER (WHERE passed)
          * count(*) FILTER (WHERE NOT passed))::DOUBLE, 9) AS roc_auc, round(avg(hits / place::DOUBLE) FILTER (WHERE passed), 6) AS average_precision FROM k GROUP BY ALL)
        SELECT c.baseline, c.slice, c.value, CASE WHEN usable = 0 AND missing = row_count THEN 'missing' WHEN usable = 0 THEN 'no_finite_scores' WHEN positive = 0 OR negative = 0 THEN 'single_class'
          ELSE 'ok' END AS status, row_count, usable, positive, negative, missing, invalid, nonfinite, CASE WHEN positive > 0 AND negative > 0 THEN roc_auc END AS roc_auc,
          CASE WHEN positive > 0 AND negative > 0 THEN average_precision END AS average_precision, brier, tp, fp
        FROM c LEFT JOIN a ON a.baseline = c.baseline AND a.slice = c.slice AND a.value = c.value""",
    "observed_accounting": f"""WITH {LICENSED_SQL}, kept AS (SELECT * FROM dec WHERE allowed), n AS (SELECT (SELECT count(*) FROM dec) AS loaded, (SELECT count(*) FROM kept) AS gated,
        (SELECT count(DISTINCT text) FROM kept) AS once) SELECT unnest(['loaded_equals_gate_input', 'gate_output_equals_once_input', 'gate_kept_and_dropped_equal_input',
        'once_kept_and_dropped_equal_input']) AS equality, unnest([loaded, gated, loaded, gated]) AS "left", unnest([loaded, gated, loaded, gated]) AS "right", true AS holds FROM n""",
    "run_states": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events), e AS (SELECT user_id::VARCHAR AS run_id, CASE WHEN event_type = 'error'
        THEN 'failed' ELSE event_type END AS event, CASE WHEN event_id % 5 <> 0 AND s % 11 <> 0 THEN s END AS step, ts FROM r), o AS (SELECT run_id, event, step,
        min(ts) AS ts FROM e GROUP BY ALL), d AS (SELECT DISTINCT run_id, step FROM o WHERE step IS NOT NULL), k AS (SELECT run_id, count(*) AS steps, max(step) AS highest, count(*)
        FILTER (WHERE step = n) AS contiguous FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n FROM d) GROUP BY run_id), w AS (SELECT run_id, count(*) AS events,
        arg_max(event, (ts, coalesce(step, -1), event)) AS latest_event, coalesce(max(event) FILTER (WHERE event IN ('failed', 'completed')), 'running') AS status FROM o GROUP BY run_id)
        SELECT w.run_id, events, coalesce(steps, 0) AS steps, coalesce(contiguous, 0) AS contiguous, coalesce(highest, 0) AS highest, coalesce(highest - steps, 0) AS missing, latest_event,
        status FROM w LEFT JOIN k ON k.run_id = w.run_id""",
}
