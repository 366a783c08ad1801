"""Row-builder, geometry and slice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diffs
from ..functions import text as T
from ..operators import classify as K
from ..operators import ranking as R
from ..operators import resample as B
from ..operators import rows as P
from .code import files
from .common import read, split_sql
from .evaluation import probabilities, rank_targets, vectors


def _edits(s, d):
    f = files(s, d)
    after = F.replace("text", F.lit("x < 3"), F.lit("x <= 3"))
    return f.select(
        F.lit("built").alias("source"), F.concat(F.lit("r"), "n").alias("repo"), F.col("suppkey").cast("string").alias("commit"), F.lit("src/a.py").alias("path_before"), F.lit("src/a.py").alias("path_after"),
        F.col("text").alias("before"), after.alias("after"), F.lit("Compare with equality").alias("message"), F.lit("mit").alias("license"), T.split_name(
            F.col("suppkey").cast("string")
        ).alias("split"), "suppkey",
    )


def transition_rows(s, d):
    t = P.transitions(_edits(s, d))
    return t.select(
        "commit",
        "split",
        "edit_size",
        "token_count_before",
        "token_count_after",
        "state_before_kind",
        "state_after_symbol",
        F.size("action_abs").alias("n_actions"),
        F.size("filter_flags").alias("n_flags")
    )


def evaluation_rows(s, d):
    e = P.evaluation_rows(P.transitions(_edits(s, d)))
    return e.groupBy("source", "state_after_kind", "edit_size_decade", "diff_shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("action_cluster").alias("clusters"),
        F.count_distinct("state_before_hash").alias("befores")
    )


def diagnostic_rows(s, d):
    return P.diagnostic_rows(P.transitions(_edits(s, d))).groupBy(
        "edit_bucket", "token_bucket"
    ).agg(F.count(F.lit(1)).alias("n"))


def probe_rows(s, d):
    e = P.probe_rows(P.evaluation_rows(P.transitions(_edits(s, d))))
    return e.groupBy(
        "ast_node_kind", "symbol_kind", "edit_size_bucket", "source_family", "path_suffix"
    ).agg(F.count(F.lit(1)).alias("n"))


def symbol_kinds(s, d):
    o = read(s, d, "orders").select(
        F.element_at(
            F.array(*map(F.lit, ("function", "region", "small_file", ""))), (F.col("o_orderkey") % 4 + 1).cast("int")
        ).alias("kind"),
        F.when(F.col("o_orderkey") % 3 == 0, "f").otherwise("").alias("symbol"), F.when(
            F.col("o_orderkey") % 5 == 0, "why"
        ).alias("why"),
    )
    return o.groupBy(
        P.symbol_kind(F.col("kind"), F.col("symbol"), F.col("why")).alias("symbol_kind")
    ).agg(F.count(F.lit(1)).alias("n"))


def execution_evaluation_rows(s, d):
    r = read(s, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("record_id"),
        F.transform(T.tokens(F.col("text"), T.NAME_TOKEN), lambda x: F.length(x).cast("long")).alias("tokens")
    )
    return P.execution_evaluation_rows(r, 12, 6).select("record_id", "ids_text")


def lexical_matrix(s, d):
    t = read(s, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("row_id"),
        F.transform(T.tokens(F.col("text"), T.NAME_TOKEN), lambda x: F.length(x).cast("long")).alias("t")
    )
    return P.lexical_matrix(t, "row_id", "t", 8).select("row_id", "dim", F.round("value", 9).alias("value"))


def hard_negative_candidates(s, d):
    tasks = files(s, d).select(
        F.col("suppkey").alias("task_id"), F.lit("x = 1\n").alias("before_text"), F.col("text").alias("after_text")
    )
    return P.hard_negative_candidates(tasks).select(
        "task_id", "position", "label", F.when(F.col("position") < 3, F.col("class")).alias("class")
    )


def benchmark_pack(s, d):
    tasks = read(s, d, "nation").select(F.col("n_nationkey").alias("task_id"), F.lit("mit").alias("license"))
    sup = read(s, d, "supplier").select(
        F.col("s_nationkey").alias("task_id"),
        F.concat(F.lit("s"), "s_suppkey").alias("candidate_id"),
        F.lit("t").alias("text"),
        F.lit("pass").alias("label")
    )
    cus = read(s, d, "customer").select(
        (F.col("c_nationkey") + 5).alias("task_id"),
        F.concat(F.lit("c"), "c_custkey").alias("candidate_id"),
        F.lit("t").alias("text"),
        F.lit("fail").alias("label")
    )
    return P.benchmark_pack(tasks, sup, cus).groupBy("task_id", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank")
    )


def split_coverage_seed(s, d):
    o = read(s, d, "orders").select("o_custkey", (F.col("o_orderkey") % 2).alias("label"))
    return s.createDataFrame([(P.covering_seed(o, "o_custkey", "label"),)], "seed int")


def seed_offsets(s, d):
    return read(s, d, "nation").select("n_nationkey", P.seed_offset(F.col("n_name")).alias("offset"))


def energy_scores(s, d):
    """A vectorised scoring function over consecutive turns: lengths' difference."""
    from .curation import transitions

    t = transitions(s, d).select("conv_id", "turn", F.length("before").alias("a"), F.length("after").alias("b"))
    return P.scored(t, _length_energy, "a", "b").select("conv_id", "turn", "score")


def _length_energy(a, b):
    return ((a - b) ** 2).astype(float)


def retrieval_metric_slices(s, d):
    labels = read(s, d, "embeddings").select(
        F.col("vec_id").alias("query_id"), "label", (F.col("vec_id") % 3).cast("int").alias("pool")
    )
    ranks = rank_targets(s, d).join(labels, "query_id")
    each = ranks.select(
        "rank",
        F.explode(
            F.array(
                F.struct(F.lit("label").alias("slice"), F.col("label").cast("string").alias("value")),
                F.struct(F.lit("pool").alias("slice"), F.col("pool").cast("string").alias("value"))
            )
        ).alias("x")
    )
    return each.groupBy("x.slice", "x.value").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(1.0 / F.col("rank")), 9).alias("mrr")
    )


def calibration_slices_all(s, d):
    p = probabilities(s, d).withColumn("slice", F.explode(F.array(F.lit("all"), F.concat(F.lit("lang:"), "lang"))))
    return K.threshold_metrics(p, ["method", "slice"])


def collapse_report(s, d):
    r = B.collapse_report(vectors(s, d))
    return r.select(
        "n",
        *(
            F.round(c, 6).alias(c) for c in (
                "per_dim_variance_min", "per_dim_variance_median", "per_dim_variance_max", "mean_cosine", "mean_norm"
            )
        )
    )


def effective_rank(s, d):
    return B.effective_rank(vectors(s, d))


def latent_matrix(s, d):
    m = B.latent_matrix(vectors(s, d), top=8)
    return m.select(
        "dim", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round("std", 6).alias("std")
    )


def correlations(s, d):
    return B.correlations(vectors(s, d)).select("a", "b", F.round("correlation", 6).alias("correlation"))


def supplier_lifts(s, d):
    """Lines as completions of their supplier's task, in three orders: lifts of the model's over the others'."""
    c = read(s, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(
        F.max("l_extendedprice").alias("model"), F.max("l_discount").alias("lexical"), F.max("l_returnflag").alias("flag")
    )
    ident = F.concat_ws("|", "l_orderkey", "l_partkey", "l_linenumber")
    c = c.select("l_suppkey", ident.alias("id"), "model", "lexical", (F.col("flag") == "R").alias("passed"))
    orders = {"model": [F.desc("model"), "id"], "lexical": [F.desc("lexical"), "id"], "no_action": ["id"]}
    f = R.first_passes(c, "l_suppkey", orders).select(
        F.col("l_suppkey").alias("task"), "method", F.when(F.col("first_pass") == 1, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1.0 / F.col("first_pass"), F.lit(0.0)).alias("mrr"),
    )
    return B.lift_intervals(f, "task", "model", ["lexical", "no_action"], ["hit", "mrr"])


def bootstrap_lift(s, d):
    return supplier_lifts(s, d).select("baseline", "metric", "tasks", *(F.round(c, 9).alias(c) for c in ("lift", "low", "high")))


def interval_claim_gate(s, d):
    from ..operators.reports import interval_gate

    return interval_gate(supplier_lifts(s, d)).select("baseline", "metric", F.round("low", 9).alias("low"), "blocker")


def folded_actions(s, d):
    return read(s, d, "conversations").select(
        "conv_id", "turn", F.sha2(diffs.folded_action(F.col("text")), 256).alias("action_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        transition_rows, evaluation_rows, diagnostic_rows, probe_rows, symbol_kinds, execution_evaluation_rows, lexical_matrix, hard_negative_candidates,
        benchmark_pack, split_coverage_seed, seed_offsets, energy_scores, retrieval_metric_slices, calibration_slices_all, collapse_report, effective_rank,
        latent_matrix, correlations, bootstrap_lift, interval_claim_gate, folded_actions,
    )
}

ORDERS = (("model", "model DESC, id"), ("lexical", "lexical DESC, id"), ("no_action", "id"))
#: The exact stream in SQL: each draw's state by the jumps of its number's bits.
LIFTS = f"""WITH RECURSIVE j AS (SELECT 0 AS b, {B.LCG_FACTOR}::BIGINT AS f, {B.LCG_STEP}::BIGINT AS c UNION ALL SELECT b + 1, f * f % 2147483648, (c * f + c) % 2147483648
    FROM j WHERE b < 40), jumps AS (SELECT list(f ORDER BY b) AS f, list(c ORDER BY b) AS c FROM j),
  e AS (SELECT l_suppkey, l_orderkey || '|' || l_partkey || '|' || l_linenumber AS id, max(l_extendedprice) AS model, max(l_discount) AS lexical, max(l_returnflag) = 'R' AS passed
    FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber),
  r AS ({" UNION ALL ".join(f"SELECT l_suppkey, '{m}' AS method, passed, row_number() OVER (PARTITION BY l_suppkey ORDER BY {o}) AS rank FROM e" for m, o in ORDERS)}),
  fp AS (SELECT l_suppkey, method, min(rank) FILTER (WHERE passed) AS first FROM r GROUP BY ALL),
  v AS (SELECT l_suppkey, method, unnest(['hit', 'mrr']) AS metric, unnest([CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0 END, coalesce(1.0::DOUBLE / first, 0)]) AS x FROM fp),
  lift AS (SELECT a.l_suppkey, b.method AS baseline, a.metric, a.x - b.x AS x FROM v a JOIN v b ON a.l_suppkey = b.l_suppkey AND a.metric = b.metric
    WHERE a.method = 'model' AND b.method <> 'model'),
  task AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey FROM e)),
  d AS (SELECT t, t // n AS round, list_reduce(list_prepend((('0x' || substr(sha256('0'), 1, 16))::UBIGINT % 2147483648)::BIGINT, range(40)),
      lambda s, b: CASE WHEN ((t + 1) >> b) & 1 = 1 THEN (f[b + 1] * s + c[b + 1]) % 2147483648 ELSE s END) % n AS i
    FROM (SELECT unnest(range(1000 * n)) AS t, n FROM (SELECT any_value(n) AS n FROM task)), jumps),
  m AS (SELECT baseline, metric, round, sum(x) / any_value(n) AS m FROM d JOIN task ON task.i = d.i JOIN lift ON lift.l_suppkey = task.l_suppkey GROUP BY ALL),
  ends AS (SELECT baseline, metric, (list(m ORDER BY m))[25] AS low, (list(m ORDER BY m))[976] AS high FROM m GROUP BY ALL),
  found AS (SELECT ends.baseline, ends.metric, count(*) AS tasks, avg(x) AS lift, CASE WHEN count(*) >= 20 THEN low END AS low, CASE WHEN count(*) >= 20 THEN high END AS high
    FROM ends JOIN lift ON lift.baseline = ends.baseline AND lift.metric = ends.metric GROUP BY ends.baseline, ends.metric, low, high)"""

TOK = (
    "t AS (SELECT conv_id || '-' || turn AS row_id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), "
    "lambda x: length(x)) AS a FROM conversations)"
)
DIM = "x AS (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(64))::INT AS dim FROM embeddings)"
FIRST_SEED = " UNION ALL ".join(
    (
        f"SELECT {seed} AS seed, count(DISTINCT CASE WHEN s = 'val' THEN l END) AS v, count(DISTINCT CASE WHEN s = 'test' "
        f"THEN l END) AS t FROM (SELECT o_orderkey % 2 AS l, {split_sql('o_custkey::VARCHAR').replace(chr(39) + '0:' + chr(39), chr(39) + str(seed) + ':' + chr(39))} "
        f"AS s FROM orders)"
    )
    for seed in range(32)
)

from .evaluation import ORACLES as EVAL  # noqa: E402
from .evaluation import RATIOS, SAMP, MET, SCORES  # noqa: E402

ORACLES = {
    "transition_rows": (
        f"SELECT s_suppkey::VARCHAR AS commit, {split_sql('s_suppkey::VARCHAR')} AS split, 2::INT AS edit_size, (41 + 15)::INT AS "
        f"token_count_before, (41 + 16)::INT AS token_count_after, 'function' AS state_before_kind, 'f' || s_suppkey AS state_after_symbol, "
        f"6::INT AS n_actions, 0::INT AS n_flags FROM supplier"
    ),
    "evaluation_rows": (
        "SELECT 'built' AS source, 'function' AS state_after_kind, 0::INT AS edit_size_decade, sha256('r=1;d=0;i=0;bucket=xs' "
        "|| chr(0)) AS diff_shape, count(*) AS n, 1::BIGINT AS clusters, count(DISTINCT (s_suppkey, s_nationkey)) AS befores "
        "FROM supplier"
    ),
    "diagnostic_rows": "SELECT 'xs:0-2' AS edit_bucket, 'm:17-64' AS token_bucket, count(*) AS n FROM supplier",
    "probe_rows": (
        "SELECT 'function' AS ast_node_kind, 'function:named' AS symbol_kind, 'xs:0-2' AS edit_size_bucket, 'built' AS source_family, "
        "'.py' AS path_suffix, count(*) AS n FROM supplier"
    ),
    "symbol_kinds": (
        "WITH o AS (SELECT (['function', 'region', 'small_file', ''])[o_orderkey % 4 + 1] AS k, o_orderkey % 3 = 0 AS s, "
        "o_orderkey % 5 = 0 AS w FROM orders) SELECT CASE WHEN k <> '' AND s THEN k || ':named' WHEN k IN ('region', 'small_file') "
        "THEN k || ':fallback:' || CASE WHEN w THEN 'why' ELSE 'unknown' END WHEN k <> '' THEN k || ':unnamed' END AS symbol_kind, "
        "count(*) AS n FROM o GROUP BY 1"
    ),
    "execution_evaluation_rows": (
        f"WITH {TOK} SELECT row_id AS record_id, array_to_string(list_transform(a[1:12], lambda x: (x - 1) % 5 + 1), ' ') "
        f"AS ids_text FROM t"
    ),
    "lexical_matrix": (
        f"WITH {TOK}, u AS (SELECT row_id, unnest(a) AS x FROM t), c AS (SELECT row_id, x % 8 AS dim, count(*) AS n FROM u "
        f"GROUP BY ALL) SELECT row_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY row_id)), 9) AS value FROM c"
    ),
    "hard_negative_candidates": (
        "SELECT s_suppkey AS task_id, p::INT AS position, l AS label, c AS class FROM supplier, (VALUES (0, 'pass', 'passing_reference'), "
        "(1, 'fail', 'no_action_bait'), (2, 'fail', 'near_no_action_bait'), (3, 'unknown', NULL), (4, 'unknown', NULL), (5, "
        "'unknown', NULL)) v(p, l, c)"
    ),
    "benchmark_pack": (
        "WITH e AS (SELECT s_nationkey AS task_id, 's' || s_suppkey AS id, 'given' AS origin FROM supplier UNION ALL SELECT "
        "c_nationkey + 5, 'c' || c_custkey, 'generated' FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY task_id "
        "ORDER BY origin DESC, id) AS rank FROM e WHERE task_id IN (SELECT n_nationkey FROM nation)) SELECT task_id, origin, "
        "count(*) AS n, max(rank)::INT AS last_rank FROM r GROUP BY ALL"
    ),
    "split_coverage_seed": f"SELECT min(seed)::INT AS seed FROM ({FIRST_SEED}) WHERE v >= 2 AND t >= 2",
    "seed_offsets": "SELECT n_nationkey, ('0x' || substr(sha256(n_name), 1, 8))::BIGINT AS offset FROM nation",
    "energy_scores": (
        "SELECT a.conv_id, a.turn, ((length(a.text) - length(b.text)) * (length(a.text) - length(b.text)))::DOUBLE AS score "
        "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
    ),
    "retrieval_metric_slices": SCORES + (
        ", j AS (SELECT rank, label, vec_id % 3 AS pool FROM ranks JOIN embeddings ON vec_id = query_id) SELECT 'label' AS "
        "slice, label::VARCHAR AS value, count(*) AS n, round(avg(1.0::DOUBLE / rank), 9) AS mrr FROM j GROUP BY label UNION "
        "ALL SELECT 'pool', pool::VARCHAR, count(*), round(avg(1.0::DOUBLE / rank), 9) FROM j GROUP BY pool"
    ),
    "calibration_slices_all": (
        f"WITH {SAMP}, z AS (SELECT *, 'all' AS slice FROM pr UNION ALL SELECT *, 'lang:' || lang FROM pr), m AS (SELECT method, "
        f"slice, {MET} FROM z GROUP BY ALL) SELECT method, slice, tp, fp, fn, tn, {RATIOS}, brier FROM m"
    ),
    "collapse_report": (
        f"WITH {DIM}, v AS (SELECT var_pop(x) AS v FROM x GROUP BY dim) SELECT (SELECT count(*) FROM embeddings) AS n, round(min(v), "
        f"6) AS per_dim_variance_min, round(median(v), 6) AS per_dim_variance_median, round(max(v), 6) AS per_dim_variance_max, "
        f"(SELECT mean_cosine FROM ({EVAL['cosine_mean']})) AS mean_cosine, (SELECT round(avg(sqrt(list_dot_product(embedding::DOUBLE[], "
        f"embedding::DOUBLE[]))), 6) FROM embeddings) AS mean_norm FROM v"
    ),
    "latent_matrix": (
        f"WITH {DIM} SELECT dim, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance, round(stddev_samp(x), 6) AS "
        f"std FROM x GROUP BY dim ORDER BY var_samp(x) DESC, dim LIMIT 8"
    ),
    "folded_actions": (
        r"SELECT conv_id, turn, sha256(replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', "
        r"''), '\s+', ' ', 'g')), 'ß', 'ss')) AS action_sha256 FROM conversations"
    ),
    "correlations": (
        "WITH x2 AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64))::INT AS dim FROM embeddings) SELECT p.dim AS a, q.dim "
        f"AS b, round(corr(p.x, q.x), 6) AS correlation FROM x2 p JOIN x2 q ON p.vec_id = q.vec_id AND p.dim < q.dim GROUP BY ALL"
    ),
    "bootstrap_lift": LIFTS + " SELECT baseline, metric, tasks, round(lift, 9) AS lift, round(low, 9) AS low, round(high, 9) AS high FROM found",
    "interval_claim_gate": LIFTS + (
        " SELECT baseline, metric, round(low, 9) AS low, CASE WHEN NOT coalesce(lift > 0, false) THEN 'lift_not_positive' WHEN low IS NULL "
        "THEN 'interval_missing' WHEN low <= 0 THEN 'interval_includes_zero' END AS blocker FROM found"
    ),
}
