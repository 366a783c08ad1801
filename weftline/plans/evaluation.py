"""Ranking, classification and geometry queries over embeddings, lineitem, labels and events.

A problem is an order, its completions the order's lines (passed: returned); latents are the
embeddings, split by the hash of their id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..operators import latents as G
from ..operators import ranking as R
from ..operators import targets as N
from ..streaming import events
from .common import read, split_sql


def vectors(s, d):
    e = read(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def split_vectors(s, d):
    return vectors(s, d).withColumn("split", T.split_name(F.col("id").cast("string")))


def asked(s, d):
    return vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def knn_l2(s, d):
    return R.nearest(asked(s, d), vectors(s, d).select("id", "v"), 5)


def knn_cosine(s, d):
    return R.nearest(asked(s, d), vectors(s, d).select("id", "v"), 5, "cosine")


def retrieval_prior(s, d):
    return knn_l2(s, d).groupBy("query_id").agg(F.round(F.avg("distance"), 6).alias("prior"))


def rank_targets(s, d):
    """A stated set of queries against all other rows; the target is the nearest row of the query's label."""
    return target_ranks(s, d, "id % 50 = 0")


def target_ranks(s, d, asked="true"):
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return N.nearest_target_ranks(v.where(asked).select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label"), v)


def retrieval_metrics(s, d):
    """Every row is a query."""
    return R.retrieval_metrics(target_ranks(s, d))


def completions(s, d):
    order = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]), 256)
    return read(s, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(
        F.max("l_extendedprice").alias("model"), F.max("l_discount").alias("lexical"), F.max("l_returnflag").alias("flag")
    ).select("l_orderkey", order.alias("completion_id"), "model", "lexical", (F.col("flag") == "R").alias("passed"))


def rerank_pass_at_k(s, d):
    orders = {
        "model": [F.desc("model"), "completion_id"], "lexical": [F.desc("lexical"), "completion_id"], "hash": ["completion_id"]
    }
    return R.pass_metrics(R.first_passes(completions(s, d), "l_orderkey", orders))


def rerankability_headroom(s, d):
    p = completions(s, d).groupBy("l_orderkey").agg(F.avg(F.col("passed").cast("int")).alias("rate"))
    return p.agg(
        F.count(F.lit(1)).alias("problems"),
        F.count_if(F.col("rate") == 1).alias("all_pass"),
        F.count_if(F.col("rate") == 0).alias("all_fail"),
        F.count_if((F.col("rate") > 0) & (F.col("rate") < 1)).alias("rerankable"),
        F.round(100 * (F.avg(F.when(F.col("rate") > 0, 1.0).otherwise(0.0)) - F.avg("rate")), 6).alias("headroom_points")
    )


def anti_saturation_report(s, d):
    p = completions(s, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pool"), F.count_if("passed").alias("passes"))
    return p.agg(
        F.count(F.lit(1)).alias("problems"),
        F.round(
            F.avg(F.when((F.col("passes") > 0) & (F.col("passes") < F.col("pool")), 1.0).otherwise(0.0)), 9
        ).alias("dual_class"),
        F.round(F.avg(F.col("passes") / F.col("pool").cast("double")), 9).alias("random_pass_at_1"),
        (F.count(F.lit(1)) >= 100).alias("enough_problems")
    )


def rotated_baseline(s, d):
    """Within an order, each line gets the price of the next one by its id."""
    c = completions(s, d)
    return R.rotated(c, ["l_orderkey"], ["completion_id"], "model").select("l_orderkey", "completion_id", "rotated")


def sampled(s, d):
    """labels with documents: p by text length, label toxic."""
    t = read(s, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    docs = read(s, d, "documents").select("doc_id", "lang", "source", "n_chars")
    j = docs.join(t, "doc_id").where("label is not null")
    return j.select(
        F.col("doc_id").alias("row_id"),
        "lang",
        "label",
        F.explode(
            F.create_map(F.lit("length"), F.col("n_chars") / 20000.0, F.lit("short"), 1.0 / (1.0 + F.col("n_chars") / 1000.0))
        ).alias("method", "score")
    )


def probabilities(s, d):
    return sampled(s, d).withColumn("p", T.probability(F.least(F.col("score"), F.lit(1.0))))


def roc_auc(s, d):
    return K.roc_auc(sampled(s, d))


def average_precision(s, d):
    return K.precision_areas(sampled(s, d))


def threshold_metrics(s, d):
    return K.threshold_metrics(probabilities(s, d), ["method"])


def calibration_slices(s, d):
    return K.threshold_metrics(probabilities(s, d).where("method = 'short'"), ["lang"])


def ece_bins(s, d):
    return K.calibration_bins(probabilities(s, d).where("method = 'short'"))


def expected_calibration_error(s, d):
    return K.expected_calibration_error(probabilities(s, d).where("method = 'short'"))


def majority_baseline(s, d):
    return K.majority(split_vectors(s, d), "label", "split")


def metadata_lookup_baseline(s, d):
    docs = read(s, d, "documents").withColumn("split", T.split_name(F.col("doc_id").cast("string")))
    train = docs.where("split = 'train'")
    each, whole = K.majority(train, "lang", "source").withColumnRenamed("majority", "own"), K.majority(train, "lang")
    p = docs.where("split <> 'train'").join(each, "source", "left").join(F.broadcast(whole)).select(
        F.col("lang").alias("actual"), F.coalesce("own", "majority").alias("predicted")
    )
    return K.macro_f1(p)


def centroid_probe(s, d):
    v = split_vectors(s, d)
    return G.nearest_centroid(v.where("split <> 'train'"), v.where("split = 'train'"))


def macro_f1(s, d):
    return K.macro_f1(centroid_probe(s, d))


def eta_squared_dims(s, d):
    return G.eta_squared(vectors(s, d))


def dim_statistics(s, d):
    return G.dim_statistics(vectors(s, d)).select("dim", "mean", "variance")


def cosine_mean(s, d):
    return G.mean_pair_cosine(vectors(s, d))


def probe_label_coverage(s, d):
    return split_vectors(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes"))


def job_event_summary(s, d):
    e = read(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.max_by("event_type", "event_id").alias("last_type"),
        F.max_by(k, "event_id").alias("last_k")
    )


def tumbling_event_counts(s, d):
    """Events by type and hour: the streamed windows, over the whole table at once."""
    w = events.tumbling_counts(read(s, d, "events"), 60)
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def latest_per_job(s, d):
    return G.latest(read(s, d, "events"), ["user_id", "event_type"], "event_id", "value")


def lexical_jaccard(s, d):
    """Adjacent turns of a conversation, by identifier tokens."""
    c = read(s, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    j = c.join(b, ["conv_id", "turn"])
    return j.select(
        "conv_id",
        "turn",
        F.round(
            T.jaccard(
                F.array_distinct(T.tokens(F.col("text"), T.NAME_TOKEN)),
                F.array_distinct(T.tokens(F.col("after"), T.NAME_TOKEN))
            ),
            9
        ).alias("jaccard")
    )


QUERIES = {
    f.__name__: f for f in (
        knn_l2,
        knn_cosine,
        retrieval_prior,
        rank_targets,
        retrieval_metrics,
        rerank_pass_at_k,
        rerankability_headroom,
        anti_saturation_report,
        rotated_baseline,
        roc_auc,
        average_precision,
        threshold_metrics,
        calibration_slices,
        ece_bins,
        expected_calibration_error,
        majority_baseline,
        metadata_lookup_baseline,
        centroid_probe,
        macro_f1,
        eta_squared_dims,
        dim_statistics,
        cosine_mean,
        probe_label_coverage,
        job_event_summary,
        tumbling_event_counts,
        latest_per_job,
        lexical_jaccard
    )
}

VEC = f"vec AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, {split_sql('vec_id::VARCHAR')} AS split FROM embeddings)"
L2 = "round(list_sum(list_transform(list_zip(q.v, r.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6)"
COS = "round(1 - list_dot_product(q.v, r.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(r.v, r.v)), 6)"
KNN = (
    "WITH {vec}, p AS (SELECT q.id AS query_id, r.id, {d} AS distance FROM vec q JOIN vec r ON q.id <> r.id WHERE q.id "
    "% 50 = 0), k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank, "
    "id, distance FROM p QUALIFY rank <= 5)"
)


def _scores_sql(asked: str = "") -> str:
    return (
        f"WITH {VEC}, p AS (SELECT q.id AS query_id, r.id AS position, {L2} AS dist, q.label = r.label AS same FROM vec q "
        f"JOIN vec r ON q.id <> r.id{asked}), t AS (SELECT query_id, position AS target_id FROM p WHERE same "
        f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, position) = 1), k AS (SELECT query_id, position, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY dist, position)::INT AS rank, count(*) OVER (PARTITION BY query_id) "
        f"AS candidates FROM p), ranks AS (SELECT query_id, rank, candidates FROM k JOIN t USING (query_id) WHERE position "
        f"= target_id)"
    )


SCORES = _scores_sql(" WHERE q.id % 50 = 0")
COMP = (
    "c AS (SELECT l_orderkey, sha256(concat_ws('|', l_partkey, l_suppkey, l_linenumber)) AS completion_id, max(l_extendedprice) "
    "AS model, max(l_discount) AS lexical, max(l_returnflag) = 'R' AS passed FROM lineitem GROUP BY l_orderkey, l_partkey, "
    "l_suppkey, l_linenumber)"
)
SAMP = (
    "s0 AS (SELECT d.doc_id AS row_id, lang, label, n_chars FROM documents d JOIN (SELECT doc_id, max(toxic) AS label "
    "FROM labels GROUP BY doc_id) l USING (doc_id) WHERE label IS NOT NULL), s AS (SELECT row_id, lang, label, 'length' "
    "AS method, n_chars / 20000.0::DOUBLE AS score FROM s0 UNION ALL SELECT row_id, lang, label, 'short', 1.0::DOUBLE "
    "/ (1.0::DOUBLE + n_chars / 1000.0::DOUBLE) FROM s0), pr AS (SELECT *, least(score, 1.0) AS p FROM s)"
)
MET = (
    "count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label <> 1) AS fp, count(*) "
    "FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND label <> 1) AS tn, round(avg((p - "
    "label) * (p - label)), 9) AS brier"
)
RATIOS = (
    "round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn)::DOUBLE END, 9) AS accuracy, round(CASE "
    "WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE "
    "tp / (tp + fn)::DOUBLE END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp "
    "+ fn)::DOUBLE END, 9) AS f1"
)
BINS = (
    f"WITH {SAMP}, f AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(label::DOUBLE), "
    f"9) AS share FROM pr WHERE method = 'short' GROUP BY 1), bins AS (SELECT r.bin::INT AS bin, coalesce(n, 0)::BIGINT "
    f"AS n, mean_p, share FROM range(10) r(bin) LEFT JOIN f ON f.bin = r.bin)"
)
PROBE = (
    f"WITH {VEC}, x AS (SELECT id, label, split, unnest(v) AS x, unnest(range(64)) AS dim FROM vec), c AS (SELECT label, "
    f"dim, avg(x) AS m FROM x WHERE split = 'train' GROUP BY ALL), dd AS (SELECT x.id, x.label AS actual, c.label AS predicted, "
    f"round(sum((x - m) * (x - m)), 9) AS d FROM x JOIN c USING (dim) WHERE split <> 'train' GROUP BY ALL), pred AS (SELECT "
    f"id, actual, predicted FROM dd QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, predicted) = 1)"
)
F1 = (
    "round((SELECT avg((actual = predicted)::INT) FROM pred), 9) AS accuracy, round((SELECT avg(2.0::DOUBLE * tp / (act "
    "+ prd)) FROM (SELECT label, (SELECT count(*) FROM pred WHERE actual = label AND predicted = label) AS tp, (SELECT "
    "count(*) FROM pred WHERE actual = label) AS act, (SELECT count(*) FROM pred WHERE predicted = label) AS prd FROM "
    "(SELECT actual AS label FROM pred UNION SELECT predicted FROM pred))), 9) AS macro_f1"
)


def _pass_sql(method: str, order: str) -> str:
    return (
        f"SELECT '{method}' AS method, count(*) AS problems, round(avg(CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS "
        f"pass_at_1, round(avg(CASE WHEN f <= 3 THEN 1.0::DOUBLE ELSE 0 END), 9) AS pass_at_k, round(avg(coalesce(1.0::DOUBLE "
        f"/ f, 0)), 9) AS mrr, round(avg(f), 9) AS mean_first_pass FROM (SELECT l_orderkey, min(CASE WHEN passed THEN r END) "
        f"AS f FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS r FROM c) GROUP BY 1)"
    )


ORACLES = {
    "knn_l2": KNN.format(vec=VEC, d=L2) + " SELECT * FROM k",
    "knn_cosine": KNN.format(vec=VEC, d=COS) + " SELECT * FROM k",
    "retrieval_prior": KNN.format(vec=VEC, d=L2) + " SELECT query_id, round(avg(distance), 6) AS prior FROM k GROUP BY 1",
    "rank_targets": SCORES + " SELECT * FROM ranks",
    "retrieval_metrics": _scores_sql() + " SELECT count(*) AS n, " + ", ".join(
        f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 9) AS r{k}" for k in (1, 5, 10)
    ) + (
        ", round(avg(1.0::DOUBLE / rank), 9) AS mrr, median(rank) AS median_rank, min(candidates) AS min_candidates, max(candidates) "
        "AS max_candidates FROM ranks"
    ),
    "rerank_pass_at_k": f"WITH {COMP} " + " UNION ALL ".join(
        (
            _pass_sql("model", "model DESC, completion_id"),
            _pass_sql("lexical", "lexical DESC, completion_id"),
            _pass_sql("hash", "completion_id")
        )
    ),
    "rerankability_headroom": (
        f"WITH {COMP} SELECT count(*) AS problems, count(*) FILTER (WHERE rate = 1) AS all_pass, count(*) FILTER (WHERE rate "
        f"= 0) AS all_fail, count(*) FILTER (WHERE rate > 0 AND rate < 1) AS rerankable, round(100 * (avg(CASE WHEN rate > "
        f"0 THEN 1.0::DOUBLE ELSE 0 END) - avg(rate)), 6) AS headroom_points FROM (SELECT l_orderkey, avg(passed::INT) AS "
        f"rate FROM c GROUP BY 1)"
    ),
    "anti_saturation_report": (
        f"WITH {COMP} SELECT count(*) AS problems, round(avg(CASE WHEN passes > 0 AND passes < pool THEN 1.0::DOUBLE ELSE "
        f"0 END), 9) AS dual_class, round(avg(passes / pool::DOUBLE), 9) AS random_pass_at_1, count(*) >= 100 AS enough_problems "
        f"FROM (SELECT l_orderkey, count(*) AS pool, count(*) FILTER (WHERE passed) AS passes FROM c GROUP BY 1)"
    ),
    "rotated_baseline": (
        f"WITH {COMP} SELECT l_orderkey, completion_id, coalesce(lead(model) OVER w, first_value(model) OVER w) AS rotated "
        f"FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY completion_id)"
    ),
    "roc_auc": (
        f"WITH {SAMP}, r AS (SELECT method, label, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION "
        f"BY method, score) - 1) / 2.0::DOUBLE AS r FROM s) SELECT method, round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) "
        f"- sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label))::DOUBLE, 9) AS auc FROM r GROUP BY "
        f"1"
    ),
    "average_precision": (
        f"WITH {SAMP}, r AS (SELECT method, label, row_number() OVER w AS place, sum(label) OVER w AS tp FROM s WINDOW w AS "
        f"(PARTITION BY method ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING)) SELECT method, round(avg(tp / place::DOUBLE) "
        f"FILTER (WHERE label = 1), 9) AS average_precision, round(sum(tp / place::DOUBLE) FILTER (WHERE label = 1) / sum(label), "
        f"9) AS pr_auc_step FROM r GROUP BY 1"
    ),
    "threshold_metrics": (
        f"WITH {SAMP}, m AS (SELECT method, {MET} FROM pr GROUP BY 1) SELECT method, tp, fp, fn, tn, {RATIOS}, brier FROM "
        f"m"
    ),
    "calibration_slices": (
        f"WITH {SAMP}, m AS (SELECT lang, {MET} FROM pr WHERE method = 'short' GROUP BY 1) SELECT lang, tp, fp, fn, tn, {RATIOS}, "
        f"brier FROM m"
    ),
    "ece_bins": BINS + " SELECT * FROM bins",
    "expected_calibration_error": BINS + " SELECT round(sum(n * abs(mean_p - share)) / sum(n), 6) AS ece FROM bins WHERE n > 0",
    "majority_baseline": (
        f"WITH {VEC} SELECT split, label AS majority FROM (SELECT split, label, row_number() OVER (PARTITION BY split ORDER "
        f"BY count(*) DESC, label) AS r FROM vec GROUP BY split, label) WHERE r = 1"
    ),
    "metadata_lookup_baseline": (
        f"WITH dd AS (SELECT lang, source, {split_sql('doc_id::VARCHAR')} AS split FROM documents), own AS (SELECT source, "
        f"lang AS own FROM dd WHERE split = 'train' GROUP BY source, lang QUALIFY row_number() OVER (PARTITION BY source ORDER "
        f"BY count(*) DESC, lang) = 1), al AS (SELECT lang AS al FROM dd WHERE split = 'train' GROUP BY lang ORDER BY count(*) "
        f"DESC, lang LIMIT 1), pred AS (SELECT lang AS actual, coalesce(own, al) AS predicted FROM dd LEFT JOIN own USING "
        f"(source), al WHERE split <> 'train') SELECT {F1}"
    ),
    "centroid_probe": PROBE + " SELECT * FROM pred",
    "macro_f1": PROBE + f" SELECT {F1}",
    "eta_squared_dims": (
        f"WITH {VEC}, x AS (SELECT label, unnest(v) AS x, unnest(range(64))::INT AS dim FROM vec), g AS (SELECT dim, label, "
        f"count(*) AS n, avg(x) AS m, sum(x * x) AS q FROM x GROUP BY ALL), t AS (SELECT dim, sum(n) AS n, sum(n * m) / sum(n) "
        f"AS mean, sum(q) AS q, sum(n * m * m) AS b FROM g GROUP BY dim) SELECT dim, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, "
        f"(b - n * mean * mean) / (q - n * mean * mean))), 6) AS eta_squared FROM t"
    ),
    "dim_statistics": (
        f"WITH {VEC}, x AS (SELECT unnest(v) AS x, unnest(range(64))::INT AS dim FROM vec) SELECT dim, round(avg(x), 6) AS "
        f"mean, round(var_pop(x), 6) AS variance FROM x GROUP BY dim"
    ),
    "cosine_mean": (
        f"WITH {VEC}, p AS (SELECT list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) "
        f"AS c FROM vec a JOIN vec b ON a.id <> b.id) SELECT round(avg(c), 6) AS mean_cosine FROM p"
    ),
    "probe_label_coverage": f"WITH {VEC} SELECT split, count(*) AS n, count(DISTINCT label) AS classes FROM vec GROUP BY split",
    "job_event_summary": (
        "SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, arg_max(event_type, "
        "event_id) AS last_type, arg_max((props::JSON->>'k')::BIGINT, event_id) AS last_k FROM events GROUP BY 1"
    ),
    "tumbling_event_counts": (
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n "
        "FROM events GROUP BY ALL"
    ),
    "latest_per_job": "SELECT user_id, event_type, arg_max(value, event_id) AS latest FROM events GROUP BY ALL",
    "lexical_jaccard": (
        r"WITH t AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(a.text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) "
        r"AS x, list_distinct(regexp_extract_all(b.text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS y FROM conversations a JOIN "
        r"conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(x) + "
        r"len(y) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE "
        r"END, 9) AS jaccard FROM t"
    ),
}
