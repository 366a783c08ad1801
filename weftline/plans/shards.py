"""Queries of shard reports over documents as transitions, and areas by slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import shards as S
from .common import read, split_sql


def rows(s, d):
    """Documents: before goes by language and length, the state is 12 bits of that, after is the whole text."""
    docs = read(s, d, "documents")
    before = F.concat_ws("-", "lang", F.col("n_chars") % 40)
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return docs.select(
        F.col("doc_id").alias("row_id"), T.split_name(F.col("doc_id").cast("string")).alias("split"), before.alias("before_hash"),
        F.conv(F.substring(F.md5(before), 1, 3), 16, 10).cast("long").alias("state"), F.md5("text").alias("after_hash"), "source", F.col("source").alias("repo"),
        F.col("lang").alias("path"), F.when(F.col("doc_id") % 7 != 0, "c").alias("commit"), F.when(F.col("n_chars") > 500, "mit").alias("license"),
        F.concat_ws(":", "lang", F.col("n_chars") % 9).alias("action"), F.col("n_chars").alias("edit_size"), F.floor(F.col("n_chars") / 1000).alias("diff_shape"),
        F.when(F.col("n_chars") > 0, words).otherwise(0).alias("action_text_tokens"), (F.col("doc_id") % 50).alias("action_abs_tokens"),
    )


def shard_pair_pools(s, d):
    return S.pair_pools(rows(s, d)).select("pool", "pair_count", "groups", "shared_groups", "scan_truncated")


def shard_readiness(s, d):
    r = rows(s, d)
    return S.claim_readiness(S.metadata_quality(r), S.pair_pools(r), {"heldout_rows": 10**9})


def crash_slice_areas(s, d):
    """Lines as runs that raise: three scores by return flag (null: none) and ship month."""
    li = read(s, d, "lineitem")
    ident = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    scores = F.create_map(F.lit("price"), F.col("l_extendedprice").cast("double"), F.lit("discount"), F.col("l_discount").cast("double"), F.lit("line"), F.col("l_linenumber").cast("double"))
    each = li.select(
        ident.alias("row_id"), (F.col("l_linestatus") == "F").cast("int").alias("label"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("exception_class"),
        F.concat_ws("", F.lit("q"), F.col("l_quantity").cast("int") % 5).alias("source_dataset"), F.explode(scores).alias("method", "score"),
    )
    return S.slice_areas(each, {"exception_class": "none", "source_dataset": "unknown"})


def crash_scores(s, d):
    """Embeddings as records: the prediction is the vector backwards; the hashed score has no SQL."""
    e = read(s, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    records = e.select(
        F.col("vec_id").cast("string").alias("record_id"), v.alias("before"), F.reverse(v).alias("predicted"), F.col("label").alias("tokens"),
        F.when(F.col("label") == 3, "exception").alias("output_kind"),
    )
    return S.crash_scores(records).where("method <> 'random'").select("record_id", "method", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (shard_pair_pools, shard_readiness, crash_slice_areas, crash_scores)}

ROWS = f"""r AS (SELECT doc_id, {split_sql("doc_id::VARCHAR")} AS split, lang || '-' || n_chars % 40 AS before, ('0x' || substr(md5(lang || '-' || n_chars % 40), 1, 3))::BIGINT AS state,
  md5(text) AS after, source || chr(0) || lang AS file, lang || ':' || n_chars % 9 AS action, CASE WHEN n_chars <= 2 THEN 'xs' WHEN n_chars <= 10 THEN 's' WHEN n_chars <= 50 THEN 'm'
  WHEN n_chars <= 150 THEN 'l' ELSE 'xl' END AS edit, (n_chars // 1000)::VARCHAR AS shape, n_chars FROM documents),
  k AS (SELECT 'same_before_different_after' AS pool, before AS key, after FROM r UNION ALL SELECT 'same_file', file, after FROM r UNION ALL SELECT 'action_cluster', action, after FROM r
  UNION ALL SELECT 'edit_size_controlled', edit, after FROM r UNION ALL SELECT 'diff_shape_controlled', shape, after FROM r),
  m AS (SELECT pool, key, after, count(*) AS m FROM k GROUP BY ALL), g AS (SELECT pool, key, sum(m) AS n, sum(m * (m - 1) // 2) AS same FROM m GROUP BY ALL),
  st AS (SELECT DISTINCT state FROM r), near AS (SELECT a.state AS l, b.state AS r FROM st a JOIN st b ON a.state < b.state AND bit_count(xor(a.state, b.state)) <= 3),
  np AS (SELECT count(*) AS n FROM near JOIN r a ON a.state = near.l JOIN r b ON b.state = near.r WHERE a.after <> b.after),
  pools AS (SELECT pool, sum(n * (n - 1) // 2 - same)::BIGINT AS pair_count, count(*) AS groups, count(*) FILTER (WHERE n > 1) AS shared_groups, false AS scan_truncated FROM g GROUP BY pool
  UNION ALL SELECT 'near_before_different_after', np.n, NULL, NULL, false FROM np)"""
ORACLES = {
    "shard_pair_pools": f"WITH {ROWS} SELECT * FROM pools",
    "shard_readiness": f"""WITH {ROWS}, p AS (SELECT (SELECT count(*) FROM r WHERE split IN ('val', 'test'))::DOUBLE AS held, (SELECT sum(pair_count) FROM pools WHERE pool IN ('same_file',
        'same_before_different_after', 'near_before_different_after'))::DOUBLE AS near, (SELECT pair_count FROM pools WHERE pool = 'action_cluster')::DOUBLE AS act, (SELECT pair_count FROM pools
        WHERE pool = 'edit_size_controlled')::DOUBLE AS ed, (SELECT round(avg((n_chars > 0)::INT), 9) FROM r) AS t, (SELECT round(avg((doc_id % 50 > 0)::INT), 9) FROM r) AS a),
        x AS (SELECT unnest(['heldout_rows', 'same_file_or_near_before_pairs', 'action_cluster_pairs', 'edit_size_bucket_pairs', 'action_text_nonempty_ratio', 'action_abs_nonempty_ratio']) AS
        "check", unnest([held, near, act, ed, t, a]) AS observed, unnest([1000000000, 1, 1, 1, 0.95, 0.95]::DOUBLE[]) AS least, unnest(['insufficient_heldout_rows',
        'missing_same_file_or_near_before_negatives', 'missing_action_cluster_negatives', 'missing_edit_size_controlled_negatives', 'low_action_text_coverage', 'low_action_abs_coverage']) AS why FROM p)
        SELECT "check", observed, least, CASE WHEN observed < least THEN why END AS failure FROM x""",
    "crash_slice_areas": """WITH r AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS row_id, l_linestatus = 'F' AS label, CASE WHEN l_returnflag <> 'N' THEN
        l_returnflag ELSE 'none' END AS e, 'q' || l_quantity::INT % 5 AS q, unnest(['price', 'discount', 'line']) AS method, unnest([l_extendedprice::DOUBLE, l_discount::DOUBLE, l_linenumber::DOUBLE])
        AS score FROM lineitem), z AS (SELECT *, 'exception_class' AS slice, e AS value FROM r UNION ALL SELECT *, 'source_dataset', q FROM r), k AS (SELECT *, rank() OVER w + (count(*) OVER
        (PARTITION BY slice, value, method, score) - 1) / 2.0 AS ar FROM z WINDOW w AS (PARTITION BY slice, value, method ORDER BY score)) SELECT slice, value, method, count(DISTINCT row_id) AS samples,
        CASE WHEN count(*) FILTER (WHERE label) > 0 AND count(*) FILTER (WHERE NOT label) > 0 THEN round((sum(ar) FILTER (WHERE label) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label)
        + 1) / 2.0) / (count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label))::DOUBLE, 9) END AS auc FROM k GROUP BY ALL""",
    "crash_scores": """WITH e AS (SELECT vec_id::VARCHAR AS record_id, label, embedding::DOUBLE[] AS v, list_reverse(embedding::DOUBLE[]) AS w FROM embeddings), r AS (SELECT record_id, label,
        unnest(['linear_code', 'linear_predicted_output', 'linear_code_input', 'lexical']) AS method, unnest([sqrt(list_dot_product(v, v)), sqrt(list_dot_product(w, w)),
        sqrt(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] + z[2]) ** 2))), label::DOUBLE]) AS x FROM e), m AS (SELECT method, min(x) AS low, max(x) AS high FROM r GROUP BY method)
        SELECT record_id, r.method, round(CASE WHEN high = low THEN 0.5 ELSE (x - low) / (high - low) END, 6) AS score FROM r JOIN m ON m.method = r.method UNION ALL
        SELECT record_id, 'static', CASE WHEN label = 3 THEN 1.0 ELSE 0.0 END FROM e""",
}
