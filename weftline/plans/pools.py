"""Pool and decoy queries: documents as entries, lineitem lines as records of submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pools as P
from .common import lines, read, split_sql


def entries(s, d):
    """documents as pool entries; the state is 52 bits of the text's hash, before goes by its length."""
    docs = read(s, d, "documents")
    state = F.conv(F.substring(F.md5("text"), 1, 13), 16, 10).cast("long")
    return docs.select(
        F.col("doc_id").alias("id"),
        T.split_name(F.col("doc_id").cast("string")).alias("split"),
        "source",
        F.lit("").alias("repo"),
        F.concat("source", F.lit("/"), "lang").alias("path"),
        F.concat_ws("-", "lang", F.col("n_chars") % 50).alias("before"),
        F.md5("text").alias("after"),
        state.alias("state"),
        F.col("n_chars").alias("edit_size"),
        F.col("lang").alias("cluster"),
        F.floor(F.col("n_chars") / 1000).alias("shape"),
        (F.col("doc_id") % 97 == 3).alias("mutated"),
        F.lit(None).cast("double").alias("similarity"),
    )


def asked(s, d):
    return P.held_out_queries(entries(s, d), 40)


def hard_negative_pool(s, d):
    return P.hard_negatives(asked(s, d), entries(s, d), bits=18, bucket=500)


def hard_negative_rejections(s, d):
    return P.rejected_candidates(asked(s, d), entries(s, d))


def hard_candidate_pool(s, d):
    return P.hard_pool(asked(s, d), hard_negative_pool(s, d))


def contrast_pools(s, d):
    return P.contrast_pools(asked(s, d), entries(s, d), bits=18)


def surprise_decoys(s, d):
    return P.surprise_decoys(asked(s, d), entries(s, d))


def executions(s, d):
    """Lines as executions: problem = order mod 500, submission = supplier mod 20, input = line number."""
    li = lines(s, d).groupBy(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    ).agg(F.max("l_returnflag").alias("output"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("record_id"),
        (F.col("l_orderkey") % 5000).cast("string").alias("problem_id"),
        F.concat_ws(
            ":", (F.col("l_orderkey") % 5000).cast("string"), (F.col("l_suppkey") % 20).cast("string")
        ).alias("submission_id"),
        F.col("l_linenumber").cast("string").alias("input_id"),
        "output",
        F.when(F.col("l_orderkey") % 5000 % 10 == 0, "val").when(
            F.col("l_orderkey") % 5000 % 10 == 1, "test"
        ).otherwise("train").alias("split"),
        F.lit("tpch").alias("dataset"),
    )


def decoy_pairs_same_problem(s, d):
    return P.decoy_pairs(executions(s, d), "same_problem_different_submission")


def decoy_pairs_same_code(s, d):
    return P.decoy_pairs(executions(s, d), "same_code_different_input")


def decoy_skip_counts(s, d):
    e = executions(s, d)
    one = P.decoy_skips(e, "same_problem_different_submission").withColumn(
        "category", F.lit("same_problem_different_submission")
    )
    return one.unionByName(
        P.decoy_skips(e, "same_code_different_input").withColumn("category", F.lit("same_code_different_input"))
    )


def semantic_decoy_pack(s, d):
    return P.semantic_decoys(executions(s, d))


def scorable_pairs(s, d):
    e = executions(s, d)
    return P.scorable_coverage(P.decoy_pairs(e, "same_code_different_input"), e.where("input_id <> '3'"))


def easy_pool(s, d):
    return P.seeded_head(entries(s, d), "id", 50).select("id")


def per_split_sample(s, d):
    return P.per_split_sample(entries(s, d), "id", 20).select("split", "id")


def problem_split_by_rank(s, d):
    return P.problem_splits(read(s, d, "lineitem").select("l_orderkey"), "l_orderkey")


def token_decoys(s, d):
    ids = T.padded(F.transform(T.tokens(F.col("text"), T.NAME_TOKEN), lambda x: F.length(x).cast("long")), 8)
    return read(s, d, "conversations").select(
        "conv_id",
        "turn",
        F.array_join(F.transform(P.padded_token_decoy(ids, 10), lambda x: x.cast("string")), " ").alias("ids")
    )


QUERIES = {
    f.__name__: f
    for f in (
        hard_negative_pool, hard_negative_rejections, hard_candidate_pool, contrast_pools, surprise_decoys,
        decoy_pairs_same_problem, decoy_pairs_same_code, decoy_skip_counts, semantic_decoy_pack, scorable_pairs,
        easy_pool, per_split_sample, problem_split_by_rank, token_decoys,
    )
}

ENT = f"""ent AS (SELECT doc_id AS id, {split_sql('doc_id::VARCHAR')} AS split, source, source || '/' || lang AS path, lang || '-' || n_chars % 50 AS before,
  md5(text) AS after, ('0x' || substr(md5(text), 1, 13))::BIGINT AS state, n_chars AS edit_size, lang AS cluster,
  n_chars // 1000 AS shape, doc_id % 97 = 3 AS mutated FROM documents)"""
HELD = "q AS (SELECT * FROM ent WHERE split <> 'train' ORDER BY sha256('0:' || id), id LIMIT 40)"
HARD = f"""WITH {ENT}, {HELD}, p AS (SELECT q.id AS query_id, e.id, list_filter([
    CASE WHEN e.before = q.before AND e.after <> q.after THEN 'same_before_different_after' END,
    CASE WHEN e.before <> q.before AND e.after <> q.after AND bit_count(xor(e.state, q.state)) <= 18 THEN 'near_before_different_after' END,
    CASE WHEN e.path = q.path THEN 'same_file' END,
    CASE WHEN e.source = q.source THEN 'same_source' END,
    CASE WHEN e.edit_size // 500 = q.edit_size // 500 THEN 'same_edit_size_bucket' END,
    CASE WHEN e.cluster = q.cluster THEN 'same_action_cluster' END], lambda x: x IS NOT NULL) AS rs
  FROM ent e JOIN q ON e.id <> q.id WHERE e.split <> 'train'),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY len(rs) DESC, sha256('0:' || query_id || ':' || id), id)::INT AS rank,
    id, array_to_string(rs, ',') AS reasons FROM p QUALIFY rank <= 10)"""
POOL_RULES = """[
    CASE WHEN e.before = q.before AND e.after <> q.after THEN 'exact_same_before' END,
    CASE WHEN e.before <> q.before AND e.after <> q.after AND bit_count(xor(e.state, q.state)) <= 18 THEN 'near_before' END,
    CASE WHEN e.path = q.path AND e.after <> q.after THEN 'same_file' END,
    CASE WHEN e.cluster = q.cluster AND e.after <> q.after THEN 'action_cluster' END,
    CASE WHEN e.shape = q.shape AND e.after <> q.after THEN 'edit_shape' END,
    CASE WHEN e.mutated AND e.after <> q.after THEN 'mutation' END, 'random']"""
EXE = """e AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS record_id, (l_orderkey % 5000)::VARCHAR AS problem_id,
  (l_orderkey % 5000)::VARCHAR || ':' || (l_suppkey % 20)::VARCHAR AS submission_id, l_linenumber::VARCHAR AS input_id, max(l_returnflag) AS output,
  CASE l_orderkey % 5000 % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber)"""
FIRST = "QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY sha256('0:' || b.record_id), b.record_id) <= 1"
RELATION = "CASE WHEN a.input_id = b.input_id THEN 'same_input_id' ELSE 'different_input_id' END AS relation"
PROBLEM = (
    f"SELECT 'same_problem_different_submission' AS category, a.record_id AS query_id, b.record_id AS decoy_id, {RELATION}, "
    f"a.split, a.problem_id FROM {{a}} a JOIN {{a}} b ON a.problem_id = b.problem_id AND a.submission_id <> b.submission_id "
    f"AND a.output <> b.output"
)
CODE = (
    f"SELECT 'same_code_different_input' AS category, a.record_id AS query_id, b.record_id AS decoy_id, {RELATION}, a.split, "
    f"a.problem_id FROM {{a}} a JOIN {{a}} b ON a.submission_id = b.submission_id AND a.input_id <> b.input_id AND a.output "
    f"<> b.output"
)


def _skip_sql(category: str, same: str, unlike: str, none: str) -> str:
    return f"""SELECT '{category}' AS category, CASE WHEN others = 0 THEN '{none}' WHEN differing = 0 THEN 'outputs_identical' ELSE 'paired' END AS reason, count(*) AS n
      FROM (SELECT a.record_id, count(b.record_id) AS others, count(b.record_id) FILTER (WHERE a.output <> b.output) AS differing
            FROM e a LEFT JOIN e b ON {same} AND a.{unlike} <> b.{unlike} GROUP BY a.record_id) GROUP BY 2"""


ORACLES = {
    "hard_negative_pool": HARD + " SELECT * FROM r",
    "hard_negative_rejections": (
        f"WITH {ENT}, {HELD} SELECT q.id AS query_id, count(*) FILTER (WHERE e.id = q.id) AS true_target, count(*) FILTER "
        f"(WHERE e.id <> q.id) AS train_leakage FROM ent e JOIN q ON e.id = q.id OR e.split = 'train' GROUP BY 1"
    ),
    "hard_candidate_pool": HARD + " SELECT query_id, rank AS position, id FROM r UNION ALL SELECT id, 0, id FROM q",
    "contrast_pools": (
        f"WITH {ENT}, {HELD}, p AS (SELECT q.id AS query_id, e.id, unnest({POOL_RULES}) AS pool FROM ent e JOIN q ON e.id "
        f"<> q.id WHERE e.split <> 'train') SELECT query_id, pool, id FROM p WHERE pool IS NOT NULL QUALIFY row_number() OVER "
        f"(PARTITION BY query_id, pool ORDER BY sha256('0:' || query_id || ':' || pool || ':' || id), id) <= 5"
    ),
    "surprise_decoys": f"""WITH {ENT}, {HELD}, p AS (SELECT q.id AS query_id, e.id, e.path = q.path AS f, e.cluster = q.cluster AS c FROM ent e JOIN q ON e.id <> q.id AND e.after <> q.after),
      k AS (SELECT query_id, id, 'random' AS category FROM p UNION ALL SELECT query_id, id, 'same_file' FROM p WHERE f UNION ALL SELECT query_id, id, 'action_cluster' FROM p WHERE c),
      w AS (SELECT * FROM k UNION ALL SELECT query_id, id, category FROM p, (VALUES ('same_file'), ('action_cluster')) v(category) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = p.query_id AND k.category = v.category))
      SELECT query_id, category, id FROM w QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY sha256('0:' || query_id || ':' || category || ':' || id), id) <= 3""",
    "decoy_pairs_same_problem": f"WITH {EXE} SELECT category, query_id, decoy_id, relation FROM (" + PROBLEM.format(a="e") + f" AND a.input_id = b.input_id {FIRST})",
    "decoy_pairs_same_code": f"WITH {EXE} SELECT category, query_id, decoy_id, relation FROM (" + CODE.format(a="e") + f" {FIRST})",
    "decoy_skip_counts": f"WITH {EXE} " + _skip_sql(
        "same_problem_different_submission",
        "a.problem_id = b.problem_id AND a.input_id = b.input_id",
        "submission_id",
        "no_other_submission"
    ) + " UNION ALL " + _skip_sql(
        "same_code_different_input", "a.submission_id = b.submission_id", "input_id", "no_other_input"
    ),
    "semantic_decoy_pack": f"WITH {EXE} SELECT *, NULL::VARCHAR AS leak FROM (" + " UNION ALL ".join(
        f"(SELECT * FROM ({x.format(a=f'''(SELECT * FROM e WHERE split = '{sp}')''')} {FIRST}))" for sp in ("val", "test") for x in (PROBLEM, CODE)
    ) + ")",
    "scorable_pairs": f"WITH {EXE}, p AS (" + CODE.format(a="e") + (
        f" {FIRST}) SELECT category, count(*) AS pairs, count(*) FILTER (WHERE x.input_id <> '3' AND y.input_id <> '3') AS "
        f"scorable, count(*) FILTER (WHERE x.input_id = '3' OR y.input_id = '3') AS skipped FROM p JOIN e x ON x.record_id "
        f"= query_id JOIN e y ON y.record_id = decoy_id GROUP BY 1"
    ),
    "easy_pool": "SELECT doc_id AS id FROM documents ORDER BY sha256('0:' || doc_id), doc_id LIMIT 50",
    "per_split_sample": (
        f"WITH {ENT} SELECT split, id FROM ent QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256('0:' || id), "
        f"id) <= 20"
    ),
    "problem_split_by_rank": (
        "WITH p AS (SELECT l_orderkey, row_number() OVER (ORDER BY sha256('0:' || l_orderkey), l_orderkey) AS place, count(*) "
        "OVER () AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem)), t AS (SELECT *, greatest(1, floor(n * 0.1::DOUBLE)) "
        "AS nv, greatest(1, n - greatest(1, floor(n * 0.8::DOUBLE)) - greatest(1, floor(n * 0.1::DOUBLE))) AS nt FROM p) "
        "SELECT l_orderkey, CASE WHEN place <= n - nv - nt THEN 'train' WHEN place <= n - nt THEN 'val' ELSE 'test' END AS "
        "split FROM t"
    ),
    "token_decoys": (
        r"WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda "
        r"x: length(x)) AS a FROM conversations), p AS (SELECT conv_id, turn, list_concat(a[1:8], list_transform(range(0, "
        r"greatest(0, 8 - len(a))), lambda x: 0)) AS ids FROM t) SELECT conv_id, turn, array_to_string(CASE WHEN ids[1] > "
        r"0 THEN list_concat([ids[1] % 9 + 1], ids[2:8]) ELSE ids END, ' ') AS ids FROM p"
    ),
}
