"""Curation queries over documents, conversations, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pyast
from ..functions import text as T
from ..operators import curation as C
from ..sources import shared
from .common import LICENSED_SQL, read, records, split_sql

KEY = "(source || '/' || doc_id::VARCHAR)"
REC = (
    f"rec AS (SELECT doc_id, source, lang, text, {split_sql(KEY)} AS split, sha256(text || chr(0)) AS pair, sha256(text "
    f"|| chr(0) || lang || chr(0)) AS transition FROM documents)"
)
DEDUP = f"""WITH {REC}, leak AS (SELECT pair, max(doc_id) AS leak_id FROM rec WHERE split = 'train' GROUP BY pair),
  m AS (SELECT rec.*, leak_id, split <> 'train' AND leak_id IS NOT NULL AS leaks FROM rec LEFT JOIN leak USING (pair)),
  f AS (SELECT pair, min(doc_id) AS first_id, arg_min(transition, doc_id) AS ft FROM m WHERE NOT leaks GROUP BY pair),
  out AS (SELECT doc_id, split, CASE WHEN leaks THEN 'train_leakage' WHEN first_id < doc_id THEN 'exact_duplicate' END AS drop_reason,
    CASE WHEN leaks THEN 'exact_before_after' WHEN first_id < doc_id AND ft = transition THEN 'exact_transition'
         WHEN first_id < doc_id THEN 'exact_before_after' END AS match_type,
    CASE WHEN leaks THEN leak_id WHEN first_id < doc_id THEN first_id END AS matched_id FROM m LEFT JOIN f USING (pair))"""


def license_gate_report(s, d):
    return C.license_report(records(s, d))


def source_license_counts(s, d):
    return records(s, d).groupBy(
        "source", F.coalesce("decision.license", F.lit("missing")).alias("license")
    ).agg(F.count(F.lit(1)).alias("n"))


def split_assignment(s, d):
    return records(s, d).select("doc_id", "split")


def split_counts(s, d):
    return C.zero_filled(records(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", C.SPLITS)


def exact_dedup_keep_first(s, d):
    return C.keep_first(records(s, d), "pair", "doc_id").where("first_id = doc_id").select("doc_id")


def train_leakage_exact(s, d):
    return C.exact_leakage(records(s, d), "pair", "doc_id").select("doc_id", "split", "leak_id")


def split_dedup(s, d):
    return C.split_dedup(
        records(s, d).select("doc_id", "split", "pair", "transition"), "transition", "pair", "doc_id"
    ).select("doc_id", "split", "drop_reason", "match_type", "matched_id")


def split_dedup_report(s, d):
    return split_dedup(s, d).groupBy(
        "split", F.coalesce("drop_reason", F.lit("kept")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("n"))


def split_dedup_near(s, d):
    """split_dedup with the near step: a simhash within 3 bits of a train row's leaks too.

    Keys are made of the texts once and written; three sides of the joins read them.
    """
    r = records(s, d).select("doc_id", "split", "pair", "transition", pyast.simhash("text").alias("state"))
    return C.split_dedup(shared.stored(r, "keys"), "transition", "pair", "doc_id", "state").select(
        "doc_id", "split", "drop_reason", "match_type", "matched_id"
    )


def transitions(s, d):
    """Consecutive turns: before is a turn's text, after the next one's."""
    c = read(s, d, "conversations").select("conv_id", "turn", "role", "text")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.withColumnRenamed("text", "before").join(following, ["conv_id", "turn"])


def filter_cascade(s, d):
    t = transitions(s, d)
    return t.select(
        "conv_id", "turn", C.first_reason(C.edit_rules(F.col("before"), F.col("after"), F.col("before"))).alias("drop_reason")
    )


def filter_cascade_report(s, d):
    return filter_cascade(s, d).groupBy(
        F.coalesce("drop_reason", F.lit("kept")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))


TRIM = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
CASCADE = rf"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS before, b.text AS after FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  c AS (SELECT conv_id, turn, CASE WHEN length({TRIM.format(x='before')}) = 0 OR length({TRIM.format(x='after')}) = 0 THEN 'empty_state'
    WHEN regexp_replace(before, '\s+', '', 'g') = regexp_replace(after, '\s+', '', 'g') THEN 'whitespace_only_change'
    WHEN NOT length({TRIM.format(x='before')}) BETWEEN 8 AND 512 THEN 'message_length' END AS drop_reason FROM t)"""


def drop_reason_by_source(s, d):
    r = records(s, d)
    return r.groupBy("source").agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if("decision.allowed").alias("included"),
        F.count_if(~F.col("decision.allowed")).alias("excluded")
    )


def row_accounting(s, d):
    r = C.split_dedup(records(s, d).select("doc_id", "split", "pair", "transition"), "transition", "pair", "doc_id")
    n = r.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(F.col("drop_reason").isNull()).alias("kept"),
        F.count_if(F.col("drop_reason") == "train_leakage").alias("leaked"),
        F.count_if(F.col("drop_reason") == "exact_duplicate").alias("duplicates")
    )
    return n.withColumn("balanced", F.col("loaded") == F.col("kept") + F.col("leaked") + F.col("duplicates"))


def secret_scan_findings(s, d):
    """documents, every tenth with a line that holds a made-up secret of one of four kinds."""
    value = F.concat(
        F.element_at(F.array(*map(F.lit, ("sk-", "ghp_", "xoxb-", "AKIA"))), (F.col("doc_id") % 4 + 1).cast("int")),
        F.upper(F.md5(F.col("doc_id").cast("string")))
    )
    line = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("\nkey: "), value)).otherwise("")
    docs = read(s, d, "documents").select("doc_id", F.concat("text", line).alias("text"))
    return C.secret_findings(docs, "doc_id", "text")


def redact_text(s, d):
    return read(s, d, "conversations").select(
        "conv_id", "turn", F.sha2(T.redacted(F.col("text")), 256).alias("redacted_sha256")
    )


def redact_fields(s, d):
    note = F.concat(F.lit("see /home/someone/x and ghp_ABCDEFGHIJKL0123 of "), "n_name")
    fields = T.redacted_fields(F.create_map(F.lit("Api-Key"), F.col("n_name"), F.lit("note"), note))
    return read(s, d, "nation").withColumn("f", fields).select(
        "n_nationkey", F.col("f")["Api-Key"].alias("api_key"), F.col("f")["note"].alias("note")
    )


def path_redaction(s, d):
    return read(s, d, "pages").select("page_id", T.redacted_path(F.regexp_replace("url", "^https?://[^/]*", "")).alias("path"))


def problem_split(s, d):
    p = read(s, d, "lineitem").select("l_orderkey").distinct()
    return p.select("l_orderkey", T.split_name(F.col("l_orderkey").cast("string")).alias("split"))


def split_leakage_report(s, d):
    o = read(s, d, "orders")
    return C.split_leakage(
        o.select(F.col("o_custkey").alias("custkey"), T.split_name(F.col("o_orderkey").cast("string")).alias("split")),
        "custkey"
    )


def group_pair_counts(s, d):
    return C.group_pair_counts(records(s, d), "source", "pair").select("source", "n", "pairs")


def top_counts(s, d):
    return C.top_counts(read(s, d, "documents"), "source", 10)


def bucket_distributions(s, d):
    n = read(s, d, "documents").select(F.size(F.split("text", "\n")).alias("lines"))
    return n.groupBy(T.edit_size_bucket(F.col("lines")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def token_counts(s, d):
    return read(s, d, "documents").select(
        "doc_id",
        F.size(T.tokens(F.col("text"))).cast("long").alias("n_code"),
        F.size(T.tokens(F.col("text"), T.WORD_TOKEN)).cast("long").alias("n_word"),
        F.size(T.tokens(F.col("text"), T.NAME_TOKEN)).cast("long").alias("n_name")
    )


def token_count_buckets(s, d):
    n = read(s, d, "conversations").select(F.size(T.tokens(F.col("text"))).alias("n"))
    return n.groupBy(T.token_count_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def padded_tokens(s, d):
    ids = F.transform(T.tokens(F.col("text"), T.NAME_TOKEN), lambda x: F.length(x).cast("long"))
    p = read(s, d, "conversations").select("conv_id", "turn", F.size(ids).alias("full"), T.padded(ids, 64).alias("ids"))
    return p.select(
        "conv_id",
        "turn",
        F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"),
        (F.col("full") > 64).alias("truncated")
    )


def _md5_keys(s, d):
    """doc_id, key: simhash over md5 halves of the words."""
    docs = read(s, d, "documents")
    h = lambda w: F.conv(F.substring(F.md5(w), 1, 13), 16, 10).cast("long")
    words = docs.select("doc_id", F.explode(F.split("text", " ")).alias("w")).withColumn("h", h(F.col("w")))
    bits = [F.sum(F.when(F.shiftright("h", i).bitwiseAND(1) == 1, 1).otherwise(-1)).alias(f"b{i}") for i in range(48)]
    weights = words.groupBy("doc_id").agg(*bits)
    key = sum((F.when(F.col(f"b{i}") >= 0, F.lit(1 << i)).otherwise(0) for i in range(48)), F.lit(0)).cast("long")
    return weights.select("doc_id", key.alias("key"))


def near_dup_pairs_md5(s, d):
    """Near pairs of a simhash over md5 halves of the words: a variant that SQL can follow.

    One document stands for all of an equal key; near_dup_members_md5 names the others.
    """
    return C.near_pairs(_md5_keys(s, d), "doc_id", "key", 3, 48).select(
        "left_id", "right_id", F.col("distance").cast("int").alias("distance")
    )


def near_dup_members_md5(s, d):
    """Of every document the one that stands for it in near_dup_pairs_md5; one without text is its own."""
    every = read(s, d, "documents").select("doc_id").distinct().join(_md5_keys(s, d), "doc_id", "left")
    return C.key_members(every, "doc_id", "key").select("doc_id", "representative")


QUERIES = {
    f.__name__: f for f in (
        license_gate_report,
        source_license_counts,
        split_assignment,
        split_counts,
        exact_dedup_keep_first,
        train_leakage_exact,
        split_dedup,
        split_dedup_report,
        split_dedup_near,
        filter_cascade,
        filter_cascade_report,
        drop_reason_by_source,
        row_accounting,
        secret_scan_findings,
        redact_text,
        redact_fields,
        path_redaction,
        problem_split,
        split_leakage_report,
        group_pair_counts,
        top_counts,
        bucket_distributions,
        token_counts,
        token_count_buckets,
        padded_tokens,
        near_dup_pairs_md5,
        near_dup_members_md5
    )
}

CODE, NAME = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\s\x0b]", r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
# DuckDB's patterns have no look-behind; before "sk-" a word border says the same
SECRET = T.SECRET_VALUE.replace("(?<![A-Za-z0-9_])", r"\b")

ORACLES = {
    "license_gate_report": f"""WITH {LICENSED_SQL} SELECT included, kind, value, count(*) AS n FROM (
        SELECT allowed AS included, 'license' AS kind, coalesce(license, 'missing') AS value FROM dec
        UNION ALL SELECT allowed, 'source', source FROM dec UNION ALL SELECT allowed, 'reason', reason FROM dec) GROUP BY ALL""",
    "source_license_counts": f"WITH {LICENSED_SQL} SELECT source, coalesce(license, 'missing') AS license, count(*) AS n FROM dec GROUP BY ALL",
    "split_assignment": f"WITH {REC} SELECT doc_id, split FROM rec",
    "split_counts": (
        f"WITH {REC} SELECT s.split, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT "
        f"JOIN (SELECT split, count(*) AS n FROM rec GROUP BY split) c ON c.split = s.split"
    ),
    "exact_dedup_keep_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "train_leakage_exact": (
        f"WITH {REC} SELECT rec.doc_id, rec.split, leak_id FROM rec JOIN (SELECT pair, max(doc_id) AS leak_id FROM rec WHERE "
        f"split = 'train' GROUP BY pair) USING (pair) WHERE split <> 'train'"
    ),
    "split_dedup": f"{DEDUP} SELECT * FROM out",
    "split_dedup_report": f"{DEDUP} SELECT split, coalesce(drop_reason, 'kept') AS outcome, count(*) AS n FROM out GROUP BY ALL",
    "filter_cascade": f"{CASCADE} SELECT * FROM c",
    "filter_cascade_report": f"{CASCADE} SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM c GROUP BY ALL",
    "drop_reason_by_source": (
        f"WITH {LICENSED_SQL} SELECT source, count(*) AS loaded, count(*) FILTER (WHERE allowed) AS included, count(*) FILTER "
        f"(WHERE NOT allowed) AS excluded FROM dec GROUP BY source"
    ),
    "row_accounting": (
        f"{DEDUP} SELECT *, loaded = kept + leaked + duplicates AS balanced FROM (SELECT count(*) AS loaded, count(*) FILTER "
        f"(WHERE drop_reason IS NULL) AS kept, count(*) FILTER (WHERE drop_reason = 'train_leakage') AS leaked, count(*) FILTER "
        f"(WHERE drop_reason = 'exact_duplicate') AS duplicates FROM out)"
    ),
    "secret_scan_findings": (
        rf"WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN chr(10) || 'key: ' || (['sk-', 'ghp_', 'xoxb-', "
        rf"'AKIA'])[doc_id % 4 + 1] || upper(md5(doc_id::VARCHAR)) ELSE '' END AS text FROM documents), l AS (SELECT doc_id, "
        rf"unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no "
        rf"FROM t) SELECT doc_id, line_no, sha256(unnest(regexp_extract_all(line, '{SECRET}'))) AS digest FROM l WHERE regexp_matches(line, "
        rf"'{SECRET}')"
    ),
    "redact_text": (
        rf"WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(/home|/Users)/[^/\s]+', '~', 'g'), '{SECRET}', "
        rf"'[REDACTED_SECRET]', 'g') AS t FROM conversations), n AS (SELECT *, len(string_split(t, chr(10))) - CASE WHEN ends_with(t, "
        rf"chr(10)) THEN 1 ELSE 0 END AS n FROM c) SELECT conv_id, turn, sha256(CASE WHEN n > 20 OR length(t) > 4000 THEN '[REDACTED_LONG_TEXT "
        rf"sha256=' || substr(sha256(t), 1, 16) || ' lines=' || n || ' chars=' || length(t) || ']' ELSE t END) AS redacted_sha256 "
        rf"FROM n"
    ),
    "redact_fields": "SELECT n_nationkey, '[REDACTED_SECRET]' AS api_key, 'see ~/x and [REDACTED_SECRET] of ' || n_name AS note FROM nation",
    "path_redaction": (
        "SELECT page_id, CASE WHEN p LIKE '/%' THEN '<redacted:absolute:sha256=' || sha256(p) || '>' ELSE p END AS path FROM "
        "(SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS p FROM pages)"
    ),
    "problem_split": f"SELECT l_orderkey, {split_sql('l_orderkey::VARCHAR')} AS split FROM (SELECT DISTINCT l_orderkey FROM lineitem)",
    "split_leakage_report": (
        f"SELECT custkey, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM (SELECT o_custkey AS custkey, "
        f"{split_sql('o_orderkey::VARCHAR')} AS split FROM orders) GROUP BY custkey HAVING count(DISTINCT split) > 1"
    ),
    "group_pair_counts": (
        "SELECT source, sum(m)::BIGINT AS n, (sum(m) * (sum(m) - 1) // 2 - sum(m * (m - 1) // 2))::BIGINT AS pairs FROM (SELECT "
        "source, text, count(*) AS m FROM documents GROUP BY ALL) GROUP BY source"
    ),
    "top_counts": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "bucket_distributions": (
        "SELECT CASE WHEN n <= 2 THEN 'xs:0-2' WHEN n <= 10 THEN 's:3-10' WHEN n <= 50 THEN 'm:11-50' WHEN n <= 150 THEN "
        "'l:51-150' ELSE 'xl:151+' END AS bucket, count(*) AS n FROM (SELECT len(string_split(text, chr(10))) AS n FROM documents) "
        "GROUP BY 1"
    ),
    "token_counts": (
        rf"SELECT doc_id, len(regexp_extract_all(text, '{CODE}'))::BIGINT AS n_code, len(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]'))::BIGINT "
        rf"AS n_word, len(regexp_extract_all(text, '{NAME}'))::BIGINT AS n_name FROM documents"
    ),
    "token_count_buckets": (
        rf"SELECT CASE WHEN n = 0 THEN 'empty' WHEN n <= 4 THEN 'xs:1-4' WHEN n <= 16 THEN 's:5-16' WHEN n <= 64 THEN 'm:17-64' "
        rf"WHEN n <= 256 THEN 'l:65-256' ELSE 'xl:257+' END AS bucket, count(*) AS rows FROM (SELECT len(regexp_extract_all(text, "
        rf"'{CODE}')) AS n FROM conversations) GROUP BY 1"
    ),
    "padded_tokens": (
        rf"WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '{NAME}'), lambda x: length(x)) AS ids "
        rf"FROM conversations) SELECT conv_id, turn, array_to_string(list_concat(ids[1:64], list_transform(range(0, greatest(0, "
        rf"64 - len(ids))), lambda x: 0)), ' ') AS ids, len(ids) > 64 AS truncated FROM t"
    ),
    "near_dup_pairs_md5": (
        "WITH w AS (SELECT doc_id, ('0x' || substr(md5(unnest(string_split(text, ' '))), 1, 13))::BIGINT AS h FROM documents), "
        "b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM w, range(0, 48) r(i) GROUP "
        "BY ALL), k AS (SELECT doc_id, sum(CASE WHEN s >= 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS key FROM b GROUP BY "
        "doc_id), o AS (SELECT key, min(doc_id) AS doc_id FROM k GROUP BY key) SELECT l.doc_id AS left_id, r.doc_id AS right_id, "
        "bit_count(xor(l.key, r.key))::INT AS distance FROM o l JOIN o r ON l.doc_id < r.doc_id AND bit_count(xor(l.key, "
        "r.key)) <= 3"
    ),
    "near_dup_members_md5": (
        "WITH w AS (SELECT doc_id, ('0x' || substr(md5(unnest(string_split(text, ' '))), 1, 13))::BIGINT AS h FROM documents), "
        "b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM w, range(0, 48) r(i) GROUP "
        "BY ALL), k AS (SELECT doc_id, sum(CASE WHEN s >= 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS key FROM b GROUP BY "
        "doc_id) SELECT d.doc_id, coalesce(min(k.doc_id) OVER (PARTITION BY k.key), d.doc_id) AS representative FROM (SELECT "
        "DISTINCT doc_id FROM documents) d LEFT JOIN k USING (doc_id)"
    ),
}
