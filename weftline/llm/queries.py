"""The registered queries of this folder: op1 to op13, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import annsearch, bpecount, decontam, divergence, jaccard, langid, mixlm, packing, pagetext, spelling, substring, tokenfile, toxicity
from .storage import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.scores(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "class_id", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpecount.token_counts(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.search(table(spark, sf_dir, "embeddings"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_token_file": op7_token_file,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_main_text": op11_main_text,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}

#: The word pattern of the contracts.
WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op2_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS s, ws FROM w WHERE len(ws) >= 35),
        h AS (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 34], ' ')) AS h FROM win),
        rep AS (SELECT doc_id, s FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM rep),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
                 FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
                 WHERE gone.p IS NULL GROUP BY words.doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op4_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
        el AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
                 FROM el a JOIN el b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, edge.b FROM reach JOIN edge ON reach.y = edge.a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, comp.c AS component_id, same.c AS class_id FROM sets
        JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) comp ON comp.x = doc_id
        JOIN (SELECT doc_id AS d, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS c FROM sets) same ON same.d = doc_id""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t
            FROM range(256) r(i)),
        runs AS (SELECT doc_id, unnest(regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
                 FROM documents),
        counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS n FROM runs WHERE length(run) > 6 GROUP BY ALL),
        hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''),
                   lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + ord(c) // 64)::BIGINT, 128 + ord(c) % 64] END))),
                   lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM counted, crc),
        made AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
                 FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) > 6 GROUP BY word HAVING sum(n) > 1),
        cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
                 FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
                  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
        best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM pairs GROUP BY word),
        forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form,
                  CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best ON words.word = best.word),
        way AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, way.root FROM forms f JOIN way ON f.form = way.word)
        SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN way ON forms.word = way.word""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        t AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS c, any_value(total) AS total FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + v.v)::HUGEINT AS p
              FROM g JOIN v ON g.lang = v.lang JOIN kept ON kept.lang = g.lang
              LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
        own AS (SELECT p.lang, p.source, p.term, p.p, 1 + 1000000000::HUGEINT * (c.total + 1) // (v.n + v.v)::HUGEINT AS q
                FROM c JOIN p ON p.lang = c.lang AND p.source = c.source AND p.term = c.term JOIN v ON v.lang = c.lang),
        term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM own WHERE p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 200""",
}
