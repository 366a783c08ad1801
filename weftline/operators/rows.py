"""Row builders: transitions, evaluation, diagnostic, probe and index rows, and candidate packs."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical, codepack, diffs, pyast, pystate
from ..functions import text as T

# Classes of hard negatives by the kind of their mutation.
CLASS_OF_MUTATION = {
    "compare": "off_by_one_or_boundary",
    "const": "off_by_one_or_boundary",
    "not": "inverted_condition",
    "boolop": "inverted_condition"
}
OTHER_CLASS = "wrong_operator"
SMALLEST_POOL, LARGEST_POOL = 6, 12
COMMENT = "# no-op clarifying comment, no behavior change"


def dedup_keys(before: Column, after: Column, action: Column, shape: Column) -> Column:
    """struct of the four keys of an edit: pair, transition, simhash of the state, diff shape."""
    a, b = T.normal_code(before), T.normal_code(after)
    return F.struct(
        T.parts_hash(a, b).alias("exact_before_after"),
        T.parts_hash(a, diffs.folded_action(action), b).alias("exact_transition"),
        pyast.simhash(a).alias("near_state"),
        shape.alias("diff_shape"),
    )


def transition_id(df: DataFrame) -> Column:
    """24 hex digits over source, repo, commit, path and keys, as canonical JSON."""
    wanted = sorted(c for c in ("commit", "dedup", "path", "repo", "source") if c in df.columns)
    return F.concat(F.lit("transition-"), F.substring(canonical.canonical_sha256(F.struct(*wanted)), 1, 24))


def transitions(edits: DataFrame, limit: int = codepack.TOKEN_BUDGET, strict: bool = False) -> DataFrame:
    """Edit records with a split as transitions: states, masks, action tokens, keys, flags.

    edits: source, repo, commit, path_before, path_after, before, after, message, license, split.
    Records that don't parse have null states. A state whose changed lines and shape don't fit the
    budget has no tokens and says so in state_*_error; strict makes that an error of the job.
    """
    e = edits.withColumn("_shape", diffs.diff_shape("before", "after")).withColumn(
        "_lines", diffs.changed_lines("before", "after")
    )
    packed = codepack.packed_state(limit)
    for side in ("before", "after"):
        e = e.withColumn(f"_{side}", pystate.code_state(side, F.col(f"_lines.{side}")))
        e = e.withColumn(f"_{side}_pack", packed(F.col(f"_{side}"), F.col(f"path_{side}")))
        if strict:
            fits = F.col(f"_{side}_pack.error").isNull()
            why = F.concat(F.lit(f"{side} of "), "path_after", F.lit(": "), F.col(f"_{side}_pack.error"))
            e = e.withColumn(f"_{side}_pack", F.when(fits, F.col(f"_{side}_pack")).otherwise(F.raise_error(why)))
    size = F.when(F.col("_shape.changed_lines") <= 2, "SMALL").when(
        F.col("_shape.changed_lines") <= 10, "MEDIUM"
    ).otherwise("LARGE")
    e = e.withColumn(
        "dedup", dedup_keys(F.col("before"), F.col("after"), F.col("message"), diffs.diff_shape_hash(F.col("_shape")))
    )
    e = e.withColumn("path", F.col("path_after")).withColumn(
        "action_abs", pyast.abstract_edits("before", "after", size, F.lit(32))
    )
    none = F.array().cast("array<string>")
    flags_of = lambda s: F.transform(
        F.coalesce(F.col(f"_{s}_pack.dropped"), none), lambda x: F.concat(F.lit(f"{s}_dropped:"), x)
    )
    flags = F.concat(flags_of("before"), flags_of("after"))
    state = lambda s: [
        F.col(f"_{s}_pack.ids").alias(f"state_{s}_input_ids"),
        F.transform(f"_{s}_pack.ids", lambda _: F.lit(True)).alias(f"state_{s}_attention_mask"),
        F.col(f"_{s}_pack.segments").alias(f"state_{s}_segment_ids"),
        F.col(f"_{s}_pack.changed").alias(f"state_{s}_changed_hunk_mask"),
        F.col(f"_{s}.changed").alias(f"state_{s}_changed_lines"),
        F.col(f"_{s}_pack.token_count").alias(f"token_count_{s}"),
        F.col(f"_{s}_pack.error").alias(f"state_{s}_error"),
        F.col(f"_{s}.kind").alias(f"state_{s}_kind"),
        F.col(f"_{s}.symbol").alias(f"state_{s}_symbol"),
        F.col(f"_{s}.fallback").alias(f"state_{s}_fallback_reason"),
        T.module_name(F.col(f"path_{s}")).alias(f"state_{s}_module"),
    ]
    words = T.tokens(T.normal_action(F.col("message")), T.WORD_TOKEN)
    return e.select(
        transition_id(e).alias("transition_id"), "source", "repo", "commit", "path", "split", *state("before"), *state("after"),
        codepack.token_ids(words).alias("action_text_input_ids"), "action_abs",
        F.col("_shape.changed_lines").alias("edit_size"), "license", flags.alias("filter_flags"), F.col("dedup"),
    )


def evaluation_rows(transitions_: DataFrame) -> DataFrame:
    """What retrieval needs of a transition: ids as text, hashes, buckets, kinds; null as ''."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return transitions_.select(
        "transition_id", text("source"), text("repo"), text("path"), "split", "edit_size",
        (F.floor(F.col("edit_size") / 10) * 10).cast("int").alias("edit_size_decade"),
        T.ids_text(
            F.col("state_before_input_ids")
        ).alias("before_text"), T.ids_text(F.col("action_text_input_ids")).alias("action_text"),
        T.int_sequence_hash(
            F.col("state_before_input_ids")
        ).alias("state_before_hash"), T.int_sequence_hash(F.col("state_after_input_ids")).alias("state_after_hash"),
        T.action_signature(
            F.col("action_text_input_ids")
        ).alias("action_cluster"), F.col("dedup.diff_shape").alias("diff_shape"), text("state_after_kind"), text("state_after_symbol"),
        text("state_after_fallback_reason"),
    )


def diagnostic_rows(transitions_: DataFrame) -> DataFrame:
    """Hashes and named buckets of a transition, for reports on shards."""
    n = F.size("state_before_input_ids")
    return transitions_.select(
        "transition_id", T.int_sequence_hash(
            F.col("state_before_input_ids")
        ).alias("before_hash"), T.int_sequence_hash(F.col("state_after_input_ids")).alias("after_hash"),
        T.action_signature(
            F.col("action_text_input_ids")
        ).alias("action"), T.edit_size_bucket(F.col("edit_size")).alias("edit_bucket"), T.token_count_bucket(n).alias("token_bucket"),
    )


def execution_evaluation_rows(records: DataFrame, width: int, vocabulary: int) -> DataFrame:
    """record_id, padded and folded token ids, and the same as text."""
    ids = F.transform(T.padded(F.col("tokens"), width), lambda x: T.fold_to_vocabulary(x, vocabulary))
    return records.select("record_id", ids.alias("ids"), T.ids_text(ids).alias("ids_text"))


def execution_records(rows: DataFrame) -> DataFrame:
    """Adds record_id of problem, submission and input."""
    return rows.withColumn("record_id", F.concat_ws("::", "problem_id", "submission_id", "input_id"))


def index_entries(rows: DataFrame) -> DataFrame:
    """id, vector and the four attributes that an index keeps."""
    return rows.select(
        F.col("transition_id").alias("id"), "vector", *(c for c in ("repo", "path", "message", "license") if c in rows.columns)
    )


def symbol_kind(kind: Column, symbol: Column, fallback: Column) -> Column:
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(known(kind) & known(symbol), F.concat(kind, F.lit(":named")))
        .when(
            kind.isin("region", "small_file"),
            F.concat(kind, F.lit(":fallback:"), F.when(known(fallback), fallback).otherwise("unknown"))
        )
        .when(known(kind), F.concat(kind, F.lit(":unnamed")))
    )


def probe_rows(rows: DataFrame) -> DataFrame:
    """Probe labels and metadata features of evaluation rows, with their fallbacks."""
    none = lambda c: F.when(F.col(c) != "", F.col(c))
    suffix = F.regexp_extract("path", r"[^/.][^/]*(\.[^./]+)$", 1)
    bucket = T.edit_size_bucket(F.col("edit_size"))
    kind = symbol_kind(F.col("state_after_kind"), F.col("state_after_symbol"), F.col("state_after_fallback_reason"))
    return rows.select(
        "transition_id", "split", F.coalesce(
            none("diff_shape"), bucket
        ).alias("edit_class"), none("state_after_kind").alias("ast_node_kind"), kind.alias("symbol_kind"),
        bucket.alias("edit_size_bucket"), none("action_cluster").alias("action_cluster"), none("source").alias("source_family"),
        F.when(suffix == "", "<none>").otherwise(suffix).alias("path_suffix"), F.coalesce(
            kind, F.lit("<missing>")
        ).alias("symbol_feature"),
    )


def lexical_matrix(rows: DataFrame, ident: str, tokens: str, width: int = 256) -> DataFrame:
    """ident, dim, value: unit vectors of token counts by token modulo the width."""
    each = rows.select(ident, F.explode(tokens).alias("t")).groupBy(
        ident, F.pmod("t", F.lit(width)).alias("dim")
    ).agg(F.count(F.lit(1)).alias("n"))
    norm = each.groupBy(ident).agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    return each.join(norm, ident).select(ident, "dim", (F.col("n") / F.col("norm")).alias("value"))


def hard_negative_candidates(tasks: DataFrame, pool_size: int = SMALLEST_POOL, seed: int = 0) -> DataFrame:
    """task_id, position, class, after_text, label, mutation of every task's pool.

    tasks: task_id, before_text, after_text (the passing reference, which has to parse). The
    reference, the unchanged text and a comment are first; mutants of the reference fill up.
    """
    if not SMALLEST_POOL <= pool_size <= LARGEST_POOL:
        raise ValueError(f"a pool has {SMALLEST_POOL} to {LARGEST_POOL} candidates")
    checked = tasks.withColumn("_ok", pyast.parsed("after_text"))
    reference = F.when(F.col("_ok.ok"), F.col("after_text")).otherwise(F.raise_error(F.lit("the reference doesn't parse")))
    checked = checked.withColumn("_reference", reference)
    comment = F.concat(F.rtrim(F.col("before_text"), F.lit("\n")), F.lit(f"\n{COMMENT}\n"))
    row = lambda name, text, label, how: F.struct(
        F.lit(name).alias("class"), text.alias("after_text"), F.lit(label).alias("label"), how.alias("mutation")
    )
    nothing = F.lit(None).cast("string")
    fixed = F.array(
        row("passing_reference", F.col("_reference"), "pass", nothing),
        row("no_action_bait", F.col("before_text"), "fail", nothing),
        row("near_no_action_bait", comment, "fail", nothing),
    )
    kinds = F.create_map(*[F.lit(x) for pair in CLASS_OF_MUTATION.items() for x in pair])
    made = pyast.sampled_mutants("_reference", F.lit(pool_size - 3), F.lit(seed))
    rest = F.transform(
        made,
        lambda m: F.struct(
            F.coalesce(F.element_at(kinds, m["operator"]), F.lit(OTHER_CLASS)).alias("class"),
            m["source"].alias("after_text"),
            F.lit("unknown").alias("label"),
            m["description"].alias("mutation")
        )
    )
    return checked.select(
        "task_id", F.posexplode(F.concat(fixed, rest)).alias("position", "x")
    ).select("task_id", "position", "x.*")


def benchmark_pack(tasks: DataFrame, candidates: DataFrame, generated: DataFrame) -> DataFrame:
    """Candidates of all origins under their task, ranked by origin and order, with their license.

    tasks: task_id, license; candidates, generated: task_id, candidate_id, text, label.
    Candidates of unknown tasks don't enter; equal ids of a task are an error.
    """
    every = candidates.withColumn("origin", F.lit("given")).unionByName(generated.withColumn("origin", F.lit("generated")))
    own = Window.partitionBy("task_id").orderBy(F.desc("origin"), "candidate_id")
    ranked = every.join(tasks, "task_id").withColumn("rank", F.row_number().over(own))
    twice = F.count(F.lit(1)).over(Window.partitionBy("task_id", "candidate_id"))
    checked = F.when(twice == 1, F.col("candidate_id")).otherwise(
        F.raise_error(F.concat(F.lit("repeated candidate "), F.col("candidate_id")))
    )
    return ranked.withColumn("candidate_id", checked)


def covering_seed(
    rows: DataFrame, problem: str, label: str, attempts: int = 256, train: float = 0.8, val: float = 0.1, targets: tuple[str, ...] = ()
) -> int:
    """The first seed whose split gives val and test two labels and a value of every target column.

    Seeds are tried 64 at a time: each label and target has a bit for each of them and split, in
    one pass over the problems.
    """
    kinds = F.array(
        F.struct(F.lit("label").alias("kind"), F.col(label).cast("string").alias("value")),
        *(F.struct(F.lit(f"target {t}").alias("kind"), F.when(F.col(t).isNotNull(), "").alias("value")) for t in targets),
    )
    known = rows.select(F.col(problem).cast("string").alias("p"), F.explode(kinds).alias("k")).select("p", "k.*").where("value is not null").distinct()
    for at in range(0, attempts, 64):
        some = range(at, min(at + 64, attempts))
        split = {seed: T.split_name(F.col("p"), seed=str(seed), train=train, val=val) for seed in some}
        bits = lambda s: F.bit_or(_either([F.when(split[x] == s, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for i, x in enumerate(some)]))
        found = known.groupBy("kind", "value").agg(bits("val").alias("val"), bits("test").alias("test")).collect()  # a row for each label and target
        for i, seed in enumerate(some):
            has = {s: Counter(r.kind for r in found if r[s] >> i & 1) for s in ("val", "test")}
            if all(has[s]["label"] >= 2 and all(has[s][f"target {t}"] for t in targets) for s in has):
                return seed
    raise ValueError("no seed gives val and test both labels and all targets")


def _either(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), columns)


def seed_offset(text: Column) -> Column:
    """A number from a text's sha256, to move a seed by."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def scored(rows: DataFrame, score, *inputs: str) -> DataFrame:
    """Adds score: a vectorised function of some columns, as a pandas function of series."""
    udf = F.pandas_udf(score, "double")
    return rows.withColumn("score", udf(*inputs))
