"""Filters with typed reasons, licence gates, splits, deduplication and leakage.

Every operator takes an explicit ordinal where the order of rows matters.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pyast
from ..functions import text as T

SPLITS = ("train", "val", "test")
#: Blocks that a simhash key is cut into for near joins.
BLOCKS = 6

# Path parts and file endings of generated code.
GENERATED_PARTS = ("generated", "vendor", "third_party", "node_modules", "__pycache__")
GENERATED_ENDINGS = ("_pb2.py", "_pb2_grpc.py", ".generated.py", ".gen.py")
MESSAGE_LENGTH = (8, 512)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds; null if none does."""
    found = None
    for name, rule in rules:
        found = F.when(rule, name) if found is None else found.when(rule, name)
    return found


def generated_path(path: Column) -> Column:
    low = F.lower(path)
    parts = F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, GENERATED_PARTS)))
    for ending in GENERATED_ENDINGS:
        parts = parts | low.endswith(ending)
    return parts


def edit_rules(
    before: Column, after: Column, message: Column, path_before: Column | None = None, path_after: Column | None = None
) -> list[tuple[str, Column]]:
    """The native rules of the edit filter, in their order."""
    rules = []
    if path_before is not None and path_after is not None:
        rules = [
            ("non_python_path", ~(path_before.endswith(".py") & path_after.endswith(".py"))),
            ("generated_file", generated_path(path_before) | generated_path(path_after))
        ]
    length = F.length(T.stripped(message))
    return [
        *rules,
        ("empty_state", (F.length(T.stripped(before)) == 0) | (F.length(T.stripped(after)) == 0)),
        ("whitespace_only_change", T.without_space(before) == T.without_space(after)),
        ("message_length", ~length.between(*MESSAGE_LENGTH))
    ]


EDIT_SIZE, EDIT_RATIO = (1, 150), (0.02, 0.60)
ALL_REASONS = (
    "non_python_path",
    "generated_file",
    "empty_state",
    "parse_error",
    "whitespace_only_change",
    "edit_size",
    "edit_ratio",
    "message_length",
    "license_denied"
)


def edit_cascade(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Adds drop_reason: the first of ``ALL_REASONS`` that holds for an edit record, or null.

    df: path_before, path_after, before, after, message and a licence decision. Parsing and
    comparing run in Python on rows that passed the native rules before them only, the
    quadratic comparison of characters last.
    """
    c = F.col
    cheap = first_reason([
        ("non_python_path", ~(c("path_before").endswith(".py") & c("path_after").endswith(".py"))),
        ("generated_file", generated_path(c("path_before")) | generated_path(c("path_after"))),
        ("empty_state", (F.length(T.stripped(c("before"))) == 0) | (F.length(T.stripped(c("after"))) == 0)),
    ])
    one = df.withColumn("_r1", F.coalesce(cheap, F.lit("")))
    open_text = lambda x, r: F.when(c(r) == "", c(x)).otherwise("")
    two = one.withColumn(
        "_pb", pyast.parsed(open_text("before", "_r1"))
    ).withColumn("_pa", pyast.parsed(open_text("after", "_r1")))
    same = T.without_space(c("before")) == T.without_space(c("after"))
    second = F.when(c("_r1") != "", c("_r1")).when(
        ~c("_pb.ok") | ~c("_pa.ok"), "parse_error"
    ).when(same, "whitespace_only_change").otherwise("")
    two = two.withColumn("_r2", second)
    three = two.withColumn("_m", pyast.edit_measure(open_text("before", "_r2"), open_text("after", "_r2")))
    last = (
        F.when(c("_r2") != "", c("_r2"))
        .when(~c("_m.changed_lines").between(*EDIT_SIZE), "edit_size")
        .when(~c("_m.ratio").between(*EDIT_RATIO), "edit_ratio")
        .when(~F.length(T.stripped(c("message"))).between(*MESSAGE_LENGTH), "message_length")
        .when(~c(decision)["allowed"], "license_denied")
    )
    return three.withColumn("drop_reason", last).drop("_r1", "_r2", "_pb", "_pa", "_m")


def with_split(df: DataFrame, key: Column, overrides: dict[str, str] | None = None, **ratios) -> DataFrame:
    """split of each row by the hash of its key; overrides win."""
    split = T.split_name(key, **ratios)
    for name, fixed in (overrides or {}).items():
        split = F.when(key == name, fixed).otherwise(split)
    return df.withColumn("split", split)


def keep_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Adds first_id: the ordinal of the first row with the key (its own if it is the first).

    An aggregate that combines before the exchange, and a join: a key with a third of all
    rows isn't sorted in one task, as a window would.
    """
    first = df.groupBy(key).agg(F.min(ordinal).alias("first_id"))
    return df.join(first, key)


def exact_leakage(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows outside train whose key any train row has; leak_id is the last such train row."""
    train = df.where("split = 'train'").groupBy(key).agg(F.max(ordinal).alias("leak_id"))
    return df.where("split <> 'train'").join(train, key)


def _banded(df: DataFrame, key: str, threshold: int, width: int = 64) -> DataFrame:
    """A row for each way to choose ``BLOCKS`` - threshold of a key's blocks: b (which), v (their bits).

    Two keys that differ in at most threshold bits agree in all blocks but so many, so they
    meet in one row at least. With 6 blocks of a 64-bit key and a threshold of 3, a value has
    32 bits: two keys that don't belong together rarely meet, however many keys there are.
    """
    cuts = [(width * i // BLOCKS, width * (i + 1) // BLOCKS) for i in range(BLOCKS)]
    masks = [sum(((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in chosen) for chosen in combinations(cuts, BLOCKS - threshold)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    band = [
        F.struct(F.lit(i).alias("b"), F.col(key).bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(signed)
    ]
    return df.withColumn("band", F.explode(F.array(*band))).select("*", "band.b", "band.v").drop("band")


def near_leakage(df: DataFrame, state: str, ordinal: str, threshold: int = 3) -> DataFrame:
    """Simhash keys of rows outside train within a Hamming distance of any train row's.

    near_id is the first such train row. Equal keys are joined once.
    """
    train = df.where("split = 'train'").groupBy(F.col(state).alias("train_state")).agg(F.min(ordinal).alias("near_id"))
    other = df.where("split <> 'train'").select(state).distinct()
    close = T.hamming(F.col(state), F.col("train_state")) <= threshold
    return _banded(other, state, threshold).join(
        _banded(train, "train_state", threshold), ["b", "v"]
    ).where(close).groupBy(state).agg(F.min("near_id").alias("near_id"))


def split_dedup(
    df: DataFrame, transition: str, pair: str, ordinal: str, state: str | None = None, threshold: int = 3
) -> DataFrame:
    """Adds drop_reason (train_leakage, exact_duplicate or null), match_type and matched_id.

    Leaked rows go first: those whose pair key any train row has and, if ``state`` names a
    simhash column, those whose simhash lies near a train row's. Of the rest the first of each
    pair key stays; equal transition keys imply equal pair keys, so one group decides both.
    """
    none = F.lit(None).cast(dict(df.dtypes)[ordinal])
    if state is None:
        marked = df.withColumn("near_id", none)
    else:
        marked = df.join(near_leakage(df, state, ordinal, threshold), state, "left")
    # where a key has a train row, all others of it leak and its first row is one of train
    train = F.col("split") == "train"
    here = F.struct(ordinal, transition)
    clean = F.col("near_id").isNull() | train
    keys = marked.groupBy(pair).agg(
        F.max(F.when(train, F.col(ordinal))).alias("leak_id"),
        F.coalesce(F.min(F.when(train, here)), F.min(F.when(clean, here))).alias("first"),
    )
    joined = marked.join(keys, pair)
    exact = ~train & F.col("leak_id").isNotNull()
    leaks = exact | (~train & F.col("near_id").isNotNull())
    first = F.col("first")
    later = ~leaks & (first[ordinal] < F.col(ordinal))
    reason = F.when(leaks, "train_leakage").when(later, "exact_duplicate")
    kind = F.when(exact, "exact_before_after").when(leaks, "near_state").when(
        later & (first[transition] == F.col(transition)), "exact_transition"
    ).when(later, "exact_before_after")
    matched = F.when(exact, F.col("leak_id")).when(leaks, F.col("near_id")).when(later, first[ordinal])
    return joined.withColumn("drop_reason", reason).withColumn("match_type", kind).withColumn("matched_id", matched).drop(
        "leak_id", "near_id", "first"
    )


def zero_filled(counts: DataFrame, column: str, values: tuple[str, ...], count: str = "n") -> DataFrame:
    """Counts with a row for every value."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(counts, column, "left").na.fill({count: 0})


def top_counts(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def group_pair_counts(df: DataFrame, group: str, after: str) -> DataFrame:
    """Pairs in a group whose after differs, by counts: C(n, 2) less those of equal after."""
    inner = df.groupBy(group, after).agg(F.count(F.lit(1)).alias("m"))
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    return inner.groupBy(group).agg(F.sum("m").alias("n"), F.sum(pairs("m")).alias("same")).select(
        group, "n", (pairs("n") - F.col("same")).alias("pairs")
    )


def near_pairs(df: DataFrame, ident: str, key: str, threshold: int = 3, width: int = 64) -> DataFrame:
    """(left_id, right_id, distance) of distinct keys of ``width`` bits within a Hamming distance.

    Rows of equal keys are one row here (the smallest id stands for them; key_members says for
    which); pairs meet in the bands of :func:`_banded`.
    """
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ident).alias(ident))
    cut = _banded(one, key, threshold, width)
    left, right = cut.withColumnsRenamed({ident: "left_id", key: "lk"}), cut.withColumnsRenamed({ident: "right_id", key: "rk"})
    close = T.hamming(F.col("lk"), F.col("rk"))
    joined = left.join(right, ["b", "v"]).where((F.col("left_id") < F.col("right_id")) & (close <= threshold))
    return joined.select("left_id", "right_id", close.alias("distance")).distinct()


def near_before_pairs(
    df: DataFrame, ident: str, state: str, after: str, threshold: int = 3, budget: int = 100_000
) -> DataFrame:
    """One row: pairs of states within the threshold, pairs of rows that they stand for whose
    after differs, and whether the budget of state pairs cut the scan (scan_truncated).

    States are distinct keys; their pairs are taken in order of the two keys until the budget.
    The pairs of rows are counted by groups and never listed.
    """
    sizes = df.groupBy(state, after).agg(F.count(F.lit(1)).alias("m"))
    states = sizes.groupBy(state).agg(F.sum("m").alias("n"))
    numbered = states.select(F.col(state).alias("s"), F.col(state).alias("key"))
    pairs = near_pairs(numbered, "s", "key", threshold).select(
        F.col("left_id").alias("l"), F.col("right_id").alias("r")
    ).orderBy("l", "r").limit(budget + 1)
    total = pairs.count()
    kept = pairs.orderBy("l", "r").limit(budget)
    n = states.withColumnsRenamed({state: "s", "n": "n"})
    both = kept.join(
        n.select(F.col("s").alias("l"), F.col("n").alias("nl")), "l"
    ).join(n.select(F.col("s").alias("r"), F.col("n").alias("nr")), "r")
    left = kept.join(sizes.select(F.col(state).alias("l"), F.col(after).alias("a"), F.col("m").alias("ml")), "l")
    same = left.join(sizes.select(F.col(state).alias("r"), F.col(after).alias("a"), F.col("m").alias("mr")), ["r", "a"])
    counts = both.agg(
        F.count(F.lit(1)).alias("state_pairs"), F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0)).alias("all")
    )
    equal = same.agg(F.coalesce(F.sum(F.col("ml") * F.col("mr")), F.lit(0)).alias("same"))
    one = counts.crossJoin(equal)  # one row each
    return one.select(
        "state_pairs", (F.col("all") - F.col("same")).alias("row_pairs"), F.lit(total > budget).alias("scan_truncated")
    )


def key_members(df: DataFrame, ident: str, key: str) -> DataFrame:
    """Adds representative: the smallest id with the row's key, that near_pairs names for it.

    A row without a key stands for itself.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ident).alias("representative"))
    return df.join(first, key, "left").withColumn("representative", F.coalesce("representative", ident))


def license_report(df: DataFrame, decision: str = "decision", source: str = "source") -> DataFrame:
    """Counts of every licence, source and reason, included and excluded apart."""
    d = F.col(decision)
    long = df.select(
        d["allowed"].alias("included"),
        F.explode(
            F.array(
                F.struct(F.lit("license").alias("kind"), F.coalesce(d["license"], F.lit("missing")).alias("value")),
                F.struct(F.lit("source").alias("kind"), F.col(source).alias("value")),
                F.struct(F.lit("reason").alias("kind"), d["reason"].alias("value"))
            )
        ).alias("x")
    )
    return long.groupBy("included", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def enforce_license_gate(df: DataFrame, decision: str = "decision", policy: str = "full_text") -> None:
    """Raises if an included row isn't allowed or has another artifact policy."""
    d = F.col(decision)
    bad = df.where(~d["allowed"] | (d["artifact_policy"] != policy)).groupBy(d["reason"].alias("reason")).count().collect()
    if bad:
        raise ValueError("licence gate: " + ", ".join(f"{r['reason']}: {r['count']}" for r in sorted(bad)))


def split_leakage(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy(key).agg(
        F.array_sort(F.collect_set("split")).alias("splits")
    ).where(F.size("splits") > 1).select(key, F.array_join("splits", ",").alias("splits"))


def secret_findings(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per secret value: id, line number from 1, digest of the value."""
    lines = df.select(ident, F.posexplode(F.split(text, "\n")).alias("at", "line")).where(F.col("line").rlike(T.SECRET_VALUE))
    return lines.select(
        ident,
        (F.col("at") + 1).alias("line_no"),
        F.explode(F.regexp_extract_all("line", F.lit(T.SECRET_VALUE), 1)).alias("value")
    ).select(ident, "line_no", F.sha2("value", 256).alias("digest"))


def capped(df: DataFrame, key: str, order: list, cap: int) -> DataFrame:
    """At most cap rows of each key, in order."""
    return df.withColumn(
        "_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ).where(F.col("_n") <= cap).drop("_n")
