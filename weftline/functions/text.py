"""Text, hash and bucket functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licences that may be redistributed, other spellings, and words for none.
PERMISSIVE_LICENSES = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "isc", "mit", "unlicense")
LICENSE_ALIASES = {
    "apache-license-2.0": "apache-2.0",
    "apache-2": "apache-2.0",
    "cc0": "cc0-1.0",
    "mit-license": "mit",
    "the-unlicense": "unlicense"
}
NO_LICENSE = ("", "none", "null", "unknown", "other", "n/a")

# Token patterns (identifier, digits or any mark; word run or mark; identifier or digits).
CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|\S"
WORD_TOKEN = r"(?U)\w+|[^\w\s]"
NAME_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+"

# Patterns of secret values.
SECRET_VALUE = r"(?i)((?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9_]{12,}|xox[baprs]-[A-Za-z0-9-]{12,}|AKIA[0-9A-Z]{12,})"
# Names of fields that hold secrets, marks, and from where on a text is long.
SECRET_KEY = r"(?i)(token|api[_-]?key|password|passwd|credential|secret)"
SECRET_MARK = "[REDACTED_SECRET]"
LONGEST_LINES, LONGEST_CHARS = 20, 4000
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def normal_license(value: Column) -> Column:
    """Lower case, '_' and blanks as '-', known spellings; null where it names no licence."""
    text = F.regexp_replace(F.regexp_replace(F.lower(stripped(value)), "_", "-"), " +", "-")
    known = F.create_map(*[F.lit(x) for pair in LICENSE_ALIASES.items() for x in pair])
    name = F.coalesce(F.element_at(known, text), text)
    return F.when(~name.isin(*NO_LICENSE), name)


def license_decision(
    value: Column,
    allowed: tuple[str, ...] = PERMISSIVE_LICENSES,
    required: bool = True,
    redistribution: bool = True,
    policy: str = "full_text"
) -> Column:
    """struct(allowed, reason, license, artifact_policy) for a licence text."""
    name = normal_license(value)
    if not redistribution:
        return F.struct(
            F.lit(False).alias("allowed"),
            F.lit("redistribution_not_allowed").alias("reason"),
            name.alias("license"),
            F.lit("exclude").alias("artifact_policy")
        )
    listed = name.isin(*allowed)
    ok = F.when(name.isNull(), F.lit(not required)).otherwise(listed)
    missing = "missing_license" if required else "source_policy_allows_missing_license"
    reason = F.when(name.isNull(), missing).when(listed, "allowed").otherwise("license_not_allowed")
    return F.struct(
        ok.alias("allowed"),
        reason.alias("reason"),
        name.alias("license"),
        F.when(ok, policy).otherwise("exclude").alias("artifact_policy")
    )


def normal_repo(value: Column) -> Column:
    return F.lower(stripped(value))


def normal_path(value: Column) -> Column:
    """Slashes forward, leading './' gone however often."""
    return F.regexp_replace(F.regexp_replace(value, r"\\", "/"), r"^(\./)+", "")


def normal_code(value: Column) -> Column:
    """Line ends as \\n, no white space at the ends of lines or of the text."""
    return stripped(F.regexp_replace(F.regexp_replace(value, "\r\n?", "\n"), r"(?U)[^\S\n]+(?=\n|\z)", ""))


def normal_action(value: Column) -> Column:
    return F.lower(F.regexp_replace(stripped(value), r"(?U)\s+", " "))


def parts_hash(*parts: Column) -> Column:
    """sha256 over the parts, each with a NUL after it."""
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\0"))]), 256)


def unit_interval(value: Column, digits: int = 13) -> Column:
    """[0, 1) from the first hex digits of sha256.

    13 digits (52 bits) are exact in a double; 16 follow the 64-bit definition, rounded.
    """
    head = F.conv(F.substring(F.sha2(value, 256), 1, digits), 16, 10).cast("decimal(20,0)").cast("double")
    return head / float(16**digits)


def split_name(key: Column, seed: str = "0", train: float = 0.8, val: float = 0.1, digits: int = 13) -> Column:
    u = unit_interval(F.concat(F.lit(f"{seed}:"), key), digits)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def tokens(text: Column, pattern: str = CODE_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def edit_size_bucket(n: Column) -> Column:
    return F.when(n <= 2, "xs:0-2").when(n <= 10, "s:3-10").when(n <= 50, "m:11-50").when(
        n <= 150, "l:51-150"
    ).otherwise("xl:151+")


def token_count_bucket(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n <= 4, "xs:1-4").when(n <= 16, "s:5-16").when(n <= 64, "m:17-64").when(
        n <= 256, "l:65-256"
    ).otherwise("xl:257+")


def fold_to_vocabulary(token: Column, size: int) -> Column:
    """0 stays the padding id; other ids fold into 1 .. size - 1."""
    return F.when(token <= 0, F.lit(0).cast("long")).otherwise(F.pmod(token - 1, F.lit(size - 1)) + 1)




def padded(ids: Column, width: int) -> Column:
    """First ``width`` ids, zeros after them."""
    cut = F.slice(ids, 1, width)
    return F.concat(cut, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(cut)))


def checked_width(ids: Column, width: int) -> Column:
    """Padded ids; a longer sequence is an error, never cut."""
    return F.when(F.size(ids) <= width, padded(ids, width)).otherwise(
        F.raise_error(F.concat(F.lit("sequence is longer than "), F.lit(str(width))))
    )


def redacted(text: Column) -> Column:
    """Home folders as ~ and secret values as a mark; a long text becomes a digest of what is left."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(/home|/Users)/[^/\s]+", "~"), SECRET_VALUE, F.lit(SECRET_MARK))
    parts = F.size(F.split(clean, LINE_END))
    lines = parts - F.when(clean.rlike(f"({LINE_END})\\z"), 1).otherwise(0)  # a last line end ends no further line
    digest = F.concat(
        F.lit("[REDACTED_LONG_TEXT sha256="),
        F.substring(F.sha2(clean, 256), 1, 16),
        F.lit(" lines="),
        lines,
        F.lit(" chars="),
        F.length(clean),
        F.lit("]")
    )
    return F.when((lines > LONGEST_LINES) | (F.length(clean) > LONGEST_CHARS), digest).otherwise(clean)


def redacted_fields(fields: Column) -> Column:
    """A map of texts, redacted; what a secret's name leads to is a mark whatever it holds."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SECRET_KEY), SECRET_MARK).otherwise(redacted(v)))


def redacted_path(path: Column) -> Column:
    """Absolute, home and drive paths as a kind and a digest; others as they are."""
    kind = F.when(path.rlike(r"^~"), "home").when(path.rlike(r"^[A-Za-z]:[\\/]"), "drive").when(path.rlike(r"^/"), "absolute")
    return F.when(kind.isNull(), path).otherwise(
        F.concat(F.lit("<redacted:"), kind, F.lit(":sha256="), F.sha2(path, 256), F.lit(">"))
    )


def module_name(path: Column) -> Column:
    """Dotted module of a .py path; a package for __init__.py."""
    stem = F.regexp_replace(normal_path(path), r"\.py$", "")
    return F.array_join(F.filter(F.split(stem, "/"), lambda x: (x != "") & (x != "__init__")), ".")


def hash_order(*parts: Column, seed: str = "0") -> Column:
    """A deterministic order that stands in for a seeded shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def probability(score: Column) -> Column:
    """The score inside [0, 1], else its logistic."""
    return F.when((score >= 0) & (score <= 1), score).when(
        score >= 0, 1 / (1 + F.exp(-score))
    ).otherwise(F.exp(score) / (1 + F.exp(score)))


# The verdicts of a judge.
VERDICTS = ("accepted", "wrong_answer", "runtime_error", "time_limit_exceeded", "memory_limit_exceeded", "compile_error")


def verdict(value: Column) -> Column:
    """A judge's verdict, blanks as underscores; unknown for any other."""
    name = F.replace(F.lower(stripped(value)), F.lit(" "), F.lit("_"))
    return F.when(name.isin(*VERDICTS), name).otherwise("unknown")


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def lexical_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term counts of two token arrays; 0 if one is empty."""

    def of(x: Column) -> Column:
        times = lambda tokens, t: F.size(F.filter(tokens, lambda y: y == t)).cast("double")
        square = lambda tokens: F.aggregate(
            F.array_distinct(tokens), F.lit(0.0), lambda s, t: s + times(tokens, t) * times(tokens, t)
        )
        dot = F.aggregate(F.array_intersect(x["a"], x["b"]), F.lit(0.0), lambda s, t: s + times(x["a"], t) * times(x["b"], t))
        norm = F.sqrt(square(x["a"])) * F.sqrt(square(x["b"]))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(dot / F.greatest(norm, F.lit(1e-12)))

    return bound(F.struct(a.alias("a"), b.alias("b")), of)


def hashed_vector(tokens_: Column, width: int) -> Column:
    """Unit vector of signed token counts: place and sign of a token come from its sha256."""

    def signed(token: Column) -> Column:
        number = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
        pair = lambda h: F.struct(
            F.pmod(number(h, 1, 8), F.lit(width)).alias("p"), F.when(number(h, 9, 2) % 2 == 0, 1.0).otherwise(-1.0).alias("s")
        )
        return bound(F.sha2(token, 256), pair)

    def counted(pairs: Column) -> Column:
        at = lambda i: F.aggregate(pairs, F.lit(0.0), lambda total, x: total + F.when(x["p"] == i, x["s"]).otherwise(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at)

    def unit(raw: Column) -> Column:
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda total, x: total + x * x))
        return bound(
            F.struct(raw.alias("v"), norm.alias("n")),
            lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, x).otherwise(x / s["n"]))
        )

    return bound(bound(F.transform(tokens_, signed), counted), unit)


def int_sequence_hash(ids: Column) -> Column:
    """sha256 of the active (non-zero) ids, joined by NUL."""
    active = F.transform(F.filter(ids, lambda x: x != 0), lambda x: x.cast("string"))
    return F.sha2(F.array_join(active, "\0"), 256)


def action_signature(ids: Column) -> Column:
    return F.concat(F.lit("act-"), F.substring(int_sequence_hash(ids), 1, 16))


def ids_text(ids: Column) -> Column:
    """The active ids as text: what lexical baselines compare."""
    return F.array_join(F.transform(F.filter(ids, lambda x: x != 0), lambda x: x.cast("string")), " ")


def record_id(source: Column, repo: Column, commit: Column, path: Column) -> Column:
    """The id of an edit record."""
    return F.concat_ws(":", source, repo, commit, path)


def safe_patch(patch: Column) -> Column:
    """True if no file header of a patch names an absolute path or a parent folder."""
    paths = F.regexp_extract_all(patch, F.lit(r"(?m)^(?:---|\+\+\+) (\S+)"), 1)
    bad = F.exists(paths, lambda p: p.rlike(r"^/(?!dev/null$)") | p.rlike(r"^[A-Za-z]:[\\/]") | p.rlike(r"(^|/)\.\.(/|$)"))
    return ~F.coalesce(bad, F.lit(False))
