"""Line diffs, patches and hashes that need Python: Arrow functions, row by row."""

from __future__ import annotations

import difflib
import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("replaced", "deleted", "inserted", "changed_lines")])
LINES = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("before", "after")])
APPLIED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def _changes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    return [x for x in difflib.SequenceMatcher(None, a.splitlines(), b.splitlines()).get_opcodes() if x[0] != "equal"]


@F.pandas_udf(SHAPE)
def diff_shape(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """How often lines are replaced, deleted and inserted, and the changed lines of both sides."""
    rows = []
    for a, b in zip(before.fillna(""), after.fillna(""), strict=True):
        ops = _changes(a, b)
        kinds = [sum(x[0] == k for x in ops) for k in ("replace", "delete", "insert")]
        rows.append((*kinds, sum(x[2] - x[1] + x[4] - x[3] for x in ops)))
    return pd.DataFrame(rows, columns=SHAPE.names).astype("int32")


def size_bucket(n):
    return F.when(n <= 2, "xs").when(n <= 10, "s").when(n <= 50, "m").when(n <= 150, "l").otherwise("xl")


def diff_shape_hash(shape):
    """sha256 over the counts and the size bucket of a diff's shape."""
    size = size_bucket(shape["changed_lines"])
    text = F.concat(
        F.lit("r="), shape["replaced"], F.lit(";d="), shape["deleted"], F.lit(";i="), shape["inserted"], F.lit(";bucket="), size
    )
    return F.sha2(F.concat(text, F.lit("\0")), 256)


@F.pandas_udf(LINES)
def changed_lines(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Numbers (from 1) of the changed lines of either side."""
    rows = []
    for a, b in zip(before.fillna(""), after.fillna(""), strict=True):
        ops = _changes(a, b)
        rows.append(([i + 1 for x in ops for i in range(x[1], x[2])], [i + 1 for x in ops for i in range(x[3], x[4])]))
    return pd.DataFrame(rows, columns=LINES.names)


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
    """The patch from before to after; empty for equal texts."""
    make = lambda a, b, p: "".join(
        difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), f"a/{p}", f"b/{p}")
    )
    return pd.Series([make(a, b, p) for a, b, p in zip(before.fillna(""), after.fillna(""), path, strict=True)])


def _applied(source: str, patch: str) -> str:
    lines, out, at, seen = source.splitlines(keepends=True), [], 0, False
    due = 0  # lines of the source that the open hunk still has to name
    for line in patch.splitlines(keepends=True):
        if line.startswith("@@"):
            head = HUNK.match(line)
            start = int(head[1]) - (head[2] != "0") if head else -1
            if due or not at <= start <= len(lines):
                raise ValueError("hunk doesn't fit the source")
            out += lines[at:start]
            at, due, seen = start, int(head[2] or 1), True
        elif seen and line[0] in " -":
            if due == 0 or at >= len(lines) or lines[at] != line[1:]:
                raise ValueError("context doesn't match the source")
            out += [line[1:]] if line[0] == " " else []
            at, due = at + 1, due - 1
        elif seen and line[0] == "+":
            out.append(line[1:])
        elif seen and line[0] != "\\":
            raise ValueError("not a line of a patch")
    if not seen or due:
        raise ValueError("patch has no whole hunk")
    return "".join(out + lines[at:])


@F.pandas_udf(APPLIED)
def apply_patch(source: pd.Series, patch: pd.Series) -> pd.DataFrame:
    """The patched text, or why the patch doesn't apply; contexts must match exactly."""
    rows = []
    for a, p in zip(source.fillna(""), patch.fillna(""), strict=True):
        try:
            rows.append((_applied(a, p), None))
        except ValueError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=APPLIED.names)


@F.pandas_udf(T.LongType())
def token_id(token: pd.Series) -> pd.Series:
    """A stable id: the first four bytes of blake2b, 31 bits."""
    return pd.Series(
        [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "big") & 0x7FFFFFFF for x in token.fillna("")],
        dtype="int64"
    )


@F.pandas_udf(T.StringType())
def casefolded(text: pd.Series) -> pd.Series:
    """Unicode case folding, which differs from lower case for sharp s and others."""
    return text.str.casefold()


def folded_action(value):
    """An action's text: case folded, runs of white space as one blank."""
    from .text import stripped

    return casefolded(F.regexp_replace(stripped(value), r"(?U)\s+", " "))
