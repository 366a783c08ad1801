"""Python source as data: parsed, never run. Arrow functions, stateless and row by row."""

from __future__ import annotations

import ast
import difflib
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = T.StructType(
    [T.StructField("ok", T.BooleanType()), T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())]
)
EDIT = T.StructType([T.StructField("changed_lines", T.IntegerType()), T.StructField("ratio", T.DoubleType())])

MUTANT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("description", T.StringType())
    ]
)

# What each operator may turn into, by family, in order.
COMPARE = {
    ast.Lt: (ast.LtE, ast.Gt, ast.GtE),
    ast.LtE: (ast.Lt, ast.Gt, ast.GtE),
    ast.Gt: (ast.GtE, ast.Lt, ast.LtE),
    ast.GtE: (ast.Gt, ast.Lt, ast.LtE),
    ast.Eq: (ast.NotEq,),
    ast.NotEq: (ast.Eq,),
    ast.Is: (ast.IsNot,),
    ast.IsNot: (ast.Is,),
}
BINARY = {
    ast.Add: (ast.Sub,),
    ast.Sub: (ast.Add,),
    ast.Mult: (ast.FloorDiv, ast.Add),
    ast.Div: (ast.Mult,),
    ast.FloorDiv: (ast.Mult,),
    ast.Mod: (ast.FloorDiv,),
}
BOOLEAN = {ast.And: (ast.Or,), ast.Or: (ast.And,)}
AUGMENTED = {ast.Add: (ast.Sub,), ast.Sub: (ast.Add,), ast.Mult: (ast.FloorDiv,)}
CONSTANT_DELTAS = (1, -1)


@F.pandas_udf(PARSED)
def parsed(code: pd.Series) -> pd.DataFrame:
    """ok, and for what doesn't parse the line and the message; null is not ok."""
    rows = []
    for text in code:
        try:
            if text is None:
                raise ValueError("no source")
            ast.parse(text)
            rows.append((True, None, None))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            rows.append((False, getattr(e, "lineno", None), str(getattr(e, "msg", e))))
    return pd.DataFrame(
        {"ok": [r[0] for r in rows], "line": pd.array([r[1] for r in rows], "Int32"), "message": [r[2] for r in rows]}
    )


@F.pandas_udf(EDIT)
def edit_measure(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Changed lines (both sides) and 1 - similarity of the characters; quadratic, so filter first."""
    rows = []
    for a, b in zip(before.fillna(""), after.fillna(""), strict=True):
        ops = difflib.SequenceMatcher(None, a.splitlines(), b.splitlines()).get_opcodes()
        changed = sum((i2 - i1) + (j2 - j1) for tag, i1, i2, j1, j2 in ops if tag != "equal")
        rows.append((changed, 1 - difflib.SequenceMatcher(None, a, b).ratio()))
    return pd.DataFrame(rows, columns=["changed_lines", "ratio"]).astype({"changed_lines": "int32"})


def _depth(n: int) -> str:
    """How deep a node lies, in four steps."""
    return "1" if n <= 2 else "2" if n <= 4 else "4" if n <= 8 else "8PLUS"


def _shape(node: ast.AST | None) -> str:
    if isinstance(node, ast.Call):
        return "CallWithKeyword" if node.keywords else "Call"
    if isinstance(node, ast.Constant):
        return "ConstantStr" if isinstance(node.value, str) else "ConstantNum" if isinstance(
            node.value, (int, float, complex)
        ) else "Constant"
    return "None" if node is None else type(node).__name__


def _by_path(text: str) -> dict[tuple[str, ...], tuple[ast.AST, str]]:
    """(node, scope) of every node by its path: fields, places in lists and types from the module on."""
    found, waiting = {}, [(ast.parse(text), ("Module",), "module")]
    while waiting:
        node, path, scope = waiting.pop()
        scope = "function" if isinstance(
            node, (ast.FunctionDef, ast.AsyncFunctionDef)
        ) else "class" if isinstance(node, ast.ClassDef) else scope
        found[path] = (node, scope)
        for field, value in ast.iter_fields(node):
            items = [(str(i), x) for i, x in enumerate(value)] if isinstance(value, list) else [("", value)]
            waiting += [
                (x, (*path, field, *([i] if i else []), type(x).__name__), scope) for i, x in items if isinstance(x, ast.AST)
            ]
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def abstract_edits(before: pd.Series, after: pd.Series, size: pd.Series, limit: pd.Series) -> pd.Series:
    """Up to limit INSERT, DELETE, RENAME and UPDATE tokens of nodes at the same path, by path.

    size is the bucket of changed lines that every token names; what doesn't parse gives none.
    """
    name = lambda n: getattr(n, "id", getattr(n, "arg", None)) if isinstance(n, (ast.Name, ast.arg)) else None
    out = []
    for a, b, bucket, most in zip(before.fillna(""), after.fillna(""), size, limit, strict=True):
        try:
            x, y = _by_path(a), _by_path(b)
        except (SyntaxError, ValueError, RecursionError):
            out.append([])
            continue
        found: list[str] = []
        for path in sorted(x.keys() | y.keys()):
            (old, _), (new, _) = x.get(path, (None, "")), y.get(path, (None, ""))
            node, scope = y[path] if new is not None else x[path]
            if old is None or new is None:
                verb = "INSERT" if old is None else "DELETE"
            elif name(old) is not None and name(new) is not None and name(old) != name(new):
                verb = "RENAME"
            elif ast.dump(old) != ast.dump(new):
                verb = "UPDATE"
            else:
                continue
            found.append(
                (
                    f"OP_{verb} NODE_{type(node).__name__} PATH_DEPTH_{_depth(len(path))} OLD_{_shape(old)} NEW_{_shape(new)} SCOPE_{scope} "
                    f"SIZE_{bucket}"
                )
            )
            if len(found) >= most:
                break
        out.append(found)
    return pd.Series(out)


def _places(parent: ast.AST):
    """(container, key, node) of every child, children before their parents, in field order."""
    for field, value in ast.iter_fields(parent):
        pairs = enumerate(value) if isinstance(value, list) else [(field, value)]
        holder = value if isinstance(value, list) else vars(parent)
        for key, node in pairs:
            if isinstance(node, ast.AST):
                yield from _places(node)
                yield holder, key, node


def _points(tree: ast.AST):
    """(operator, description, container, key, replacement) of every single change."""
    swap = lambda name, node, table: [
        (
            name, f"{'aug ' * (name == 'augassign')}{type(node.op).__name__}->{new.__name__}", vars(node), "op", new()
        ) for new in table.get(type(node.op), ())
    ]
    for holder, key, node in _places(tree):
        if isinstance(node, ast.Compare):
            for i, op in enumerate(node.ops):
                yield from (
                    ("compare", f"{type(op).__name__}->{new.__name__}", node.ops, i, new()) for new in COMPARE.get(type(op), ())
                )
        elif isinstance(node, ast.BinOp):
            yield from swap("binop", node, BINARY)
        elif isinstance(node, ast.BoolOp):
            yield from swap("boolop", node, BOOLEAN)
        elif isinstance(node, ast.AugAssign):
            yield from swap("augassign", node, AUGMENTED)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            yield "not", "remove `not`", holder, key, node.operand
        elif isinstance(node, ast.Constant) and type(node.value) in (int, float):
            yield from (
                ("const", f"const {node.value!r}{d:+d}", holder, key, ast.Constant(node.value + d)) for d in CONSTANT_DELTAS
            )


def _mutants(text: str | None) -> list[tuple[str, str, str]]:
    """All distinct sources with one change; none where the text doesn't parse."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    seen, out = {ast.unparse(tree)}, []
    for operator, description, holder, key, new in list(_points(tree)):
        old, holder[key] = holder[key], new
        source = ast.unparse(tree)
        holder[key] = old
        if source not in seen:
            seen.add(source)
            out.append((source, operator, description))
    return out


@F.pandas_udf(T.ArrayType(MUTANT))
def mutants(code: pd.Series) -> pd.Series:
    """struct(source, operator, description) of all sources that differ in one point."""
    return pd.Series([_mutants(x) for x in code])


@F.pandas_udf(T.ArrayType(MUTANT))
def sampled_mutants(code: pd.Series, count: pd.Series, seed: pd.Series) -> pd.Series:
    """At most count of a source's mutants, chosen with a seed, in source order."""
    import random

    out = []
    for text, n, own in zip(code, count, seed, strict=True):
        pool = _mutants(text) if n > 0 else []
        out.append(
            pool if len(pool) <= n else [pool[i] for i in sorted(random.Random(int(own)).sample(range(len(pool)), int(n)))]
        )
    return pd.Series(out)


class _Digests(dict):
    """8 bytes of blake2b of each case-folded token, hashed when first asked for."""

    def __missing__(self, token: str) -> bytes:
        self[token] = digest = hashlib.blake2b(token.casefold().encode(), digest_size=8).digest()
        return digest


def _simhash(tokens: list[str], digests: _Digests, step: int = 65_536) -> int:
    """The signed key of some tokens; their bits are laid out for a bounded number of tokens at a time."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(tokens), step):
        some = np.frombuffer(b"".join(map(digests.__getitem__, tokens[at : at + step])), np.uint8)
        ones += np.unpackbits(some).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(tokens)).tobytes(), "big", signed=True) if tokens else 0


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    """64-bit simhash of the code tokens (8-byte blake2b each, ties set the bit), as a signed long."""
    import re

    from .text import CODE_TOKEN

    cut, digests = re.compile(CODE_TOKEN).findall, _Digests()
    return pd.Series([_simhash(cut(x), digests) for x in text.fillna("")], dtype="int64")
