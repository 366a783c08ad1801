"""States of edited Python files: the edited symbol, its surroundings, normal forms, rewrites.

Sources are parsed, never run. What doesn't parse gives null or no rows.
"""

from __future__ import annotations

import ast
import hashlib
import random
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes of a small file and of a region, and what literals are cut to.
SMALL_FILE_LINES, REGION_CONTEXT = 40, 8
# Why a state has no symbol, by kind and by whether lines changed.
FALLBACKS = {
    ("small_file", True): "small_file_no_symbol_overlap",
    ("small_file", False): "small_file_no_changed_lines",
    ("region", True): "changed_region_no_symbol_overlap",
    ("region", False): "region_no_changed_lines",
}
LONG_STRING, LONG_NUMBER = 96, 12
STRING_MARK, NUMBER_MARK = "<STR_LITERAL>", "__NUM_LITERAL__"
WORD = re.compile(r"\w+|[^\w\s]")

STATE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("enclosing_class", T.StringType()),
    T.StructField("imports", T.StringType()),
    T.StructField("siblings", T.ArrayType(T.StringType())),
    T.StructField("callees", T.ArrayType(T.StringType())),
    T.StructField("primary", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("changed", T.ArrayType(T.BooleanType())),
    T.StructField("fallback", T.StringType()),
])
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _signature(node: ast.AST) -> str | None:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(map(ast.unparse, node.bases))
        return f"class {node.name}({bases})" if bases else f"class {node.name}"
    if isinstance(node, DEFS):
        return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})"
    return None


def _called(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_called(node.value)}.{node.attr}".lstrip(".")
    return getattr(node, "id", "") if isinstance(node, ast.Name) else ""


#: What definitions can stand in; expressions hold none.
HOLDERS = (ast.Module, ast.stmt, ast.excepthandler, ast.match_case)


def nodes(node: ast.AST):
    """A node and all below it, in no stated order; contexts and operators are left out."""
    waiting = [node]
    for one in waiting:
        yield one
        for field in one._fields:
            value = getattr(one, field, None)
            if type(value) is list:
                waiting += [x for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST) and value._fields:
                waiting.append(value)


def _symbols(node: ast.AST, owner: str | None = None):
    """(node, parent, enclosing class) of all definitions below a node."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, DEFS):
            yield child, node, owner
        if isinstance(child, HOLDERS) and ("body" in child._fields or "cases" in child._fields):
            yield from _symbols(child, child.name if isinstance(child, ast.ClassDef) else owner)


def _state(text: str, changed: set[int]) -> tuple | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = text.splitlines()
    imports = "\n".join(
        ast.get_source_segment(text, n) or ast.unparse(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))
    )
    ranked = []
    for node, parent, owner in _symbols(tree):
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        overlap = sum(start <= n <= node.end_lineno for n in changed)
        if overlap:
            ranked.append((-overlap, node.end_lineno - start, start, len(ranked), node, parent, owner))
    if ranked:
        _, _, start, _, node, parent, owner = min(ranked, key=lambda x: x[:4])
        end, method = node.end_lineno, owner is not None and not isinstance(node, ast.ClassDef)
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if method else "function"
        symbol, around, inside = f"{owner}.{node.name}" if method else node.name, [
            x for x in getattr(parent, "body", []) if x is not node
        ], node
        fallback = None
    else:
        symbol, owner, around, inside, start, end = None, None, tree.body, tree, 1, max(len(lines), 1)
        kind = "small_file" if len(lines) <= SMALL_FILE_LINES else "region"
        if kind == "region":
            low, high = (min(changed), max(changed)) if changed else (1, REGION_CONTEXT)
            start, end = max(1, low - REGION_CONTEXT), min(len(lines), high + REGION_CONTEXT)
        fallback = FALLBACKS[kind, bool(changed)]
    siblings = [x for x in map(_signature, around) if x]
    callees = sorted({c for n in nodes(inside) if isinstance(n, ast.Call) and (c := _called(n.func))})
    primary = "\n".join(lines[start - 1 : end]).rstrip() + "\n" * bool(text)
    mask = [n in changed for n in range(start, end + 1)]
    return symbol, kind, owner, imports, siblings, callees, primary, start, mask, fallback


@F.pandas_udf(STATE)
def code_state(text: pd.Series, changed: pd.Series) -> pd.DataFrame:
    """The symbol that most changed lines fall into (then the smallest, then the first) and its context.

    Without one: the whole of a small file, or the region around the changed lines, and in
    ``fallback`` why.
    """
    empty = (None,) * len(STATE.names)
    rows = [
        _state(t, {int(n) for n in (() if c is None else c)}) or empty if t is not None else empty for t,
        c in zip(text, changed, strict=True)
    ]
    frame = pd.DataFrame(rows, columns=STATE.names)
    return frame.astype({"start_line": "Int32"})


def _has_docstring(node: ast.AST) -> bool:
    body = getattr(node, "body", None)
    return isinstance(node, (ast.Module, *DEFS)) and bool(body) and isinstance(body[0], ast.Expr) and isinstance(
        getattr(body[0].value, "value", None), str
    )


def _mark(node: ast.Constant) -> ast.AST:
    """What stands for a literal: a mark for a long one, else itself."""
    if isinstance(node.value, str) and len(node.value) > LONG_STRING:
        return ast.Constant(STRING_MARK)
    if isinstance(node.value, (int, float, complex)) and sum(c.isdigit() for c in str(node.value)) > LONG_NUMBER:
        return ast.Name(NUMBER_MARK, ast.Load())
    return node


def is_normal(tree: ast.AST) -> bool:
    """Whether _Normal would leave a tree as it is."""
    for n in nodes(tree):
        if isinstance(n, ast.Constant):
            if _mark(n) is not n:
                return False
        elif "body" in n._fields and _has_docstring(n):
            return False
    return True


class _Normal(ast.NodeTransformer):
    """Long literals become marks, docstrings go."""

    def visit(self, node: ast.AST) -> ast.AST:
        if _has_docstring(node):
            node.body = node.body[1:] or [ast.copy_location(ast.Pass(), node.body[0])]
        if isinstance(node, ast.Constant) and (mark := _mark(node)) is not node:
            return mark
        return self.generic_visit(node)


@F.pandas_udf(T.StringType())
def normal_source(text: pd.Series) -> pd.Series:
    """One spelling of a source: formatted anew, long literals marked, docstrings gone; else null."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else ast.unparse(_Normal().visit(ast.parse(x)))
        except (SyntaxError, ValueError, RecursionError):
            return None

    return pd.Series([one(x) for x in text], dtype=object)


def _nested(node: ast.AST) -> bool:
    return any(isinstance(n, (*DEFS, ast.Lambda)) for n in ast.walk(node) if n is not node)


def _functions(tree: ast.AST):
    return [n for n in ast.walk(tree) if isinstance(n, DEFS[:2]) and not _nested(n)]


def _renamed(tree: ast.AST) -> bool:
    for f in _functions(tree):
        names = {n.arg for n in ast.walk(f) if isinstance(n, ast.arg)} | {n.id for n in ast.walk(f) if isinstance(n, ast.Name)}
        if "value" in {a.arg for a in (*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs)} and "result" not in names:
            for n in ast.walk(f):
                for field in ("arg", "id"):
                    if isinstance(n, (ast.arg, ast.Name)) and getattr(n, field, None) == "value":
                        setattr(n, field, "result")
            return True
    return False


def _returned(tree: ast.AST) -> bool:
    bare = [f for f in _functions(tree) if not any(isinstance(n, ast.Return) for n in ast.walk(f))]
    for f in bare[:1]:
        f.body.append(ast.Return(ast.Constant(None)))
    return bool(bare)


def _set_literal(tree: ast.AST) -> bool:
    for parent in ast.walk(tree):
        for field, value in ast.iter_fields(parent):
            for i, node in enumerate(value if isinstance(value, list) else [value]):
                if isinstance(node, ast.Call) and getattr(
                    node.func, "id", None
                ) == "set" and len(node.args) == 1 and not node.keywords:
                    items = getattr(node.args[0], "elts", []) if isinstance(node.args[0], (ast.List, ast.Tuple)) else []
                    if items and all(isinstance(x, ast.Constant) for x in items):
                        new = ast.Set(items)
                        if isinstance(value, list):
                            value[i] = new
                        else:
                            setattr(parent, field, new)
                        return True
    return False


# Names and instructions of the rewrites.
REWRITES = (
    ("rename-value-arg-to-result", "Rename the local value parameter to result.", _renamed),
    ("add-explicit-return-none", "Add an explicit return None to a function with implicit None return.", _returned),
    ("modernize-set-literal", "Replace set([...]) with a set literal.", _set_literal),
)
REWRITTEN = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("transform_id", "message", "after")]))


#: Rewrites that callers have added: (name, instruction, change of a tree in place that says if it did any).
_added: list[tuple[str, str, object]] = []


def register_rewrite(name: str, message: str, change) -> None:
    """A further rewrite, for all functions that are made from now on.

    The change is sent to the workers, so it is local or from a module that they can import.
    """
    if any(name == known for known, _, _ in (*REWRITES, *_added)):
        raise ValueError(f"there is a rewrite {name!r} already")
    _added.append((name, message, change))


def known_rewrites() -> tuple[tuple[str, str, object], ...]:
    return (*REWRITES, *_added)


def rewritten(text: str | None, changes: tuple[tuple[str, str, object], ...] = REWRITES) -> list[tuple[str, str, str]]:
    """(name, instruction, new text) of every rewrite that changes a source; none if it doesn't parse."""
    found = []
    for name, message, change in changes:
        try:
            tree = ast.parse(text or "")
            if change(tree):
                found.append((name, message, ast.unparse(ast.fix_missing_locations(tree)) + "\n"))
        except (SyntaxError, ValueError, RecursionError):
            break
    return found


def rewrites(text):
    """Every rewrite that changes a source: at most one struct for each known rewrite."""
    changes = known_rewrites()

    @F.pandas_udf(REWRITTEN)
    def all_rewrites(texts: pd.Series) -> pd.Series:
        return pd.Series([rewritten(x, changes) for x in texts])

    return all_rewrites(text)


def synthetic_edits(files: DataFrame) -> DataFrame:
    """Edit records of rewritten files: repo, path, text, license come in; one row per rewrite."""
    digest = F.sha2("text", 256)
    each = files.withColumn("x", F.explode(rewrites("text")))
    return each.select(
        F.lit("synthetic").alias("source"), "repo", F.concat(
            F.lit("synthetic:"), F.substring(digest, 1, 12), F.lit(":"), F.col("x.transform_id")
        ).alias("commit"),
        F.col("path").alias("path_before"), F.col("path").alias("path_after"), F.col("text").alias("before"), F.col("x.after").alias("after"), F.col("x.message").alias("message"), "license",
    )


# What takes an identifier's place in a text decoy, and what marks a text without one.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
SUBSTITUTES = ("value", "result", "tmp", "delta", "counter", "result_v2")
NO_IDENTIFIER = " # mutation"


def _substituted(text: str, draw: random.Random) -> str:
    found = list(IDENTIFIER.finditer(text))
    if not found:
        return text + NO_IDENTIFIER
    one = draw.choice(found)
    other = draw.choice(SUBSTITUTES)
    while other == one.group():
        other = draw.choice(SUBSTITUTES)
    return f"{text[:one.start()]}{other}{text[one.end():]}"


def text_decoys(count: int = 1, seed: int = 0):
    """Column function of (id, text): up to count texts with one identifier in another's place.

    Draws are those of a generator seeded by seed, id and category, one after the other.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("text", T.StringType())])))
    def decoys(ident: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for i, t in zip(ident, text, strict=True):
            draw = random.Random(int.from_bytes(hashlib.sha256(f"{seed}|{i}|mutation".encode()).digest()[:8], "big"))
            made = [] if t is None else [(k, _substituted(t, draw)) for k in range(count)]
            out.append([(k, m) for k, m in made if m != t])
        return pd.Series(out, dtype=object)

    return decoys
