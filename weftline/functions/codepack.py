"""Code states as packed text within a token budget, with segments and masks for each token.

A state (see ``pystate``) becomes one text of six sections. Where that is too long, context goes
first and then lines of the edited symbol, but never a changed line, its surroundings or what
gives the symbol its shape; a state that doesn't fit even so is an error, not a cut text.
"""

from __future__ import annotations

import ast
import hashlib
import textwrap
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pystate import WORD, _Normal, is_normal

# The budget and the context of a changed line, the sections' numbers and heads, the
# names of what is dropped, and what a line of a symbol that has to stay begins with.
TOKEN_BUDGET, CONTEXT_LINES = 1024, 2
PATH, IMPORTS, CLASS, SIBLINGS, CALLEES, PRIMARY = 1, 2, 3, 4, 5, 6
DROPPED = ("sibling_signatures", "callee_signatures", "imports", "primary_context")
SHAPE_LINES = ("@", "def ", "async def ", "class ")
FLOW_LINES = ("return", "raise", "except", "try:", "finally:", "with ")

PACK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("dropped", T.ArrayType(T.StringType())),
    T.StructField("primary_lines", T.IntegerType()),
    T.StructField("line_mask", T.ArrayType(T.BooleanType())),
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("segments", T.ArrayType(T.IntegerType())),
    T.StructField("changed", T.ArrayType(T.BooleanType())),
    T.StructField("error", T.StringType()),
])


@lru_cache(65_536)
def stable_id(token: str) -> int:
    """31 bits of a token's blake2b, the same everywhere."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "big") & 0x7FFFFFFF


@F.pandas_udf(T.ArrayType(T.LongType()))
def token_ids(tokens: pd.Series) -> pd.Series:
    """Stable ids of an array of tokens; each token is hashed once."""
    return pd.Series([None if x is None else [stable_id(t) for t in x] for x in tokens], dtype=object)


def _line(text: str) -> str:
    return " ".join(text.split())


def _block(text: str) -> list[str]:
    return [_line(x) for x in textwrap.dedent(text or "").splitlines() if x.strip()]


def _statements(old: ast.AST, new: ast.AST) -> Iterator[tuple[ast.AST, ast.AST]]:
    """Statements and handlers of two trees of one shape, in the order of their lines."""
    for field in ("body", "cases", "handlers", "orelse", "finalbody"):
        before, after = getattr(old, field, None), getattr(new, field, None)
        if isinstance(before, list) and isinstance(after, list):
            for a, b in zip(before, after, strict=False):
                if hasattr(b, "lineno"):
                    yield a, b
                yield from _statements(a, b)


def _spans(nodes: list[ast.AST]) -> list[tuple[int, int]]:
    """The lines that each of some statements has for itself: of one with a body, those of its head."""
    spans = []
    for n in nodes:
        low, high = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", ()))]), n.end_lineno
        if hasattr(n, "body"):
            heads = [x for x in ast.iter_child_nodes(n) if not isinstance(x, (ast.stmt, ast.excepthandler, ast.match_case))]
            high = max([n.lineno, *(x.end_lineno for h in heads for x in ast.walk(h) if hasattr(x, "end_lineno"))])
        spans.append((low, high))
    return spans


def _carried(tree: ast.AST, text: str, changed: list[bool], same: bool = False) -> list[bool]:
    """The mask of a formatted text's lines from that of the source that the tree was read from.

    same: formatting left the text as it was, so the tree is its own too.

    A line of a statement is changed if a line of the same statement was; lines between two
    statements (comments, blanks, a docstring) count for the one after them, those at the end for
    the last.
    """
    pairs = list(_statements(tree, tree if same else ast.parse(text)))
    mask, done = [False] * len(text.splitlines()), 0
    old = _spans([a for a, _ in pairs])
    new = old if same else _spans([b for _, b in pairs])
    for i, ((low, high), (to, upto)) in enumerate(zip(old, new, strict=True)):
        low, high = min(low, done + 1), len(changed) if i + 1 == len(pairs) else high
        if any(changed[low - 1 : high]):
            mask[to - 1 : upto] = [True] * (upto - to + 1)
        done = max(done, high)
    return mask


def normal_primary(primary: str, changed: list[bool], positional: bool = False) -> tuple[list[str], list[bool]]:
    """(lines, mask) of a symbol's text, formatted anew; one that doesn't parse only loses blanks.

    positional: line i of the result has the mask of line i of the text, whatever became of it.
    """
    text = textwrap.dedent(primary or "").rstrip()
    ahead = len(text) - len(text.lstrip())
    moved = text[:ahead].count("\n")  # lines before the first that isn't blank
    text, own = text[ahead:], list(changed[moved:])
    count = len(text.splitlines())
    own = (own + [False] * count)[:count] if count else []
    try:
        tree = ast.parse(text)
        kept = is_normal(tree)
        if not kept:
            tree = ast.fix_missing_locations(_Normal().visit(tree))
        formatted = ast.unparse(tree).strip()
        lines = formatted.splitlines()
    except (SyntaxError, ValueError, RecursionError):
        at = [i for i, x in enumerate(text.splitlines()) if x.strip()]
        lines, mask = _block(text), [own[i] for i in at]
    else:
        mask = [] if positional or not lines else _carried(tree, "\n".join(lines), own, kept and formatted == text)
    if positional:
        mask = (list(changed) + [False] * len(lines))[: len(lines)]
    return lines, mask


def required_lines(lines: list[str], mask: list[bool], context: int = CONTEXT_LINES) -> list[int]:
    """Numbers of the lines that have to stay: the union of the first line, those that give the
    symbol its shape or leave it, and the stretches around changed lines."""
    stretches = [(i - context, i + context + 1) for i, x in enumerate(mask) if x]
    stretches += [(i, i + 1) for i, x in enumerate(lines) if i == 0 or x.strip().startswith(SHAPE_LINES + FLOW_LINES)]
    keep, upto = [], 0
    for low, high in sorted(stretches):
        keep += range(max(low, upto), min(high, len(lines)))
        upto = max(upto, high)
    return keep


def _sections(state: dict, path: str, imports: list[str], siblings: list[str], callees: list[str], lines: list[str]) -> list[tuple[int, str]]:
    """(segment, line) of a packed text."""
    parts = path.replace("\\", "/").removesuffix(".py").split("/")
    module = ".".join(x for x in parts if x and x not in (".", "__init__"))
    head = [(PATH, "<LANG python>"), (PATH, f"<PATH {path}>"), (PATH, f"<MODULE {module}>"), (PATH, f"<SYMBOL {state['symbol'] or ''}>")]
    head += [(CLASS, f"<KIND {state['kind']}>"), (CLASS, f"<ENCLOSING_CLASS {state['enclosing_class'] or ''}>")]
    for segment, name, rows in (
        (IMPORTS, "<IMPORTS>", imports),
        (SIBLINGS, "<SIBLING_SIGNATURES>", siblings),
        (CALLEES, "<CALLEE_SIGNATURES>", callees),
        (PRIMARY, "<PRIMARY>", lines),
    ):
        head += [(segment, name), *((segment, x) for x in rows or ([""] if segment != PRIMARY else []))]
    return head


class _Words(dict):
    """The tokens of each line, found once however often its section is weighed."""

    def __missing__(self, line: str) -> list[str]:
        self[line] = found = WORD.findall(line)
        return found

    def size(self, rows: list[tuple[int, str]]) -> int:
        return sum(len(self[x]) for _, x in rows)


def pack(state: dict, path: str, budget: int, context: int = CONTEXT_LINES, positional: bool = False) -> tuple:
    """The fields of PACK for one state."""
    lines, mask = normal_primary(state["primary"], list(state["changed"]), positional)
    context_parts = [[_line(x) for x in state["siblings"]], [_line(x) for x in state["callees"]], _block(state["imports"])]
    dropped: list[str] = []
    words = _Words()
    rows = _sections(state, path, context_parts[2], context_parts[0], context_parts[1], lines)
    for i, name in enumerate(DROPPED):
        if words.size(rows) <= budget:
            break
        dropped.append(name)
        if i < 3:
            context_parts[i] = []
        else:
            keep = required_lines(lines, mask, context)
            lines, mask = [lines[k] for k in keep], [mask[k] for k in keep]
        rows = _sections(state, path, context_parts[2], context_parts[0], context_parts[1], lines)
    size = words.size(rows)
    if size > budget:
        return (None, size, dropped, None, None, None, None, None, None, f"{size} tokens must stay, the budget is {budget}")
    tokens, segments, changed = [], [], []
    flags = [False] * (len(rows) - len(lines) - 1) + mask[:1] + [False] * (not mask) + mask  # the head goes with the first line
    for (segment, text), flag in zip(rows, flags, strict=True):
        found = words[text]
        tokens += found
        segments += [segment] * len(found)
        changed += [flag] * len(found)
    text = "\n".join(x for _, x in rows).rstrip() + "\n"
    return text, size, dropped, len(lines), mask, tokens, [stable_id(t) for t in tokens], segments, changed, None


def packed_state(budget: int = TOKEN_BUDGET, context: int = CONTEXT_LINES, positional: bool = False):
    """Column function of (state, path): a PACK struct; null for a null state.

    ``error`` says why a state doesn't fit; then the text and its tokens are null and token_count
    is what would have to stay.
    """
    if budget <= 0 or context < 0:
        raise ValueError("the budget is positive and the context isn't negative")

    @F.pandas_udf(PACK)
    def packed(state: pd.DataFrame, path: pd.Series) -> pd.DataFrame:
        rows = []
        for one, where in zip(state.to_dict("records"), path, strict=True):
            known = one["kind"] is not None
            rows.append(pack(one, where or "", budget, context, positional) if known else (None,) * len(PACK.names))
        frame = pd.DataFrame(rows, columns=PACK.names)
        return frame.astype({"token_count": "Int32", "primary_lines": "Int32"})

    return packed
