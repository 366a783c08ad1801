"""Packed code states: what is dropped in which order, what must stay, masks by token."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.functions import codepack, pystate
from weftline.operators import rows

STATE = {
    "symbol": "compute", "kind": "function", "enclosing_class": None, "imports": "import  os\nimport sys", "siblings": ["def helper(value)"],
    "callees": ["len", "str"], "primary": "def compute(x):\n    y = x + 1\n    z = len(y)\n    return z\n", "start_line": 1,
    "changed": [False, False, True, False], "fallback": None,
}
NAMES = codepack.PACK.names


def packed(budget=1024, context=2, positional=False, **changes):
    return dict(zip(NAMES, codepack.pack(STATE | changes, "pkg/mod.py", budget, context, positional), strict=True))


def long_function(n=20):
    lines = ["def compute(value):", *(f"    scratch_{i} = {i}" for i in range(n)), "    changed = value + 1"]
    lines += [*(f"    tail_{i} = {i}" for i in range(n)), "    return changed"]
    return {"primary": "\n".join(lines) + "\n", "changed": [i == n + 1 for i in range(len(lines))]}


def test_a_whole_state():
    got = packed()
    assert got["text"].splitlines() == [
        "<LANG python>", "<PATH pkg/mod.py>", "<MODULE pkg.mod>", "<SYMBOL compute>", "<KIND function>", "<ENCLOSING_CLASS >", "<IMPORTS>",
        "import os", "import sys", "<SIBLING_SIGNATURES>", "def helper(value)", "<CALLEE_SIGNATURES>", "len", "str", "<PRIMARY>",
        "def compute(x):", "    y = x + 1", "    z = len(y)", "    return z",
    ]
    assert got["dropped"] == [] and got["error"] is None and got["primary_lines"] == 4 and got["line_mask"] == STATE["changed"]
    assert got["token_count"] == len(got["tokens"]) == len(got["segments"]) == len(got["changed"]) == len(got["ids"])
    assert [t for t, c in zip(got["tokens"], got["changed"], strict=True) if c] == ["z", "=", "len", "(", "y", ")"]
    assert sorted(set(got["segments"])) == [1, 2, 3, 4, 5, 6]
    assert got["ids"][0] == int.from_bytes(hashlib.blake2b(b"<", digest_size=4).digest(), "big") & 0x7FFFFFFF


def test_context_goes_before_lines_and_changed_lines_stay():
    many = {"imports": "import os\nimport sys\nimport pathlib", "siblings": [f"def sibling_{i}()" for i in range(20)], "callees": [f"callee_{i}" for i in range(20)]}
    sizes = {}
    for budget in (1000, 330, 250, 206, 80):
        got = packed(budget, 1, **many, **long_function())
        sizes[budget] = got["dropped"]
        assert got["token_count"] <= budget and got["error"] is None
    assert [len(x) for x in sizes.values()] == sorted(len(x) for x in sizes.values()) and sizes[80] == list(codepack.DROPPED)
    assert got["text"].split("<PRIMARY>\n")[1].splitlines() == ["def compute(value):", "    scratch_19 = 19", "    changed = value + 1", "    tail_0 = 0", "    return changed"]
    assert got["line_mask"] == [False, False, True, False, False]
    assert "value" in [t for t, c in zip(got["tokens"], got["changed"], strict=True) if c]


def test_what_cannot_fit_is_an_error():
    got = packed(8)
    assert got["text"] is None and got["tokens"] is None and "budget is 8" in got["error"] and got["dropped"] == list(codepack.DROPPED)
    with pytest.raises(ValueError, match="budget"):
        codepack.packed_state(0)


def test_the_flow_of_a_symbol_stays():
    lines = ["@wraps(f)", "def a():", "    with x:", "        p = 1", "    try:", "        q = 1", "    except E:", "        raise", "    finally:", "        r = 1", "    async def b():", "        s = 1"]
    assert codepack.required_lines(lines, [False] * 12) == [0, 1, 2, 4, 6, 7, 8, 10]
    assert codepack.required_lines(lines, [False] * 3 + [True] + [False] * 7 + [True], 1) == [0, 1, 2, 3, 4, 6, 7, 8, 10, 11]
    assert codepack.required_lines([], []) == []


@pytest.mark.parametrize(
    ("primary", "changed", "lines", "mask"),
    [
        # a docstring and a comment go; their change counts for what follows
        ('def f(a):\n    """Doc."""\n    # why\n    x = a\n    return x\n', [3], ["def f(a):", "    x = a", "    return x"], [0, 1, 0]),
        ('def f(a):\n    """Doc\n    more."""\n    x = a\n    return x\n', [5], ["def f(a):", "    x = a", "    return x"], [0, 0, 1]),
        # a statement over several lines becomes one, one line of two statements becomes two
        ("def f(a):\n    x = g(\n        a,\n        1,\n    )\n    return x\n", [4], ["def f(a):", "    x = g(a, 1)", "    return x"], [0, 1, 0]),
        ("def f(a):\n    x = 1; y = 2\n    return x\n", [2], ["def f(a):", "    x = 1", "    y = 2", "    return x"], [0, 1, 1, 0]),
        ("if a: b = 1\nelse:\n    c = 2\n", [3], ["if a:", "    b = 1", "else:", "    c = 2"], [0, 0, 0, 1]),
        ("@d\n\ndef f(a,\n      b):\n    return a\n", [4], ["@d", "def f(a, b):", "    return a"], [1, 1, 0]),
        ("try:\n    a()\nexcept E:\n    b()\n# end\n", [5], ["try:", "    a()", "except E:", "    b()"], [0, 0, 0, 1]),
        ('def f():\n    """Doc."""\n', [1], ["def f():", "    pass"], [1, 0]),
        # what doesn't parse only loses its blanks
        ("\n    value    =   1\n\n    other = = 2\n", [4], ["value = 1", "other = = 2"], [0, 1]),
        ("", [], [], []),
    ],
)
def test_masks_follow_lines(primary, changed, lines, mask):
    flags = [i + 1 in changed for i in range(len(primary.splitlines()))]
    assert codepack.normal_primary(primary, flags) == (lines, [bool(x) for x in mask])


def test_masks_by_position():
    text = 'def f(a):\n    """Doc."""\n    x = a\n    return x\n'
    assert codepack.normal_primary(text, [False, False, True, False], positional=True) == (["def f(a):", "    x = a", "    return x"], [False, False, True])


def test_long_literals_become_marks():
    got = packed(primary="def f():\n    a = '" + "x" * 97 + "'\n    return 12345678901234\n", changed=[False, True, False])
    assert f"    a = '{pystate.STRING_MARK}'\n    return {pystate.NUMBER_MARK}" in got["text"]


def test_states_of_files(spark):
    text = "import os\n\ndef other(a, b):\n    return os.path.join(a, b)\n\ndef big(value):\n" + "".join(f"    v{i} = {i}\n" for i in range(60)) + "    return value\n"
    df = spark.createDataFrame([(1, text, [62]), (2, "def (", [1]), (3, None, [1]), (4, "x = 1\n", [1]), (5, "x = 1\n", [])], "i long, t string, c array<int>")
    state = df.withColumn("s", pystate.code_state("t", "c"))
    got = {r.i: r for r in state.select("i", "s.fallback", codepack.packed_state(90)("s", F.lit("a/b.py")).alias("p")).collect()}
    assert "v55 = 55" in got[1].p.text and "v40" not in got[1].p.text and got[1].p.error is None and got[1].p.token_count <= 90
    assert got[2].p.text is None and got[2].p.error is None and got[3].p.text is None
    assert got[4].fallback == "small_file_no_symbol_overlap" and got[5].fallback == "small_file_no_changed_lines" and got[4].p.changed.count(True) == 3 + 3
    wide = spark.createDataFrame([("\n".join(f"x{i} = {i}" for i in range(60)),)], "t string").select(pystate.code_state("t", F.array().cast("array<int>")).alias("s")).first().s
    assert wide.kind == "region" and wide.start_line == 1 and len(wide.changed) == 16 and wide.fallback == "region_no_changed_lines"


def test_transitions_say_what_does_not_fit(spark):
    before = "def big(value):\n" + "".join(f"    v{i} = {i}\n" for i in range(60)) + "    return value\n"
    after = before.replace("v59 = 59", "v59 = 60")
    edits = spark.createDataFrame([("s", "r", "c", "p/a.py", "p/a.py", before, after, "Change one", "mit", "train")],
                                  "source string, repo string, commit string, path_before string, path_after string, before string, after string, message string, license string, split string")
    row = rows.transitions(edits, 90).first()
    assert row.filter_flags == [f"{s}_dropped:{x}" for s in ("before", "after") for x in codepack.DROPPED]
    assert codepack.stable_id("60") in row.state_after_input_ids and row.state_after_module == "p.a" and sum(row.state_after_changed_hunk_mask) == 3
    assert len(row.state_before_attention_mask) == row.token_count_before == len(row.state_before_segment_ids)
    assert row.action_text_input_ids[0] == codepack.stable_id("change")
    short = rows.transitions(edits, 20).first()
    assert short.state_after_input_ids is None and "budget is 20" in short.state_after_error
    with pytest.raises(Exception, match="budget is 20"):
        rows.transitions(edits, 20, strict=True).collect()
