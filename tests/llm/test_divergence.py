"""Source divergence against a plain version; the tree against its dense matrix; odd rows."""

import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import divergence

SCHEMA = "text string, lang string, source string"


def plain(rows):
    """All result rows of (text, lang, source), with Python's own integers."""
    count, documents, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(found)
        documents[lang].update(set(found))
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in documents[lang].items() if n >= 3]
        own = {s: {t: count[lang, s][t] for t in kept} for s in names}
        every = {t: sum(own[s][t] for s in names) for t in kept}
        share = lambda of, t: 1 + 10**9 * (of[t] + 1) // (sum(of.values()) + len(kept))
        adds = lambda p, q: (p - q) ** 2 // q
        for s in names:
            pairs = [(-sum(adds(share(own[s], t), share(own[o], t)) for t in kept), o.encode(), o) for o in names - {s}]
            terms = [(-adds(share(own[s], t), share(every, t)), t.encode(), t) for t in kept if own[s][t] and share(own[s], t) > share(every, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)}
    return out


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice(["Ba", "é", "ti", "中", "o", "Zz"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    out = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de", "fr"])
        source = f"s{rng.randint(0, 8) if lang != 'fr' else 0}"
        some = words[:: 1 + rng.randint(0, 2)]
        out.append((rng.choice([" ", "_", "1"]).join(rng.choice(some[: 20 + i]) for _ in range(rng.randint(0, 60))), lang, source))
    return out + [("only here " * 9, "xx", "a"), ("", "xx", "b"), (None, "yy", "a"), ("x", "yy", "c")]


def test_audit_equals_a_plain_version(spark, rows):
    got = found(spark, rows)
    assert got == plain(rows)
    assert {r[2] for r in got if r[0] == "fr"} <= {"term"} and {r[4] for r in got if r[0] == "yy"} == {0}


def test_many_blocks_and_tiles(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 2)
    monkeypatch.setattr(divergence, "TILE_TERMS", 10)
    assert found(spark, rows) == plain(rows)


def test_ranks_stop_at_their_limit(spark):
    words = ["".join(x) for x in zip("abcdefghijklmnopqrst" * 15, "abcdefghijklmnopqrstuvwxyz" * 12, "abcdefghijklmno" * 20, strict=False)]
    rows = [(" ".join(words), "en", "a")] * 3 + [("other words", "en", "b")] * 3
    got = found(spark, rows)
    assert got == plain(rows) and sum(r[2] == "term" and r[1] == "a" for r in got) == 200


@pytest.mark.parametrize("seed", range(6))
def test_trees_equal_their_matrix(seed):
    rng = np.random.default_rng(seed)
    rows, columns = int(rng.integers(1, 12)), int(rng.integers(1, 400))
    dense = rng.poisson(rng.choice([0.02, 0.3, 2], size=(1, columns)), size=(rows, columns)) * rng.integers(1, 1000)
    dense[:, columns // 3 : columns // 2] = 0
    height = max(1, (max(rows, columns) - 1).bit_length())
    at = np.nonzero(dense)
    tree = divergence.Tree.build(at[0], at[1], dense[at], height)
    assert len(tree.leaves) == len(at[0]) and sum(map(np.count_nonzero, tree.bits)) <= height * max(1, len(at[0]))
    size = dense.sum(1) + columns + 7
    own, other = (x.ravel() for x in np.meshgrid(np.arange(rows), np.arange(rows), indexing="ij"))
    p = divergence.shares(dense, size[:, None])
    there, back = divergence.compare(tree, size, (own, other), columns)
    assert there.tolist() == divergence.priced(p[own], p[other]).sum(1).tolist()
    assert back.tolist() == divergence.priced(p[other], p[own]).sum(1).tolist()


def test_shares_are_exact_beyond_a_long():
    counts, size = np.array([0, 5, 40_000_000_000]), np.array([90_000_000_000] * 3)
    assert divergence.shares(counts, size).tolist() == [1 + 10**9 * (c + 1) // 90_000_000_000 for c in counts.tolist()]


def test_odd_rows(spark):
    long = "word other " * 100_000
    rows = [(long, None, None)] * 3 + [("word \x00other", None, "b")] * 4 + [(None, None, None), ("", "en", None), ("Word", "", "b"), ("日本 Ünï", "en", "b")]
    docs = spark.createDataFrame([(*r, "t", 7, 1) for r in rows], SCHEMA + ", term string, n int, row int")
    got = {tuple(r) for r in divergence.audit(docs).collect()}
    assert got == plain(rows) and any(r[4] > 0 for r in got)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_a_fresh_worker_finds_what_tiles_compute_with():
    script = "import sys; from weftline.llm import divergence; assert 'pyarrow.compute' in sys.modules"
    assert subprocess.run([sys.executable, "-c", script], check=False).returncode == 0  # conftest has it on PYTHONPATH
