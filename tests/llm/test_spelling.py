"""Spelling variants against plain versions, planted misspellings, hot blocks and odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import spelling


def one_edit(a, b):
    """The rule itself: some one insertion, deletion or replacement makes a of b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """(word, form, root, n, n_near, form_n) of (doc_id, text), pair by pair."""
    counts, run = Counter(), []
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}
    for doc_id, text in rows:
        for c in [*(text or ""), " "]:
            if c in letters:
                run.append(c.lower() if c < "\x7f" else c)
                continue
            word, run = "".join(run), []
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if word and h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and one_edit(a, b):
                near[a].append((-words[b], b))
    form = {w: min(near[w])[1] for w in words if near[w] and -min(near[w])[0] >= 10 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {tuple(r) for r in spelling.variants(docs).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice(["an", "be", "ri", "ö", "st", "ÿ", "ge"]) for _ in range(rng.randint(4, 7))) for _ in range(120)]
    out = []
    for i in range(160):
        words = []
        for _ in range(40):
            w = rng.choice(base[: rng.randint(1, 120)])
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", w[at] + "x", "é"]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return out


def test_variants_equal_a_plain_version(spark, rows):
    got = found(spark, rows)
    assert got == plain(rows) and any(r[1] for r in got) and max(r[4] for r in got) > 5


def test_forms_are_followed_to_the_last(spark):
    steps = ["planning", "plannings", "planningst", "planningsta", "planningstab"]
    whole = next(i for i in range(100) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in steps))
    rows = [(whole, f"{w} " * 2 * 10**k) for k, w in enumerate(steps)]
    got = {r[0]: r for r in found(spark, rows)}
    assert [got[w][1] for w in steps] == [*steps[1:], None] and {got[w][2] for w in steps} == {steps[-1]}


def test_tiles_equal_the_rule():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(150)}, key=lambda w: (len(w), w))
    lengths = np.array([len(w) for w in words])
    left, right = spelling._matrices(words, lengths)
    a, b = np.triu_indices(len(words), 1)
    near, _ = spelling.single_edits(left, right, lengths, a, b)
    assert near.tolist() == [one_edit(words[i], words[j]) for i, j in zip(a, b, strict=True)]


def test_a_hot_block_and_long_words(spark, monkeypatch):
    # thousands of words that agree but for three places, over several batches and tiles
    letters = "abcdefghijklmnopqr"
    words = [f"longstem{x}{y}{z}ending" for x in letters for y in letters for z in letters[:6]]
    giant = "g" * 3000
    words += [giant, giant + "h", "h" + giant, "x" + giant[:-1], giant[:1500] + "y" + giant[1501:]]
    words = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(words)], "word string, n long")
    got = {r.word: r for r in spelling.neighbours(words).collect()}
    assert got["longstemaaaending"].n_near == 17 + 17 + 5 and len(got) == 18 * 18 * 6 + 5
    assert got["longstemaaaending"].near == "longstemraaending"
    assert got[giant].n_near == 4 and got[giant + "h"].n_near == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.word: r for r in spelling.neighbours(words).collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    text = "Straße-planning planning\x00planing PLANNING " * 30
    rows = [(None, text), (None, None), (1, ""), (2, None), (3, text), (3, text), (4, "q" * 100_000), (5, "q" * 100_000), (6, "one two")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, word string, root string")
    assert {tuple(r) for r in spelling.variants(docs).collect()} == plain(rows)
    assert spelling.variants(docs.limit(0)).count() == 0 and spelling.variants(docs.where("doc_id = 6")).count() == 0
    assert spelling.variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_each_pair_counts_once(spark):
    # an insertion that fits several places: a run of equal letters
    words = spark.createDataFrame([("baaaaaaab", 5), ("baaaaaab", 5), ("baaaaaaaab", 5)], "word string, n long")
    got = {r.word: (r.n_near, r.near) for r in spelling.neighbours(words).collect()}
    assert got == {"baaaaaab": (1, "baaaaaaab"), "baaaaaaab": (2, "baaaaaaaab"), "baaaaaaaab": (1, "baaaaaaab")}
    assert spelling.placed(words).groupBy("word", "size", "part").count().where(F.col("count") > 1).count() == 0
