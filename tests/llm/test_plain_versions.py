"""Language machines by hand, and null ids where an operator works by id."""

import math
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpecount, langid, mixlm, tokenfile, tokenfiles

SF = "/root/testdata/sf0.001"


def plain_features(text):
    """Trigrams of the bytes in 4096 slots, square roots, length 1; written with loops."""
    data = [b | 32 if 65 <= b <= 90 else b for b in text.encode()]
    data = [b if b >= 128 or chr(b).isalnum() else 32 for b in data]
    slots = Counter()
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if b != 32:
            slots[((a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    norm = math.sqrt(sum(slots.values())) or 1
    return {s: math.sqrt(n) / norm for s, n in slots.items()}


def plain_prediction(model, text):
    """(language, score): the family of the largest margin, then votes of its pairs."""
    if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    x = plain_features(text)
    margin = lambda w: sum(float(w[s]) * v for s, v in x.items()) + float(w[-1])
    chance = lambda m: 1 / (1 + math.exp(-3 * max(-10, min(10, m))))
    by_family = [margin(w) for w in model.family_weights]
    best = max(range(len(by_family)), key=lambda f: (by_family[f], -f))
    certain = chance(by_family[best]) if len(by_family) > 1 else 1.0
    own = model.languages[model.families[best]]
    votes, sums = Counter(), Counter()
    for a, b in combinations(own, 2):
        m = margin(model.pairs[a, b])
        votes[a if m >= 0 else b] += 1
        sums[a] += m
        sums[b] -= m
    top = max(own, key=lambda v: (votes[v], sums[v], [-ord(c) for c in v]))
    return top, certain * (chance(sums[top] / (len(own) - 1)) if len(own) > 1 else 1.0)


def test_languages_equal_the_machines_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(100_001, "", "en"), (100_002, "12 34", "en"), (100_003, None, "en"), (100_004, "ça été déjà où", None), (None, "der die das und", "de")], docs.schema)
    docs = docs.unionByName(odd).cache()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = langid.fit(docs.where(~held))
    got = {(r.doc_id, r.held_out): r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = total = 0
    for r in rows:
        out = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1
        name, score = plain_prediction(model, r.text)
        found = got[r.doc_id, out]
        assert found.lang_pred == name and found.score == pytest.approx(score, abs=1e-4)
        right, total = right + (out and name == r.lang), total + (out and r.doc_id is not None and r.doc_id < 100_000)
    assert total > 30 and right >= 0.95 * total


@pytest.fixture(scope="module")
def null_ids(spark):
    rows = [(None, "two words"), (None, None), (None, "two words"), (1, "two words"), (1, "other words here"), (2, "")]
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_tokens long, score string").repartition(2)


def test_token_counts_of_null_ids(null_ids):
    got = Counter((r.doc_id, r.n_bytes) for r in bpecount.token_counts(null_ids).collect())
    assert got == {(None, 9): 2, (None, 0): 1, (1, 9): 1, (1, 16): 1, (2, 0): 1}


def test_token_files_of_null_ids(spark, null_ids):
    encode = tokenfiles.load(tokenfiles.default_path(tokenfile.VOCABULARY)).encode
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.start) for r in tokenfile.token_digests(null_ids).collect()), key=lambda r: r[3])
    want = Counter((i is not None, i or 0, len(encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in null_ids.collect())
    assert Counter(r[:3] for r in got) == want
    ends = np.cumsum([0, *(r[2] for r in got)])
    assert [r[3] for r in got] == ends[:-1].tolist() and [r[1] for r in got if r[0]] == sorted(r[1] for r in got if r[0])


def test_scores_of_null_and_repeated_ids(null_ids):
    got = mixlm.scores(null_ids).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == {(None, 3): 2, (None, 1): 1, (1, 3): 1, (1, 4): 1, (2, 1): 1}
    assert not any(r.held_out for r in got if r.doc_id is None) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    # rows of one id keep their own texts' scores
    one = {r.n_tokens: r for r in got if r.doc_id == 1}
    train = Counter()
    for i, t in ((None, "two words"), (None, ""), (None, "two words"), (1, "two words"), (1, "other words here"), (2, "")):
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            train.update([*t.split(), "\n"])
    n, v = sum(train.values()), len(train)
    for tokens, text in ((3, "two words"), (4, "other words here")):
        want = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in [*text.split(), "\n"])
        assert one[tokens].base_score == pytest.approx(want)
