"""Odd rows for the operators and the pipeline's stages: null and repeated ids, empty and long
texts, ties, repeated rows, empty tables and clashing columns; plain versions of some results."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from weftline.llm import annsearch, decontam, jaccard, langid, packing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = DOCS + ", k long, row long, starts string, stays boolean, cls long, h long, list int, toxic int, item_id long"


def prose(n, seed, marks=()):
    rng = np.random.default_rng(seed)
    words = [f"w{rng.integers(0, 300)}" for _ in range(n)]
    for m in marks:
        words[int(rng.integers(0, n))] = m
    return " ".join(words)


def frame(spark, rows, schema=DOCS):
    extra = (1, 2, "s", True, 3, 4, 5, 1, 7) if schema == CLASH else ()
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def labelled(spark):
    bad = ("vile", "rotten", "awful")
    rows = [(i, prose(30, i, [bad[i % 3]] if i % 5 == 0 else [])) for i in range(300)]
    labels = spark.createDataFrame(
        [(i, int(i % 5 == 0), 1) for i in range(0, 300, 2)] + [(None, 1, 1), (4, None, 1), (5000, 1, 1)],
        "doc_id long, toxic int, text int"
    )
    odd = [
        (None, "vile " * 3),
        (None, None),
        (1000, ""),
        (1001, None),
        (1002, "vile " * 30000),
        (1003, prose(40, 9)),
        (1003, prose(40, 9)),
        (1003, prose(40, 9, ["rotten", "vile"])),
        (1004, "unknown words alone")
    ]
    return rows + odd, labels


def test_toxicity_on_odd_rows(spark, labelled):
    rows, labels = labelled
    docs = frame(spark, rows, CLASH)
    model = toxicity.fit(docs, labels)
    got = toxicity.grade(docs, model).collect()
    assert len(got) == len(rows)
    flags = Counter((r.doc_id, r.rejected) for r in got)
    assert all(flags[i, i % 5 == 0] == 1 for i in range(300))
    assert flags[None, True] == 1 and flags[None, False] == 1 and flags[1000, False] == 1 and flags[1001, False] == 1 and flags[1002, True] == 1
    assert flags[1003, False] == 2 and flags[1003, True] == 1 and flags[1004, False] == 1
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    assert toxicity.grade(docs.limit(0), model).count() == 0 and toxicity.clean(docs.limit(0), model).count() == 0


def test_severity_equals_a_plain_sum(spark, labelled):
    import re

    from weftline.llm import bytescan as bs

    rows, labels = labelled
    docs = frame(spark, rows[:60])
    model = toxicity.fit(frame(spark, rows), labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    hash_of = lambda data, salt=None: int(
        (
            bs.find_words(bs.Slice(0, np.frombuffer(data, np.uint8), np.array([0, len(data)]))).hashes() if salt is None else bs.mix(
                bs.spans_hash(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), np.array([0]), np.array([salt])),
                100 + salt
            )
        )[0]
    )
    for r in toxicity.grade(docs, model).collect():
        found = Counter()
        for w in re.findall(r"[a-z0-9]+", dict(rows)[r.doc_id].lower()):
            data = w.encode()
            found[hash_of(data)] += 1
            found.update(hash_of(data, s) for s in toxicity.STEMS if len(data) > s)
        score = sum(math.log1p(n) * weight.get(h, 0.0) for h, n in found.items())
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(above)) and r.p_toxic == pytest.approx(above[0]) and r.rejected == (
            above[0] >= 0.5 and score > 0
        )


def test_ordinal_fit_never_rises_and_orders_thresholds():
    rng = np.random.default_rng(3)
    n, width = 400, 30
    x = rng.random((n, width)) < 0.2
    grades = np.minimum(3, x[:, :3].sum(axis=1))
    rows, columns = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, columns, np.full(len(rows), 0.7), grades, width, sparsity=1e-3)
    assert np.all(np.diff(theta) > 0) and np.all(np.isfinite(theta)) and w[:3].min() > 2 and np.abs(w[3:]).max() < 0.5 * w[:3].min()


def test_random_labels_reject_no_text_without_known_words(spark):
    rng = np.random.default_rng(5)
    rows = [(i, prose(20, i)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(rng.random() < 0.67)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    got = toxicity.grade(frame(spark, [(9, "nothing known here"), (10, "")]), model).collect()
    assert not any(r.rejected for r in got)
    assert not any(r.rejected for r in toxicity.toxicity(frame(spark, rows), labels.where("toxic = 1")).collect())  # one class only
    assert toxicity.toxicity(frame(spark, rows), labels.limit(0)).where("rejected").count() == 0


def test_language_on_odd_rows(spark):
    texts = {
        "en": "the house and the garden of that man",
        "de": "das haus und der garten von dem mann",
        "fr": "la maison et le jardin de cet homme",
        "es": "la casa y el jardin de ese hombre"
    }
    rows = [
        (
            i, " ".join(np.random.default_rng(i).permutation(texts[lang].split())), lang, "s", 1
        ) for i in range(160) for lang in [list(texts)[i % 4]]
    ]
    odd = [
        (None, texts["en"], "en", "s", 1),
        (7, None, "en", "s", 1),
        (8, "", None, "s", 1),
        (9, "12 34", "de", "s", 1),
        (10, texts["fr"] * 9000, "fr", "s", 1),
        (11, texts["de"], "de", "s", 1),
        (11, texts["de"], "de", "s", 1)
    ]
    extra = (1, 2, "s", True, 3, 4, 5, 1, 7)
    docs = spark.createDataFrame([(*r, *extra) for r in rows + odd], CLASH).repartition(3)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert "en" in {
        r.lang_pred for r in by[None]
    } and "und" in {r.lang_pred for r in by[7]} & {r.lang_pred for r in by[8]} & {r.lang_pred for r in by[9]}
    assert "fr" in {r.lang_pred for r in by[10]} and len(by[11]) == 3 and all(0 <= r.score <= 1 for r in got)
    train = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("doc_id").isNotNull())
    assert langid.identify(train.limit(0)).count() == 0


def plain_overlaps(texts, items):
    """All shifts of every text over every item, those that a mask hits and that count."""
    cut = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    found = set()
    for row, text in texts:
        w = cut(text or "")
        for item, other in items:
            v = cut(other or "")
            for shift in range(-len(v), len(w)):
                at = [i for i in range(len(v)) if 0 <= i + shift < len(w)]
                equal = [v[i] == w[i + shift] for i in at]
                hit = any(
                    all(
                        m == "0" or equal[j + p] for p, m in enumerate(mask)
                    ) for mask in decontam.MASKS for j in range(len(at) - len(mask) + 1)
                )
                if not hit:
                    continue
                whole = sum(equal) >= decontam.LEAST_SHARE * len(v)
                best = max(
                    (
                        sum(equal[i:j]) for i in range(len(at)) for j in range(i + 1, len(at) + 1) if sum(
                            1 if e else -decontam.REPLACED for e in equal[i:j]
                        ) >= 0
                    ),
                    default=0
                )
                if whole or best >= decontam.LEAST_WORDS:
                    found.add((row, item))
    return found


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    items = [(i, prose(14 + i, 50 + i)) for i in range(4)]
    texts = []
    for i in range(60):
        words = prose(30, 200 + i).split()
        piece = items[i % 4][1].split()
        for p in range(len(piece)):
            if rng.random() < 0.04 * (i % 8):
                piece[p] = f"other{p}"
        texts.append((i, " ".join(words[:10] + piece + words[10:]) if i % 3 else " ".join(words)))
    got = decontam.contaminated(
        frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    ).select("doc_id", "item_id").distinct().collect()
    want = plain_overlaps(texts, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and 20 < len(want) < 45


def test_decontamination_on_odd_rows(spark):
    item = prose(30, 1)
    rows = [
        (None, item),
        (1, item),
        (1, item),
        (1, "clean text"),
        (2, None),
        (3, ""),
        (4, prose(50000, 3) + " " + item),
        (5, prose(30, 2))
    ]
    bench = spark.createDataFrame(
        [(7, item, 1), (7, item, 2), (8, None, 3), (9, "", 4), (None, prose(20, 2), 5)], "item_id long, text string, doc_id int"
    )
    docs = frame(spark, rows, CLASH)
    got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    assert got == {(None, 7): 1, (1, 7): 2, (4, 7): 1}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted(
        [(1, "clean text"), (2, ""), (3, ""), (5, prose(30, 2))]
    )
    assert decontam.contaminated(docs, bench, block_words=10).count() == 4  # several passes


def test_neighbours_on_odd_rows(spark):
    v = np.random.default_rng(4).normal(size=(120, 8))
    rows = [(i, [float(a) for a in x], 1) for i, x in enumerate(v)]
    rows += [
        (50, rows[0][1], 1),
        (100, rows[100][1], 1),
        (200, rows[7][1], 1),
        (None, rows[1][1], 1),
        (300, None, 1),
        (400, [0.0] * 8, 1),
        (500, [1.0] * 7 + [None], 1),
        (600, [float("inf")] * 8, 1)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, r int")
    usable = [
        (i, x) for i,
        x,
        _ in rows if i is not None and x is not None and any(x) and all(a is not None and math.isfinite(a) for a in x)
    ]
    got = {}
    for r in annsearch.search(df, probes=64, rerank=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for n, (i, x) in enumerate(usable):
        if i % 100 == 0:
            d = sorted((math.dist(x, y), j) for m, (j, y) in enumerate(usable) if m != n)[:10]
            want.setdefault(i, []).extend((p + 1, j, pytest.approx(s)) for p, (s, j) in enumerate(d))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        assert sorted(found) == sorted(want[q], key=lambda x: (x[0], x[1]))
    assert annsearch.search(df.limit(0)).count() == 0 and annsearch.search(df.where("vec_id = 300")).count() == 0
    assert annsearch.search(df.where("vec_id = 100")).count() == 2  # two rows of one id find each other
    with pytest.raises(ValueError, match="components"):
        annsearch.search(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_a_large_group_of_copies_takes_one_place(spark):
    v = np.random.default_rng(6).normal(size=(60, 8))
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v)] + [
        (1000 + i, [float(a) for a in v[0] + 0.01]) for i in range(1, 700)
    ]
    got = sorted(
        (r["rank"], r.vec_id) for r in annsearch.search(
            spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rerank=12
        ).where("query_id = 0").collect()
    )
    assert [i for _, i in got] == list(range(1001, 1011))


def test_jaccard_keeps_rows_of_one_id_apart(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(5, a), (5, b), (6, a), (7, b + " end"), (None, a), (8, ""), (8, ""), (9, None)]
    got = jaccard.near_duplicates(frame(spark, rows, CLASH)).collect()
    assert len(got) == len(rows) and sum(r.first for r in got if r.n_shingles and r.doc_id is not None) == 2
    assert {r.component_id for r in got if r.doc_id in (5, 6, 7)} == {5} and all(r.first for r in got if not r.n_shingles)


# --- the pipeline's stages -------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, labelled):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, prose(30, 77))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labelled[1].select("doc_id", "toxic").write.parquet(f"{path}/labels.parquet")
    return str(path)


def run_stage(spark, name, rows, folder, schema=DOCS):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, frame(spark, rows, schema), folder)
    assert stage(spark, frame(spark, rows, schema).limit(0), folder).count() == 0
    return out


def test_stage_toxicity(spark, labelled, folder):
    rows, _ = labelled
    out = run_stage(spark, "toxicity", rows, folder, CLASH)
    assert out.columns == pipeline.COLUMNS
    gone = Counter(rows) - Counter((r.doc_id, r.text) for r in out.collect())
    assert {i for i, _ in gone} == {*range(0, 300, 5), None, 1002, 1003} and sum(gone.values()) == 63


def test_stage_near_duplicates(spark, folder):
    base = prose(80, 1)
    near = base.replace(base.split()[40], "changed", 1)
    other = prose(80, 2)
    rows = [
        (3, base),
        (2, near),
        (4, base),
        (4, base),
        (2, other),
        (9, other),
        (9, other),
        (None, base),
        (None, base),
        (10, None),
        (11, ""),
        (11, ""),
        (12, "two words"),
        (13, "two words"),
        (14, prose(20000, 8))
    ]
    out = run_stage(spark, "near_duplicates", rows, folder, CLASH)
    assert out.columns == pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(
        [
            (2, near),
            (2, other),
            (None, base),
            (None, base),
            (10, None),
            (11, ""),
            (11, ""),
            (12, "two words"),
            (14, rows[-1][1])
        ]
    )
    alone = run_stage(spark, "near_duplicates", [(4, base), (4, base), (4, base)], folder)
    assert [(r.doc_id, r.text) for r in alone.collect()] == [(4, base)]


def test_stage_substring_dedup(spark, folder):
    shared, a, b = prose(40, 1), prose(50, 2), prose(50, 3)
    rows = [
        (1, f"{a} {shared}"),
        (1, f"{shared} {b}"),
        (2, f"  {a[:60]} \n"),
        (None, f"{b} {shared} tail words"),
        (3, None),
        (4, ""),
        (5, shared),
        (6, prose(20000, 9))
    ]
    out = run_stage(spark, "substring_dedup", rows, folder, CLASH)
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert out.columns == pipeline.COLUMNS
    assert (1, a, len(a)) in got and (1, b, len(b)) not in got  # b's own words repeat in the row without an id
    assert (
        2, f"  {a[:60]} \n", len(a[:60]) + 4
    ) in got and (3, None, 0) in got and (4, "", 0) in got and not any(i == 5 for i, _, _ in got)
    assert (None, "tail words", 10) in got and (6, rows[-1][1], len(rows[-1][1])) in got


def test_stage_decontamination(spark, folder):
    item = prose(30, 77)
    rows = [
        (None, item),
        (1, f"{prose(20, 5)} {item}"),
        (1, prose(20, 6)),
        (2, None),
        (3, ""),
        (4, prose(20, 7)),
        (4, prose(20, 7)),
        (5, prose(20000, 8))
    ]
    out = run_stage(spark, "decontamination", rows, folder, CLASH)
    assert out.columns == pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows[2:])


def test_stage_packing(spark, folder):
    rows = [
        (None, "a b"),
        (1, None),
        (2, ""),
        (3, prose(4000, 1)),
        (3, prose(4000, 1)),
        (3, "x"),
        *((10 + i, prose(int(n), i)) for i, n in enumerate(np.random.default_rng(2).integers(5, 900, 120)))
    ]
    got = run_stage(spark, "packing", rows, folder, CLASH).collect()
    placed = {}
    for r in got:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.piece == 0 for r in got) == len(rows) and Counter(r.doc_id for r in got if r.piece == 0)[3] == 3
    total = sum(r.length for r in got)
    assert len(placed) <= 1.03 * total / packing.CAPACITY + 1  # near the lower bound


def test_pipeline_on_an_empty_table_and_in_turn(spark, folder, labelled):
    rows, _ = labelled
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = pipeline.run(spark, folder)
    assert out.where("piece = 0").count() > 100
    frame(spark, rows[:1]).limit(0).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).count() == 0
