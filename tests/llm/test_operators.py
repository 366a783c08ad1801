"""Each operator against a brute-force version, on odd rows: nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import annsearch, bpecount, decontam, jaccard, langid, mixlm, packing, substring, tokenfile, toxicity
from weftline.llm.components import connected
from weftline.llm.tokenfiles import chunk_encoder, default_path, load

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, starts string"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{rng.integers(0, 5000)}x" for _ in range(n)]


def odd_texts():
    base, other, shared = words(120, 1), words(90, 2), words(40, 3)
    near = base.copy()
    near[60] = "changed"
    return [
        None,
        "",
        " \n\t ",
        "one two",
        "ONE two",
        " ".join(base),
        " ".join(base),
        " ".join(near),
        " ".join(other[:45] + shared + other[45:]),
        " ".join(words(30, 4) + shared + words(10, 5)),
        " ".join(shared[:34]),
        " ".join(["again"] * 200),
        "é ü ñ " * 30,
        " ".join(words(6000, 6)),
        "a\x0bb\x0cc\rd <|endoftext|> it's",
        "x" * 3000
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in enumerate(odd_texts())]
    rows.append((5, odd_texts()[5], "en", "s", 0, 1, "x"))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_substring(docs, empty):
    rows = [(i, t.encode().split()) for i, t in rows_of(docs)]
    seen = Counter(tuple(w[j : j + 35]) for _, w in rows for j in range(len(w) - 34))
    want = []
    for i, w in rows:
        gone = {p for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for p in range(j, j + 35)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    got = [tuple(r) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == sorted(want)
    assert substring.remove_repeats(empty).count() == 0


def test_jaccard(docs, empty, spark):
    rows = dict(rows_of(docs))
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), root[i]) for i in sets}
    assert len(got) == docs.count()
    assert jaccard.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (10, 11), (11, 12), (12, 10)], "a long, b long")
    assert {(r.cls, r.component) for r in connected(edges).collect()} == {
        (3, 3), (4, 3), (5, 3), (9, 3), (10, 10), (11, 10), (12, 10)
    }


def test_token_counts(docs, empty):
    library = load(default_path("word_bpe_49k.json"))
    got = sorted(tuple(r) for r in bpecount.token_counts(docs).collect())
    want = sorted(
        (i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in rows_of(docs)
    )
    assert got == want and bpecount.token_counts(empty).count() == 0


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunked_encoding_equals_library(name, spaced):
    import random

    rng, letters = random.Random(1), "ab '\n\t .,1é́ΣS<|> 日x\x0b\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["it's  they'LL\n\n go", "İstanbul ß ſ", "\x1cfoo \x1f bar", "word.word,word. , x", "trail  \n \n"]
    library, encode, count = load(default_path(name)), chunk_encoder(default_path(name), spaced), bpecount.counter(
        default_path("word_bpe_49k.json")
    )
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == ids
        if not spaced:
            assert count(t) == len(ids)


def test_token_file(docs, empty, spark):
    library = load(default_path("byte_bpe_50k.json"))
    at, want = 0, []
    for i, t in sorted(rows_of(docs)):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in tokenfile.token_digests(docs).collect()) == want
    assert tokenfile.token_digests(empty).count() == 0
    from weftline.llm.storage import new_path

    folder = new_path(spark, "one")
    tokenfile.write(docs, folder)
    assert tokenfile.read_document(spark, folder, 3) == [library.encode("one two", add_special_tokens=False).ids + [2]]


def test_packing(docs, empty):
    library = load(default_path("word_bpe_49k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in rows_of(docs)}
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in rows_of(docs))
    places = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_best_two_fit_beats_greedy():
    # greedy puts 6 then 3 (gap 1); 3 makes way for 2 + 2
    patterns = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert patterns[0][2] == [(6, 1), (2, 2)] and sum(n for _, n, _ in patterns) == 2


def test_lm_scores(docs, empty, monkeypatch):
    monkeypatch.setattr(mixlm, "DICTIONARY", 50)  # so that most words take the join
    rows = [(i, t.encode().lower().split()) for i, t in rows_of(docs)]
    train = [(i, w) for i, w in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(x for _, w in train for x in [*w, "end"])
    n, v = sum(counts.values()), len(counts)
    got = sorted(mixlm.scores(docs).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    for r, (i, w) in zip(got, sorted(rows, key=lambda x: (x[0], len(x[1]))), strict=True):
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, "end"])
        assert r.doc_id == i and r.n_tokens == len(w) + 1 and r.n_known == sum(
            counts[x] > 0 for x in [*w, "end"]
        ) and r.train_tokens == n
        assert r.base_score == pytest.approx(base) and r.score < 0 and math.isfinite(r.score)
    assert mixlm.scores(empty).count() == 0


def test_bit_probabilities_sum_to_one():
    sizes = np.append(0, np.cumsum([1 << t for t in mixlm.TABLES]))
    mixer = mixlm._learn(np.zeros(2 * int(sizes[-1]), np.uint32), [[(b"ab", 3), (b"b", 1)]])
    total = sum(2 ** -mixer.cost(np.array([97, b], np.uint8), np.array([0, 2]))[0] for b in range(256))
    first = sum(2 ** -mixer.cost(np.array([a], np.uint8), np.array([0, 1]))[0] for a in range(256))
    only = 2 ** -mixer.cost(np.array([97], np.uint8), np.array([0, 1]))[0]
    assert first == pytest.approx(1, abs=1e-4) and total == pytest.approx(only, rel=1e-4)


def test_mixer_learns_from_every_training_document(spark, monkeypatch):
    learned, codes = [], []
    move, byte_code = mixlm._Learner.move, mixlm.byte_code
    monkeypatch.setattr(
        mixlm._Learner, "move", lambda self, pull, curve, hits: (learned.append(hits.sum()), move(self, pull, curve, hits))
    )
    monkeypatch.setattr(mixlm, "byte_code", lambda counts: codes.append(byte_code(counts)) or codes[-1])
    rows = [(i, f"text {i}" + " of words" * (i % 3)) for i in range(1_200)]
    got = mixlm.scores(spark.createDataFrame(rows, "doc_id long, text string")).where("not held_out").collect()
    kept = {r.doc_id for r in got}
    raw = b"".join(b"".join(w + b" " for w in t.encode().split()) + mixlm.END for i, t in rows if i in kept)
    assert len(got) > 1_000 and len(raw) == sum(r.n_bytes for r in got)
    assert sum(learned) == codes[0].lengths[np.frombuffer(raw, np.uint8)].sum()  # every bit of every text


def test_mixer_costs_equal_a_bit_by_bit_coder():
    texts = [b"the cat sat \n", b"the dog sat on the cat \n", b"\n", "ñandú the thé \n".encode()]
    data, borders = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts]))
    size = int(mixlm._OFFSETS[-1])
    counts = np.random.default_rng(1).integers(0, 9, 2 * size).astype(np.uint32)
    mixer = mixlm._learn(counts, [[(x, 2) for x in texts], [(texts[1], 3)]])
    hashes, _ = mixlm.contexts(data, borders)
    code, want = mixer.code, []
    for a, z in zip(borders[:-1], borders[1:], strict=True):
        spent, begun = 0.0, a
        for at in range(a, z):
            if at > a and data[at - 1] == 32:
                begun = at
            first = int(code.starts[data[at]])
            for depth in range(int(code.lengths[data[at]])):
                node, bit = int(code.nodes[first + depth]), int(code.bits[first + depth])
                slots = [int(hashes[0][at]) << 8 | node]
                for h, bits in zip(hashes[1:], mixlm.TABLES[1:], strict=True):
                    slots.append(
                        (((int(h[at]) ^ (node * 0x9E3779B97F4A7C15 % 2**64)) * 0xD6E8FEB86659FD93) % 2**64) >> (64 - bits)
                    )
                gate = (min(at - begun, 7) * 8 + min(depth, 7)) * 8 + int(mixer.sure[slots[-1]])
                mixed = float(mixer.weights[gate][-1]) + sum(
                    float(mixer.weights[gate][k]) * int(mixer.tables[k][s]) for k, s in enumerate(slots)
                )
                p = 1 / (1 + math.exp(-max(-16.0, min(16.0, mixed))))
                level = round(max(-8.0, min(8.0, mixed)) * 2) + mixlm.LEVELS // 2
                p = min(max((1 - mixlm.REFINED) * p + mixlm.REFINED * float(mixer.refined[gate, level]), 1e-6), 1 - 1e-6)
                spent -= math.log2(p if bit else 1 - p)
        want.append(spent)
    assert mixer.cost(data, borders) == pytest.approx(want, rel=1e-4)


def test_equal_contexts_are_looked_up_once():
    texts = [b"the cat sat on the mat \n", b"\n", b"a dog on a mat \n", b"cat the mat \n"] * 50
    data, borders = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts]))
    code = mixlm.byte_code(np.bincount(data, minlength=256))
    hashes, place = mixlm.contexts(data, borders)
    kinds, met = 0, Counter()
    for order, parts in mixlm._blocks(code, data, borders):
        assert sorted(order.tolist()) == list(range(len(data)))
        for bits in parts:
            kinds += len(bits.gate)
            rows = [np.repeat(x, bits.times) for x in bits.slots]
            rows.insert(mixlm.PAIR, bits.pair)
            met.update((bits.one, *x) for x in zip(*(x.tolist() for x in rows), strict=True))
    want = Counter()
    for at, byte in enumerate(data.tolist()):  # every bit of every byte by itself
        for step in range(int(code.starts[byte]), int(code.starts[byte] + code.lengths[byte])):
            node = int(code.nodes[step])
            key = node * 0x9E3779B97F4A7C15 % 2**64
            want[
                int(code.bits[step]),
                int(hashes[0][at]) << 8 | node,
                *((int(h[at]) ^ key) * 0xD6E8FEB86659FD93 % 2**64 >> 64 - n for h, n in zip(hashes[1:], mixlm.TABLES[1:], strict=True))
            ] += 1
    assert met == want and kinds < sum(want.values()) / 40


def test_byte_code_is_complete_and_follows_counts():
    code = mixlm.byte_code(np.array([1000 if i == 32 else 10 if i < 128 else 0 for i in range(256)]))
    assert sum(2.0 ** -int(x) for x in code.lengths) == 1 and code.lengths[32] == 1 < code.lengths[65] < code.lengths[200]


def test_mixer_codes_the_running_text(spark):
    phrase = words(40, 5)
    shuffled = list(np.random.default_rng(5).permutation(phrase))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [
        (i, " ".join(words(20, i) + phrase)) for i in range(400) if i not in held
    ] + [(held[0], " ".join(phrase)), (held[1], " ".join(shuffled))]
    got = {r.doc_id: r for r in mixlm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    known, mixed = got[held[0]], got[held[1]]
    assert known.n_bytes == mixed.n_bytes and known.base_score == pytest.approx(mixed.base_score)
    assert known.bits_per_byte < 0.7 * mixed.bits_per_byte


def test_language(spark, empty):
    texts = {
        "en": "the house and the garden of that man with this",
        "de": "das haus und der garten von dem mann mit dieser",
        "fr": "la maison et le jardin de cet homme avec cette",
        "es": "la casa y el jardin de ese hombre con esta"
    }
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.permutation(texts[lang].split())), lang) for i in range(160) for lang in [list(texts)[i % 4]]]
    rows += [(1000, None, "en"), (1001, "123 !?", None), (1002, "", "fr")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:160] if got[i].held_out]
    assert held and np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(empty.limit(0)).collect()} == set()


def test_decontamination(spark, docs, empty):
    item = words(30, 77)
    changed = [w if i % 6 != 3 else "other" for i, w in enumerate(item)]
    rows = [
        (1, " ".join(words(50, 8) + item + words(9, 9))),
        (2, " ".join(words(80, 10))),
        (3, " ".join(words(20, 11) + changed)),
        (4, " ".join(item).upper()),
        (5, None),
        (6, " ".join(item[:8]))
    ]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None)], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (3, 7), (4, 7)}
    assert next((r.doc_word, r.n_words, r.n_equal) for r in got if r.doc_id == 1) == (50, 30, 30)
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_bounds_hold_for_the_whole_overlap(spark):
    other = lambda w, gone: [x if i not in gone else f"other{i}" for i, x in enumerate(w)]
    short, long = words(15, 41), words(48, 42)
    rows = [
        (1, " ".join(words(30, 43) + other(short, {2, 8, 14}))),
        (2, " ".join(other(long, set(range(3, 48, 4))) + words(9, 44))),
        (3, " ".join(words(9, 45) + other(short, {2, 6, 10, 14}))),
        (4, " ".join(other(long, set(range(2, 48, 3)))))
    ]
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    got = {
        (r.doc_id, r.item_id, r.doc_word, r.n_words, r.n_equal) for r in decontam.contaminated(
            spark.createDataFrame(rows, "doc_id long, text string"), bench
        ).collect()
    }
    assert got == {(1, 1, 30, 14, 12), (2, 2, 0, 47, 36)}


def test_decontamination_finds_random_substitutions():
    rng, missed, met = np.random.default_rng(7), 0, 0
    part = lambda w: next(decontam.bs.slices(decontam.bs.lowered(pa.array([" ".join(w)], pa.large_string())), 1 << 62))
    for trial in range(300):
        item = [f"w{x}" for x in rng.integers(0, 10**9, (15, 20)[trial % 2])]
        laid = [w if rng.random() > 0.1 else "other" for w in item]
        if sum(a == b for a, b in zip(item, laid, strict=True)) >= 12:
            met += 1
            missed += not decontam.search(part(words(30, trial) + laid), decontam.build_index([(1, " ".join(item))]))
    assert met > 280 and missed <= 0.02 * met


def test_toxicity(spark, empty):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        text = words(40, i)
        if i % 4 == 0:
            for _ in range(1 + i % 5):
                text.insert(int(rng.integers(0, 40)), ["nasty", "vile", "Horrid!"][i % 3])
        rows.append((i, " ".join(text)))
        if i < 300:
            labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, "")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert all(got[i].rejected == (i % 4 == 0) for i in range(300, 400))
    assert not got[900].rejected and got[901].severity == 0
    assert toxicity.toxicity(empty, lab).count() == 0 and not any(
        r.rejected for r in toxicity.toxicity(d, lab.limit(0)).collect()
    )


def test_ordinal_recovers_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=600)
    grades = np.searchsorted([-0.5, 0.7], x + 0.3 * rng.logistic(size=600))
    w, theta = toxicity.fit_ordinal(np.arange(600), np.zeros(600, int), x, grades, 1, sparsity=0, steps=800)
    assert w[0] > 1.5 and theta[0] < theta[1]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16)).round(3)
    v[300:330] = v[5]  # ties go to the smaller id
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16)]
    got = {}
    for r in sorted(annsearch.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400, 500}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        hits += len(set(want.tolist()) & {i for i, _ in found})
        assert all(abs(d[i] - s) < 1e-9 for i, s in found) and len(found) == 10
    assert hits >= 0.9 * 60
    assert [i for i, _ in got[300]] == [5, *range(301, 310)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
