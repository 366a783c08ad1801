"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= g) = sigmoid(threshold_g - w.x): one weight per word, shared by all ordered
thresholds. The labels say toxic or not; grades above 0 come from how many words a toxic
document holds that the labelled sample meets almost only in toxic documents
(``GRADE_BORDERS``). Features are log(1 + count) of the words of letters and digits, lower
case, and of their first ``STEMS`` bytes, so that inflected and compound forms are met too;
they are told apart by 64-bit hashes, so rare words never share the weight of others.

The fit reads a sample of labelled rows bounded by ``SAMPLE``; copies and most near copies of a
text count once. Executors count in how many sampled texts each feature occurs; only the
``FEATURES`` most telling ones and the texts' counts of them reach the driver. Classes are
weighted back to their share of all labelled documents, so thresholds fit the natural share.
Scoring is a map over rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .storage import stored

#: Labelled documents that the fit may use, clean and toxic, by hash of their id.
SAMPLE = (4_000, 2_000)
#: Features that the model may have.
FEATURES = 20_000
#: Lengths in bytes of the word beginnings that are features besides whole words.
STEMS = (4, 5, 6, 7)
#: Bytes of text whose features are held at once.
SLICE = 1 << 20
#: A word needs so many sampled texts to become a feature.
MIN_TEXTS = 5
#: A word is evidence for grading if so many times likelier in toxic texts.
EVIDENCE_RATIO = 20.0
#: Grades above 1 begin at so many words of evidence.
GRADE_BORDERS = (4, 8)
SPARSITY = 3e-5
STEPS = 400
#: The fit ends when a step lowers the objective by a smaller share than this.
CONVERGED = 1e-7
#: Least distance of neighbouring thresholds.
APART = 0.05
#: Standard deviations by which a word's toxic share must differ from that of all texts.
DISTINCT = 4.0
#: A document is rejected if it is toxic (grade 1 or more) with so much probability.
REJECT = 0.5


@dataclass
class Model:
    """Sorted word hashes with a weight each, and ascending thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) for every document and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _no_model() -> Model:
    """Rejects nothing; for labels that hold one class only."""
    return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0]))


def _row_words(part: bs.Slice, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature hash, count) of the distinct words and stems of each row."""
    words = bs.find_words(part, kind=bs.LETTERS)
    values, length, rows = words.data.astype(np.uint64) + np.uint64(1), words.ends - words.starts, words.row_of()
    found = [(rows, words.hashes())]
    for stem in STEMS:
        longer = np.flatnonzero(length > stem)
        at = words.starts[longer]
        found.append((rows[longer], bs.mix(bs.spans_hash(values, at, at + stem), 100 + stem)))
    if only is not None:
        if not len(only):
            return rows[:0], np.zeros(0, np.uint64), rows[:0]
        for i, (r, h) in enumerate(found):
            keep = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
            found[i] = (r[keep], h[keep])
    row, hashes = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return row[first], hashes[first], np.diff(np.append(first, len(row)))


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names texts by their smallest run of five words, which near copies mostly share."""
    for batch in batches:
        for part in bs.slices(bs.lowered(batch.column("text")), SLICE):
            words = bs.find_words(part)
            starts, runs = bs.run_hashes(words, words.hashes(), 5)
            least = np.searchsorted(starts, words.rows)
            names = [
                str(int(runs[a:z].min())) if z > a else part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().hex()
                for i, (a, z) in enumerate(zip(least[:-1], least[1:], strict=True))
            ]
            rows = slice(part.first, part.first + part.rows)
            columns = {c: batch.column(c)[rows] for c in ("toxic", "text")}
            yield pa.RecordBatch.from_pydict({"alike": pa.array(names, pa.string()), **columns})


def _feature_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many clean and toxic texts of a batch each feature occurs."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic"))
        for part in bs.slices(bs.lowered(batch.column("text")), SLICE):
            row, hashes, _ = _row_words(part)
            names, place = np.unique(hashes, return_inverse=True)
            bad = np.bincount(place, toxic[part.first + row], minlength=len(names)).astype(np.int64)
            texts = np.bincount(place, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array(names.view(np.int64)), "texts": pa.array(texts), "bad": pa.array(bad)}
            )


def _counts_of(words: np.ndarray):
    """Mapper: each text's class and its packed places and counts of the chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(bs.lowered(batch.column("text")), SLICE):
                row, hashes, counts = _row_words(part, words)
                place = np.searchsorted(words, hashes).astype("<u4")
                borders = np.searchsorted(row, np.arange(part.rows + 1))
                spans = list(zip(borders[:-1], borders[1:], strict=True))
                few = np.minimum(counts, 255).astype("u1")
                yield pa.RecordBatch.from_pydict({
                    "toxic": batch.column("toxic")[part.first : part.first + part.rows],
                    "places": pa.array([place[a:z].tobytes() for a, z in spans], pa.binary()),
                    "counts": pa.array([few[a:z].tobytes() for a, z in spans], pa.binary()),
                })

    return run


def _spread(theta: np.ndarray) -> np.ndarray:
    """The thresholds, ascending with at least ``APART`` between neighbours."""
    steps = APART * np.arange(len(theta))
    return np.maximum.accumulate(theta - steps) + steps


def fit_ordinal(
    rows: np.ndarray,
    columns: np.ndarray,
    values: np.ndarray,
    grades: np.ndarray,
    width: int,
    share: np.ndarray | None = None,
    sparsity: float = SPARSITY,
    steps: int = STEPS,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model, by accelerated proximal gradient.

    rows, columns, values: the sparse feature matrix; grades: 0..top for each row; share: the
    rows' weights, 1 in all. A step is halved until the objective keeps below its quadratic
    bound, and momentum starts anew whenever the objective would rise, so it never does.
    """
    n, top = len(grades), int(grades.max(initial=0))
    share = np.full(n, 1 / n) if share is None else share
    each = np.arange(n)

    def smooth(w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = np.bincount(rows, values * w[columns], minlength=n)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -40, 40)))  # P(grade <= g)
        padded = np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1)
        low, high = padded[each, grades], padded[each, grades + 1]
        mass = np.maximum(high - low, 1e-12)
        # a grade's probability is a difference of neighbours; its gradient is theirs, shared by w
        up, down = share * high * (1 - high) / mass, share * low * (1 - low) / mass
        by_weight = np.bincount(columns, values * (up - down)[rows], minlength=width)
        at = np.bincount(grades, down, minlength=top + 1)[1:] - np.bincount(grades, up, minlength=top + 1)[:top]
        return float(-(share * np.log(mass)).sum()), by_weight, at

    known = np.array([share[grades <= g].sum() for g in range(top)])
    theta = _spread(np.log((known + 1e-3) / (1 - known + 1e-3)))
    w = np.zeros(width)
    # each feature's own scale: a diagonal bound of the curvature, up to one common factor
    total = np.bincount(rows, values, minlength=n) + 1
    scale = 2 / np.maximum(np.bincount(columns, values * (share * total)[rows], minlength=width), 1e-6)
    theta_scale = np.full(top, 2 / float((share * total).sum()))
    objective = lambda loss, w: loss + sparsity * np.abs(w).sum()
    now = objective(smooth(w, theta)[0], w)
    at_w, at_theta, pace, factor = w, theta, 1.0, 1.0
    for _ in range(steps):
        loss, by_weight, by_theta = smooth(at_w, at_theta)
        while True:
            raw = at_w - factor * scale * by_weight
            fresh = np.sign(raw) * np.maximum(np.abs(raw) - factor * scale * sparsity, 0)
            fresh_theta = _spread(at_theta - factor * theta_scale * by_theta)
            dw, dt = fresh - at_w, fresh_theta - at_theta
            bound = loss + by_weight @ dw + by_theta @ dt + ((dw**2 / scale).sum() + (dt**2 / theta_scale).sum()) / (2 * factor)
            reached = smooth(fresh, fresh_theta)[0]
            if reached <= bound + 1e-12 or factor < 1e-9:
                break
            factor /= 2
        then = objective(reached, fresh)
        if then > now:  # momentum went too far, or nothing is left to gain
            if pace == 1.0:
                break
            at_w, at_theta, pace = w, theta, 1.0
            continue
        swifter = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        lead = (pace - 1) / swifter
        at_w, at_theta = fresh + lead * (fresh - w), _spread(fresh_theta + lead * (fresh_theta - theta))
        ended = now - then < CONVERGED * max(then, 1e-9)
        w, theta, pace, now, factor = fresh, fresh_theta, swifter, then, factor * 1.1
        if ended:
            break
    return w, theta


def _sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """alike, toxic, text: sampled labelled documents, one of those that are alike; stored."""
    picked = None
    for toxic in (0, 1):
        some = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[toxic])
        picked = some if picked is None else picked.unionByName(some)
    text = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(picked), "doc_id").select("text", "toxic")  # sum(SAMPLE) ids
    named = rows.mapInArrow(bs.tidy(_likeness), "alike string, toxic int, text string")
    # ids may repeat with other texts, so the bound is set once more
    several = named.groupBy("alike", "toxic").agg(F.min("text").alias("text"))
    return stored(several.orderBy(F.xxhash64("alike"), "toxic").limit(sum(SAMPLE)), "sample")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most sum(SAMPLE) labelled documents (columns doc_id, text and doc_id, toxic).

    A document that is labelled several times is toxic if one of its labels says so. Labels of
    one class only, or none, give a model that rejects nothing.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    natural = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(natural) < 2:
        return _no_model()
    sample = _sample(docs, known)
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(size) < 2:
        return _no_model()
    texts = sum(size.values())
    share = size[1] / texts
    counted = sample.mapInArrow(bs.tidy(_feature_texts), "h long, texts long, bad long").groupBy("h").agg(
        F.sum("texts").alias("texts"), F.sum("bad").alias("bad")
    )
    z = F.abs(F.col("bad") - F.col("texts") * share) / F.sqrt(F.col("texts") * share * (1 - share))
    telling = counted.where(F.col("texts") >= MIN_TEXTS).withColumn("z", z).where(F.col("z") >= DISTINCT)
    chosen = telling.orderBy(F.desc("z"), "h").limit(FEATURES).select("h", "texts", "bad").toArrow()
    names = np.asarray(chosen.column("h").combine_chunks()).view(np.uint64)
    order = np.argsort(names)
    names = names[order]
    if not len(names):
        return _no_model()
    occurs, bad = (np.asarray(chosen.column(c).combine_chunks())[order] for c in ("texts", "bad"))
    rate = ((bad + 0.5) / (size[1] + 1)) / ((occurs - bad + 0.5) / (size[0] + 1))
    rows = sample.mapInArrow(bs.tidy(_counts_of(names)), "toxic int, places binary, counts binary").collect()  # sum(SAMPLE) rows at most
    rows.sort()  # equal sums whatever the order of tasks
    toxic = np.array([r.toxic for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r.counts) for r in rows])
    column = np.frombuffer(b"".join(bytes(r.places) for r in rows), "<u4").astype(np.int64)
    counts = np.frombuffer(b"".join(bytes(r.counts) for r in rows), "u1").astype(float)
    amount = np.bincount(row, counts * (rate >= EVIDENCE_RATIO)[column], minlength=len(rows))
    grades = np.where(toxic > 0, 1 + np.searchsorted(GRADE_BORDERS, amount, side="right"), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # grades that don't occur are closed up
    weight = np.array([natural[c] / sum(natural.values()) / size[c] for c in (0, 1)])[toxic]
    w, theta = fit_ordinal(row, column, np.log1p(counts), grades, len(names), weight)
    return Model(names[w != 0], w[w != 0], theta)


def _graded(text: pa.Array, model: Model) -> Iterator[tuple[bs.Slice, np.ndarray, np.ndarray]]:
    """(slice, P(grade > g) for each row and threshold, rejected) of a column of texts."""
    for part in bs.slices(bs.lowered(text), SLICE):
        row, hashes, counts = _row_words(part, model.words)
        score = np.zeros(part.rows)
        if len(row):
            score = np.bincount(
                row, np.log1p(counts) * model.weights[np.searchsorted(model.words, hashes)], minlength=part.rows
            )
        above = np.where(np.diff(part.offsets)[:, None] > 0, model.above(score), 0.0)
        # without a word that speaks for it nothing is rejected, whatever the thresholds are
        yield part, above, (above[:, 0] >= REJECT) & (score > 0)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, severity, p_toxic, rejected.

    severity is the expected grade (0 to the number of thresholds), p_toxic the probability of
    a grade over 0. ``docs`` needs doc_id and text; other columns are ignored. A null or empty
    text has no words and gets severity 0, p_toxic 0; a text without words of the model is
    never rejected; repeated rows and null ids stay; an empty table gives none. Whole texts
    are read, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, above, rejected in _graded(batch.column("text"), model):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(part.first, part.rows),
                    "severity": pa.array(above.sum(axis=1)),
                    "p_toxic": pa.array(above[:, 0].copy()),
                    "rejected": pa.array(rejected),
                })

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(bs.tidy(run), f"doc_id {kind}, severity double, p_toxic double, rejected boolean")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns as they are.

    Rows are graded and dropped in one map, so neither ids nor texts are joined: null and
    repeated ids, null texts and repeated rows are decided row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = np.concatenate([~rejected for _, _, rejected in _graded(batch.column("text"), model)])
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(bs.tidy(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents among docs and grade all of docs; see :func:`grade`."""
    return grade(docs, fit(docs, labels))
