"""Language identification in two steps: the family, then one-versus-one machines within it.

Features are the shares of hashed byte trigrams of the lower-cased words (each between two
spaces), square roots taken and scaled to length one. A family is chosen by one-versus-rest
linear support vector machines; within a family every pair of languages has its own machine,
and the language with most votes wins (ties: the larger sum of margins, then the name). The
machines are fitted on the driver from at most ``SAMPLE`` documents of each language; the
prediction is a map over whole texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs

#: Documents of each language that the fit may use, by hash of their id.
SAMPLE = 400
WIDTH = 4096
PENALTY = 1e-4
STEPS = 100
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code; another code is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


#: Rows whose features are held at once: their dense counts take 32 MB.
ROWS = 1024


def family_of(lang: str) -> str:
    return next((name for name, own in FAMILIES.items() if lang.lower() in own), lang)


def features(part: bs.Slice) -> np.ndarray:
    """A row of WIDTH features for each row of the slice."""
    data = part.data
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    data = np.where(bs.LETTERS[data], data, 32).astype(np.uint32)
    row = np.repeat(np.arange(part.rows), np.diff(part.offsets))
    n = len(data)
    if n < 3:
        return np.zeros((part.rows, WIDTH), np.float32)
    one, two, three = data[:-2], data[1:-1], data[2:]
    whole = (row[:-2] == row[2:]) & (two != 32)
    code = (one | two << 8 | three << 16)[whole]
    with np.errstate(over="ignore"):
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)  # 12 bits
    counts = np.bincount(row[:-2][whole] * WIDTH + slot, minlength=part.rows * WIDTH).reshape(part.rows, WIDTH)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge loss; y is +1 or -1."""
    w = seen = last = np.zeros(x.shape[1] + 1, np.float32)
    pace = 1.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ seen[:-1] + seen[-1]))
        pull = -2 * weight * y * slack
        gradient = np.append(x.T @ pull, pull.sum()) + penalty * seen
        fresh = seen - gradient / 4
        swifter = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        seen = fresh + (pace - 1) / swifter * (fresh - last)
        w, last, pace = fresh, fresh, swifter
    return w.astype(np.float32)


@dataclass
class Model:
    """Languages by family; weights of the family machines and of the pairs."""

    families: list[str]
    languages: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score in (0, 1)) for each row of features."""
        chance = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -10, 10)))
        margins = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
        best = margins.argmax(axis=1)
        if len(self.families) == 1:
            certain = np.ones(len(x))
        else:
            certain = chance(margins[np.arange(len(x)), best])
        names, score = np.empty(len(x), object), np.zeros(len(x))
        for f, family in enumerate(self.families):
            at = np.flatnonzero(best == f)
            own = self.languages[family]
            votes, sums = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)))
            for i, j in combinations(range(len(own)), 2):
                w = self.pairs[own[i], own[j]]
                m = x[at] @ w[:-1] + w[-1]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
            # votes first, then margins; names are sorted, so the first of equals wins
            top = (votes * 1e6 + np.clip(sums, -1e5, 1e5)).argmax(axis=1) if len(at) else np.zeros(0, int)
            names[at] = np.array(own, object)[top]
            inner = chance(sums[np.arange(len(at)), top] / max(1, len(own) - 1)) if len(own) > 1 else 1.0
            score[at] = certain[at] * inner
        return names, score


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on rows with doc_id, text and lang, none of them null; None without any."""
    known = labelled.where("text is not null and lang is not null and length(text) > 0")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = known.select(
        "lang", "doc_id", F.xxhash64("doc_id").alias("h")
    ).withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang").distinct()
    chosen = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")  # sample ids a language
    again = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    chosen = chosen.withColumn("rank", again).where(F.col("rank") <= sample).select("lang", "text")  # ids may repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch.column("text"), rows=ROWS):
                x = features(part).astype(np.float16)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": batch.column("lang").slice(part.first, part.rows),
                        "x": pa.array([r.tobytes() for r in x], pa.binary())
                    }
                )

    rows = chosen.mapInArrow(run, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    lang = np.array([r.lang for r in rows], object)
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float16).reshape(len(rows), WIDTH).astype(np.float32)
    del rows
    names = sorted(set(lang))
    family = np.array([family_of(v) for v in lang], object)
    families = sorted(set(family))
    languages = {f: [v for v in names if family_of(v) == f] for f in families}
    sign = lambda yes: np.where(yes, 1.0, -1.0).astype(np.float32)
    outer = np.stack([fit_svm(x, sign(family == f)) for f in families])
    pairs = {}
    for own in languages.values():
        for a, b in combinations(own, 2):
            use = (lang == a) | (lang == b)
            pairs[a, b] = fit_svm(x[use], sign(lang[use] == a))
    return Model(families, languages, outer, pairs)


def _has_letter(part: bs.Slice) -> np.ndarray:
    ascii_letter = np.zeros(len(part.data) + 1, np.int64)
    lower = part.data | 32
    np.cumsum((lower >= 97) & (lower <= 122), out=ascii_letter[1:])
    found = ascii_letter[part.offsets[1:]] > ascii_letter[part.offsets[:-1]]
    for r in np.flatnonzero(~found & (np.diff(part.offsets) > 0)).tolist():
        text = part.data[part.offsets[r] : part.offsets[r + 1]].tobytes().decode("utf-8", "replace")
        found[r] = any(unicodedata.category(c)[0] == "L" for c in text)
    return found


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch.column("text"), rows=ROWS):
                letters = _has_letter(part)
                names, score = np.full(part.rows, UNKNOWN, object), np.zeros(part.rows)
                at = np.flatnonzero(letters)
                if model is not None and len(at):
                    some = model.predict(features(part)[at])
                    names[at], score[at] = some
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(part.first, part.rows),
                        "held_out": batch.column("held_out").slice(part.first, part.rows),
                        "lang_pred": pa.array(names.tolist(), pa.string()),
                        "score": pa.array(score)
                    }
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (0 to 1).

    ``docs`` needs doc_id, text and lang; other columns are ignored. Documents with
    crc32(doc_id as text) mod 3 = 1 are held out: they are predicted and never learned from
    (a null doc_id counts as the empty text, remainder 0). Only text and lang are learned
    from, only text is predicted from. A text that is null or without a letter is ``und``
    with score 0, as is every text if there is nothing to learn from. Ties between languages
    go to the larger margin, then to the name; repeated rows stay; an empty table gives none.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    slim = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out")
    )
    return predict(slim, fit(slim.where(~F.col("held_out")).select("doc_id", "text", "lang")))
