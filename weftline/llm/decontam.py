"""Benchmark decontamination by spaced seeds.

A fixed mask looks at some of the words of a span and ignores the others, so a passage whose
words were partly replaced still gives equal hashes. Every span of every document is looked up
among the spans of the benchmark, for each mask; a hit tells where document and item may be
laid over each other, and the overlap around it is compared word by word. Benchmark hashes are
held in memory in blocks of a bounded size; a larger benchmark takes several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs

#: Masks of words in a row: 1 looks at the word, 0 ignores it.
MASKS = ("11010011", "1110101", "1011000101")
#: A stretch counts with so many equal words, a whole overlap with this share of an item's words.
LEAST_WORDS = 12
LEAST_SHARE = 0.8
#: What a replaced word costs in a stretch's score (an equal one gives 1): one in four is allowed.
REPLACED = 3
#: Words of benchmark items held at once.
BLOCK_WORDS = 1_000_000


@dataclass
class Index:
    """Words of some items, and their masked spans sorted by hash."""

    ids: list
    words: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    likely: np.ndarray


def _spans(hashes: np.ndarray, rows: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the masked spans within rows."""
    n, width = len(hashes), len(mask)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n - width + 1 + i]
    inside = np.ones(n - width + 1, bool)
    for back in range(1, width):
        at = rows[1:] - back
        at = at[(at >= rows[:-1]) & (at < len(inside))]
        inside[at] = False
    starts = np.flatnonzero(inside)
    return starts, bs.mix(total[starts], salt)


def build_index(items: list[tuple[object, str]]) -> Index:
    part = next(bs.slices(bs.lowered(pa.array([text for _, text in items], pa.large_string())), 1 << 62))
    words = bs.find_words(part, kind=bs.LETTERS)
    hashes = words.hashes()
    found = [_spans(hashes, words.rows, mask, i) for i, mask in enumerate(MASKS)]
    places, keys = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(keys, kind="stable")
    likely = np.zeros(1 << 22, bool)
    likely[(keys >> np.uint64(42)).astype(np.int64)] = True
    return Index([i for i, _ in items], hashes, words.rows, keys[order], places[order], likely)


def _best(equal: np.ndarray) -> tuple[int, int]:
    """[begin, end) of the stretch with most equal words among those of score 0 or more."""
    score = np.append(0, np.cumsum(np.where(equal, 1, -REPLACED)))
    same = np.append(0, np.cumsum(equal))
    # for each end the earliest begin from which the score doesn't fall
    begin = np.searchsorted(-np.minimum.accumulate(score), -score)
    end = int((same - same[begin]).argmax())
    return _trimmed(equal, int(begin[end]), end)


def _trimmed(equal: np.ndarray, begin: int, end: int) -> tuple[int, int]:
    """The stretch from its first equal word to its last one."""
    at = np.flatnonzero(equal[begin:end])
    return (begin + int(at[0]), begin + int(at[-1]) + 1) if len(at) else (begin, begin)


def search(part: bs.Slice, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, first document word, first item word, length, equal words) of each overlap."""
    words = bs.find_words(part, kind=bs.LETTERS)
    hashes = words.hashes()
    hits = []
    for i, mask in enumerate(MASKS):
        starts, keys = _spans(hashes, words.rows, mask, i)
        maybe = index.likely[(keys >> np.uint64(42)).astype(np.int64)]
        starts, keys = starts[maybe], keys[maybe]
        first, last = np.searchsorted(index.hashes, keys), np.searchsorted(index.hashes, keys, side="right")
        many = last - first
        at = np.repeat(starts, many)
        place = index.places[np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        hits.append(
            np.stack(
                [
                    np.searchsorted(words.rows, at, side="right") - 1,
                    np.searchsorted(index.rows, place, side="right") - 1,
                    at - place
                ],
                axis=1
            )
        )
    out = []
    for row, item, shift in np.unique(np.concatenate(hits), axis=0).tolist():
        a, z = int(index.rows[item]), int(index.rows[item + 1])
        low, high = max(a, int(words.rows[row]) - shift), min(z, int(words.rows[row + 1]) - shift)
        equal = index.words[low:high] == hashes[low + shift : high + shift]
        whole = equal.sum() >= LEAST_SHARE * (z - a)
        begin, end = _trimmed(equal, 0, len(equal)) if whole else _best(equal)
        same = int(equal[begin:end].sum())
        if whole or same >= LEAST_WORDS:
            out.append((row, item, low + begin + shift - int(words.rows[row]), low + begin - a, end - begin, same))
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, on the driver."""
    slim = benchmark.where("text is not null and item_id is not null").select(
        "item_id", F.col("text").cast("string").alias("text")
    )
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (4 * block_words)))
    for i in range(n):
        rows = slim.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).distinct().orderBy("item_id", "text").collect()
        if rows:
            yield [(r.item_id, r.text) for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per overlap: doc_id, item_id, doc_word, item_word, n_words, n_equal.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored.
    Words are runs of letters and digits, lower case. An overlap lays a document and an item
    over each other without gaps. It counts if ``LEAST_SHARE`` of the item's words are equal in
    all of it, or at least ``LEAST_WORDS`` in a stretch with at most one replaced word in four.
    ``n_words`` words from word ``doc_word`` and ``item_word`` on are its stretch, from the first
    to the last equal word. An overlap that no mask hits isn't found.
    Null and empty texts overlap with nothing, nor do items shorter than every mask; repeated
    rows of docs give repeated overlaps, repeated items count once; an empty table gives none.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, doc_word int, item_word int, n_words int, n_equal int"

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in bs.slices(bs.lowered(batch.column("text"))):
                    found = search(part, index)
                    column = lambda i, t: pa.array([x[i] for x in found], t)  # noqa: E731, B023
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch.column("doc_id").take(pa.array([part.first + x[0] for x in found], pa.int64())),
                            "item_id": pa.array([index.ids[x[1]] for x in found], pa.int64()),
                            "doc_word": column(2, pa.int32()),
                            "item_word": column(3, pa.int32()),
                            "n_words": column(4, pa.int32()),
                            "n_equal": column(5, pa.int32())
                        }
                    )

        return run

    passes = [slim.mapInArrow(bs.tidy(finder(build_index(items))), schema) for items in _blocks(benchmark, block_words)]
    return reduce(DataFrame.unionByName, passes) if passes else slim.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that overlap with no item, with all their columns as they are.

    Overlaps are those of :func:`contaminated`; rows are searched and dropped in one map for
    each block of items, so null and repeated ids decide nothing.
    """

    def keeper(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for part in bs.slices(bs.lowered(batch.column("text"))):
                    keep[[part.first + x[0] for x in search(part, index)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for items in _blocks(benchmark, block_words):
        docs = docs.mapInArrow(bs.tidy(keeper(build_index(items))), docs.schema)
    return docs
