"""Spelling variants: words one edit apart, each led to the commonest of its neighbours.

Words that differ by one inserted, deleted or replaced code point agree but for one place, so they
agree outside of one short segment of the shorter word. A block is all words that agree outside of
one segment (and in the length of the shorter); the words of a block form a padded code-point
matrix, written once from the left and once from the right, and tiles of it are compared pair by
pair: the length of the common prefix plus that of the common suffix reaches the longer length
less one just for single edits. The segment in which the edit's first possible place lies counts
the pair, so that each pair counts once.

Segments are two code points wide in words of up to 64, so a block has at most 90^2 words of one
length and 90^3 of the next (there are 90 letters once A-Z are lower-cased), however large the
vocabulary; real blocks have a few. A longer word has 32 segments.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .storage import stored

#: Words of fewer code points are left out.
LEAST_LENGTH = 7
#: And words that occur less often.
LEAST_COUNT = 2
#: A form is so many times as common as its word, at least.
TIMES = 10
#: One run in so many has a code point deleted.
DAMAGED = 31
#: Width of a segment, and the most segments of a word.
WIDTH, SEGMENTS = 2, 32
#: Words that a task counts before it passes their counts on.
HELD_WORDS = 400_000
#: Cells of a tile (pairs times padded length).
CELLS = 4 << 20

_LONG_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def lowered(text: str) -> str:
    """A-Z in lower case, all else unchanged."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def damaged(run: str, key: int) -> str:
    """The run, less one code point if the key (a hash of document and run) says so."""
    if key % DAMAGED:
        return run
    at = key % len(run)
    return run[:at] + run[at + 1 :]


def words_of(doc_id: int | None, text: str) -> Counter[str]:
    """How often each word of a document occurs; those that are too short needn't all be there."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter[str] = Counter()
    for run, n in Counter(_LONG_RUNS.findall(lowered(text))).items():
        found[damaged(run, zlib.crc32(run.encode(), start))] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        rows = [(w, n) for w, n in held.items() if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_pydict(
            {"word": pa.array([w for w, _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())}
        )

    for part in batches:
        for doc_id, text in zip(part.column("doc_id"), part.column("text"), strict=True):
            text = text.as_py()
            if text:
                held.update(words_of(doc_id.as_py(), text))
                if len(held) > HELD_WORDS:
                    yield batch()
                    held.clear()
    if held:
        yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of doc_id and text with their occurrences, summed in each task first."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = slim.mapInArrow(bs.tidy(_counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def placed(words: DataFrame) -> DataFrame:
    """A row for each block that a word is in: key, size, part, longer, low, high, word, n.

    ``size`` is the shorter length of the block's pairs, ``longer`` whether the word has one code
    point more, and [low, high) the segment of the shorter word outside of which words agree.
    """
    sized = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
    sized = sized.withColumn("size", F.length("word") - F.col("longer")).where(F.col("size") >= LEAST_LENGTH)
    parts = F.least(F.ceil(F.col("size") / WIDTH).cast("int"), F.lit(SEGMENTS))
    cut = sized.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    border = "cast(cast(size as long) * (part + {}) div parts as int)"
    cut = cut.withColumn("low", F.expr(border.format(0))).withColumn("high", F.expr(border.format(1)))
    key = F.expr("xxhash64(size, part, substring(word, 1, low), substring(word, high + 1 + longer))")
    return cut.select(key.alias("key"), "size", "part", "longer", "low", "high", "word", "n")


def single_edits(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether one edit apart, length of the common prefix) for pairs of distinct rows a and b.

    ``left`` and ``right`` are the words' code points, padded with zeros at the end and at the
    beginning; b is at least as long as a.
    """
    prefix = np.argmin(left[a] == left[b], axis=1)
    suffix = np.argmin(right[a][:, ::-1] == right[b][:, ::-1], axis=1)
    gap = lengths[b] - lengths[a]
    return (gap <= 1) & (prefix + suffix >= lengths[b] - 1), prefix


def _matrices(words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = int(lengths.max()) + 1
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    column = np.arange(width)
    left[column < lengths[:, None]] = flat
    right[column >= width - lengths[:, None]] = flat
    return left, right


def _tiled(rows: dict[str, np.ndarray], words: list[str]) -> pa.RecordBatch:
    """Near words within whole blocks: word, n_near, and the best of them (n, form) for each row."""
    lengths, longer = rows["size"] + rows["longer"], rows["longer"]
    left, right = _matrices(words, lengths)
    count = len(words)
    new = np.ones(count, bool)
    new[1:] = (np.diff(rows["key"]) != 0) | (np.diff(rows["size"]) != 0) | (np.diff(rows["part"]) != 0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], count)[np.cumsum(new) - 1]
    # a word meets those after it in its block; those of the shorter length stand first
    meets = np.where(longer == 0, ends - np.arange(count) - 1, 0)
    total = np.concatenate([[0], np.cumsum(meets)])
    step = max(1, CELLS // left.shape[1])
    found = []
    for first in range(0, int(total[-1]), step):
        pair = np.arange(first, min(first + step, int(total[-1])))
        a = np.searchsorted(total, pair, side="right") - 1
        b = a + 1 + pair - total[a]
        near, prefix = single_edits(left, right, lengths, a, b)
        place = np.minimum(prefix, rows["size"][a] - 1)
        near &= (rows["low"][a] <= place) & (place < rows["high"][a])
        found.append(np.stack([a[near], b[near]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    own, other = np.concatenate([pairs, pairs[::-1]], axis=1)
    text = left.view(f"S{left.shape[1]}").ravel()
    order = np.lexsort((text[other], -rows["n"][other], own))
    own, other = own[order], other[order]
    own, at, n_near = np.unique(own, return_index=True, return_counts=True)
    best = other[at]
    return pa.RecordBatch.from_pydict(
        {
            "word": pa.array([words[i] for i in own.tolist()], pa.string()),
            "n_near": pa.array(n_near, pa.int64()),
            "less": pa.array(-rows["n"][best], pa.int64()),
            "near": pa.array([words[i] for i in best.tolist()], pa.string()),
        }
    )


_NUMBERS = ("key", "size", "part", "longer", "low", "high", "n")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks from rows in the order of blocks, in slices of bounded size.

    A block that goes on in the next batch waits for it.
    """
    held: pa.Table | None = None

    def slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {name: table.column(name).to_numpy().astype(np.int64) for name in _NUMBERS}
        new = np.flatnonzero((np.diff(rows["key"]) != 0) | (np.diff(rows["size"]) != 0) | (np.diff(rows["part"]) != 0)) + 1
        ends = np.append(new, len(rows["key"]))
        words, at = table.column("word").to_pylist(), 0
        while at < len(words):
            room = max(1, CELLS // int(rows["size"][at] + 2))  # longer blocks come later
            to = int(ends[max(np.searchsorted(ends, at + room, side="right") - 1, np.searchsorted(ends, at, side="right"))])
            yield _tiled({k: v[at:to] for k, v in rows.items()}, words[at:to])
            at = to

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = [table.column(c)[-1].as_py() for c in ("size", "part", "key")]
        same = np.ones(table.num_rows, bool)
        for name, value in zip(("size", "part", "key"), last, strict=True):
            same &= table.column(name).to_numpy() == value
        border = int(np.argmax(same))
        if border:
            yield from slices(table.slice(0, border))
        held = table.slice(border)
    if held is not None:
        yield from slices(held)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, near, near_n: how many words are near a word, and the commonest of them.

    Of equally common ones it is the smallest in code-point order. Words with none are left out.
    """
    blocks = placed(words).repartition("size", "part", "key").sortWithinPartitions("size", "part", "key", "longer")
    found = blocks.mapInArrow(bs.tidy(_blocks), "word string, n_near long, less long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root (string), n, n_near, form_n (long).

    ``docs`` needs doc_id and text, other columns are ignored. Words come from whole texts as
    :func:`words_of` says, a null text has none, a null doc_id counts as the empty text in the
    hash, and repeated rows count each. ``form`` is the near word of largest n (the smallest of
    ties) if that is at least TIMES n, else null, and form_n its n; ``root`` is where forms lead
    from the word, itself if it has none. An empty table gives no row.

    Along forms n grows by TIMES each step, so the way to a root is shorter than the logarithm of
    the largest n, and doubling the steps reaches it in a few joins of the words with a form.
    """
    words = stored(vocabulary(docs), "words")
    near = neighbours(words)
    common = F.col("near_n") >= TIMES * F.col("n")
    found = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(common, F.col("near")).alias("form"),
            F.when(common, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    steps = 1 + int(math.log(max(most, 1), TIMES))
    way = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
