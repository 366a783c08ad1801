"""Packing documents into sequences: best-two-fit over classes of equal length.

Pieces of one length are interchangeable, so packing needs only how many there are of each of
the ``CAPACITY`` lengths. The driver plans on that histogram (bounded by the capacity, whatever
the corpus): each pattern of lengths fills as many sequences as its rarest length allows. A
pattern starts with the longest waiting piece and greedily takes the longest that fits; then
its smallest piece is replaced by the two waiting pieces that fit the expanded gap most
tightly, while that leaves a smaller gap. Executors turn (length, rank among its like) into
(sequence, offset); ranks come from counts per task, so no length is dealt to one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .tokenfiles import chunk_encoder, default_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0


def cut_pieces(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, place (rank of its length in the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(path, spaced=False)
        tail = np.array([end], "<u4").tobytes()
        part, counts = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            which, piece, start, length, crc, place = [], [], [], [], [], []
            for r, text in enumerate(batch.column("text")):
                data = encode(text.as_py() or "") + tail
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    n = len(own) // 4
                    which.append(r)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    place.append(counts[n])
                    counts[n] += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(which, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "part": pa.array([part] * len(which), pa.int32()),
                    "place": pa.array(place, pa.int64())
                }
            )

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(first sequence, number of sequences, [(length, how many in each)]) for every pattern."""
    waiting = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        waiting[length] = n
    lengths = np.arange(capacity + 1)
    patterns, first = [], 0
    while waiting.any():
        spare, held, gap = waiting.copy(), {}, capacity
        while True:
            fitting = np.flatnonzero(spare[: gap + 1])
            if not len(fitting):
                break
            longest = int(fitting[-1])
            n = int(min(spare[longest], gap // longest))
            held[longest] = held.get(longest, 0) + n
            spare[longest] -= n
            gap -= n * longest
        while gap and sum(held.values()) > 1:
            smallest = min(held)
            room = gap + smallest
            below = np.maximum.accumulate(np.where(spare > 0, lengths, 0))  # longest waiting up to each length
            a = np.flatnonzero(spare[:room])
            b = below[np.minimum(room - a, a)]
            twin = (b == a) & (spare[a] < 2)
            b = np.where(twin, below[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            if not len(both) or both.max() <= smallest:
                break
            i = int(both.argmax())
            held[smallest] -= 1
            if not held[smallest]:
                del held[smallest]
            spare[smallest] += 1
            for x in (int(a[i]), int(b[i])):
                held[x] = held.get(x, 0) + 1
                spare[x] -= 1
            gap = room - int(both[i])
        times = min(int(waiting[x]) // n for x, n in held.items())
        for x, n in held.items():
            waiting[x] -= n * times
        patterns.append((first, times, sorted(held.items(), reverse=True)))
        first += times
    return patterns


def _places(patterns: list) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go: keys (length << 44 | first rank), sorted, and columns."""
    used: dict[int, int] = {}
    rows = []
    for first, times, items in patterns:
        offset = 0
        for length, n in items:
            rank = used.get(length, 0)
            rows.append((length << 44 | rank, rank, first, n, offset))
            used[length] = rank + n * times
            offset += n * length
    rows.sort()
    return tuple(
        np.array(c, np.int64) for c in zip(*rows, strict=True)
    ) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are ignored. A document's ids are the
    library's for its whole text, then ``end``; only documents over ``capacity`` are cut. A
    null or empty text is one piece of one id; null ids and repeated rows are packed as they
    come; an empty table gives none. Sequences count from 0 and are filled from offset 0
    without gaps.
    """
    pieces = stored(cut_pieces(docs, path or default_path(VOCABULARY), capacity, end), "pieces")
    counts = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    keys, ranks, firsts, manys, offsets = _places(plan(histogram, capacity))
    before = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ).select("length", "part", "before")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            after = rank - ranks[at]
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {
                    "sequence_id": pa.array(firsts[at] + after // manys[at]),
                    "offset": pa.array(offsets[at] + after % manys[at] * length)
                }
            )

    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("place") + F.col("before"))
    kind = dict(pieces.dtypes)["doc_id"]
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        assign, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
