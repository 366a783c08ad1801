"""Token counts by byte-pair merging with a heap and a linked list.

A word starts as a list of symbols. All adjacent pairs that the vocabulary can merge wait in a
heap by (rank, place); the lowest is popped again and again, its two symbols become one, and
the pairs with its neighbours join the heap. Pairs whose symbols have changed meanwhile are
skipped. Only the number of merges is kept: tokens = first symbols - merges. No identifiers
are made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenfiles import REMEMBERED, default_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
_counters: dict[str, Callable[[str], int]] = {}


def merge_count(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """How many merges a word's symbols allow, lowest rank first, leftmost on ties.

    symbols: vocabulary numbers. ranks: of left << 32 | right. made: number of each rank's result.
    """
    n, rank_of = len(symbols), ranks.get
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    current = [rank_of(a << 32 | b, -1) for a, b in pairwise(symbols)]
    current.append(-1)
    heap = [rank << 32 | i for i, rank in enumerate(current) if rank >= 0]
    heapify(heap)
    merges = 0
    while heap:
        top = heappop(heap)
        i, rank = top & 0xFFFFFFFF, top >> 32
        if current[i] != rank:
            continue  # the pair that waited here is gone
        j = after[i]
        right, left = after[j], before[i]
        symbols[i] = new = made[rank]
        after[i] = right
        current[j] = -1
        merges += 1
        if right < n:
            before[right] = i
            current[i] = rank = rank_of(new << 32 | symbols[right], -1)
            if rank >= 0:
                heappush(heap, rank << 32 | i)
        else:
            current[i] = -1
        if left >= 0:
            current[left] = rank = rank_of(symbols[left] << 32 | new, -1)
            if rank >= 0:
                heappush(heap, rank << 32 | left)
    return merges


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies, by its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def counter(path: str) -> Callable[[str], int]:
    """text -> number of tokens, for a file with words cut by a pattern and a word-end mark.

    The file's own normaliser steps (NFC, white space, lower case), split pattern and special
    tokens are followed as its library does.
    """
    if path in _counters:
        return _counters[path]
    import unicodedata

    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocabulary = model["vocab"]
    ranks = {vocabulary[a] << 32 | vocabulary[b]: i for i, (a, b) in enumerate(model["merges"])}
    made = [vocabulary[a + b] for a, b in model["merges"]]
    suffix = model["end_of_word_suffix"]
    pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    special = [t["content"] for t in spec["added_tokens"]]
    marks = re.compile("|".join(map(re.escape, special)))
    letters = byte_letters()
    inner, last = [vocabulary.get(x) for x in letters], [vocabulary.get(x + suffix) for x in letters]

    def word(text: str) -> int:
        data = text.encode()
        symbols = [inner[b] for b in data[:-1]]
        symbols.append(last[data[-1]])
        if None in symbols:  # without an unknown token, symbols outside the vocabulary vanish
            symbols = [x for x in symbols if x is not None]
        return len(symbols) - merge_count(symbols, ranks, made)

    words: dict[str, int] = {}
    chunks: dict[str, int] = {}

    def chunk(text: str) -> int:
        if text.isascii():
            text = text.lower()
        else:  # letter by letter: a letter's neighbours have no say
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        total = 0
        for w in pieces.findall(text):
            if w not in words:
                if len(words) > REMEMBERED:
                    words.clear()
                words[w] = word(w)
            total += words[w]
        return total

    separate = re.compile(r"[^ \t\n\r\x0b\x0c]+").findall

    def plain(text: str) -> int:
        found = separate(text)
        counts = list(map(chunks.get, found))
        if None in counts:
            if len(chunks) > REMEMBERED:
                chunks.clear()
            for i, n in enumerate(counts):
                if n is None:
                    counts[i] = chunk(found[i])
                    if len(found[i]) <= 64:
                        chunks[found[i]] = counts[i]
        return sum(counts)

    def count(text: str) -> int:
        if "<|" not in text:
            return plain(text)
        parts = marks.split(text)
        return sum(map(plain, parts)) + len(parts) - 1

    _counters[path] = count
    return count


def _rows(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        sizes, tokens = [], []
        for x in batch.column("text"):
            text = x.as_py() or ""
            sizes.append(len(text.encode()))
            tokens.append(count(text))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_())
            }
        )


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A map over rows, without an exchange; ``docs`` needs doc_id and text, other columns are
    ignored. Counts equal those of the vocabulary's library for the whole text, without begin
    or end tokens. A null or empty text has 0 of both; null ids and repeated rows stay as they
    are; an empty table gives none.
    """
    path = path or default_path(VOCABULARY)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(
        partial(_rows, path=path, limit=limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
