"""Whole-column text scanning with numpy, on the bytes of an Arrow column.

A task never turns words into Python objects: it views the UTF-8 bytes of a slice of rows,
finds word borders (the six ASCII white-space bytes, which never occur inside a multi-byte
character) and hashes every word and every run of k words with prefix sums modulo 2**64.
Slices hold about ``SLICE_BYTES`` of text, so memory per task is bounded whatever the batch;
one longer text makes a slice by itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_libc = ctypes.CDLL(None)


def release() -> None:
    """Give memory that is free in this process back to the system.

    Spark keeps idle Python workers; what their allocators hold on to counts for the executor.
    """
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A mapper over batches that releases memory when it ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def tidy_group(reduce: Callable) -> Callable:
    """A reducer of a group's table that releases memory when it ends."""

    def tidied(table: pa.Table) -> pa.Table:
        out = reduce(table)
        release()
        return out

    return tidied


_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_CHAIN = _U(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit scrambling (the public splitmix64 finaliser), after adding a salt."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and the inverses, modulo 2**64 (base is odd); kept for the next slice."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        size = 1 << (size - 1).bit_length()
        inverse = pow(int(base), -1, 1 << 64)
        with np.errstate(over="ignore"):
            tables = []
            for factor in (base, _U(inverse)):
                row = np.full(size, factor, _U)
                row[0] = 1
                tables.append(np.cumprod(row, dtype=_U))
            up, down = tables
        have = (up, down)
        if size <= 1 << 23:  # tables for one giant text are not kept
            _powers[int(base)] = have
    return have


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Unmixed polynomial hash of values[s:e] for each span; values are uint64."""
    n = len(values)
    up, down = powers(base, n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(values * up[:n], out=total[1:])
        return (total[ends] - total[starts]) * down[starts]


@dataclass
class Slice:
    """Some consecutive rows of a column: bytes, and row borders in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def lowered(column: pa.Array) -> pa.Array:
    """A string column in lower case, letters of all alphabets."""
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[Slice]:
    """Consecutive rows of at most limit bytes and so many rows; one longer text is alone."""
    data, offsets = column_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """The words of a slice, in order; row r has words [rows[r], rows[r + 1])."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64-bit hash of each word; depends on its bytes only."""
        raw = spans_hash(self.data.astype(_U) + _U(1), self.starts, self.ends)
        return mix(raw ^ (self.ends - self.starts).astype(_U), salt)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


#: Bytes that belong to words: all but ASCII white space; letters, digits and multi-byte characters.
VISIBLE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def find_words(part: Slice, lower: bool = False, kind: np.ndarray = VISIBLE) -> Words:
    """Maximal runs of bytes of a kind in each row; lower: A-Z become a-z first.

    VISIBLE gives the words [^\\x20\\x09-\\x0D]+.
    """
    data = part.data
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    border = part.offsets[1:-1]
    border = border[border < len(data)]
    begins[border] = inside[border]  # a row's first byte starts a word whatever stands before it
    starts = np.flatnonzero(begins)
    last = inside[:-1] & ~inside[1:]
    tail = border[border > 0] - 1
    last[tail] = inside[tail]
    ends = np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, part.offsets))


def run_hashes(words: Words, hashes: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k consecutive words that lies within one row."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    inside = np.ones(n, bool)
    inside[n - k + 1 :] = False
    for back in range(1, k):  # the last k - 1 words of a row start no run
        at = words.rows[1:] - back
        inside[at[at >= words.rows[:-1]]] = False
    starts = np.flatnonzero(inside)
    return starts, mix(spans_hash(hashes, starts, starts + k, _CHAIN), salt + k)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct uint32 as differences, byte planes apart, compressed."""
    import zstandard

    gaps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def split_sorted(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted uint64 keys: (32-bit remainders, bucket numbers with keys, borders).

    A bucket is a range of keys. The remainder is the 32 bits below the bucket's share, so
    bucket and remainder together tell log2(buckets) + 32 bits of the key.
    """
    count = _U(buckets)  # below 2**31, so nothing overflows
    scaled = (keys >> _U(32)) * count + (((keys & _U(0xFFFFFFFF)) * count) >> _U(32))
    bucket = (scaled >> _U(32)).astype(np.int64)
    number, first = np.unique(bucket, return_index=True)
    return (scaled & _U(0xFFFFFFFF)).astype(np.uint32), number, np.append(first, len(keys))
