"""Language-model scores by logistic mixing of hashed-context bit predictors.

The running text is coded byte by byte: its lower-cased words, each with a space after it, and
one end mark. A byte is coded bit by bit along a prefix code in which common bytes are short
(some four bits for each byte of prose), so fewer bits need predicting. Predictors of several
contexts (last 1 to 4 bytes whatever words they belong to, all of the word so far, that and the
previous word) look up how often the next bit was 0 or 1 in the training texts, in hashed tables
of a fixed size. Their stretched probabilities are added with weights that a gate chooses (place
in the word, place in the code, how often the word so far was seen), squashed, and refined by an
adaptive map of (gate, probability) to what really followed. The total code length is the score.

Equal bytes of a block that follow the same word so far and the same four bytes are of one kind:
all tables but that of the previous word say the same of them, so these are looked up, counted
and added up once for each kind, with the same results as byte by byte.

Word counts, the byte code, the predictors' counts, the weights and the adaptive map cover all
training documents. The weights are learned in ``STEPS``: each step sums gradient, curvature and
hits over its share of the documents, task by task, with each bit's own occurrence taken out of
the counts; every document has its turn once. All that executors receive has a fixed size: the
tables, and the ``DICTIONARY`` commonest words for the unigram base, whose other words are
counted by a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .storage import stored

#: log2 of the slots of each context's table: last 1, 2, 3, 4 bytes, previous word and word so
#: far, word so far. The first is exact, the others are hashed.
TABLES = (16, 20, 21, 22, 22, 22)
#: The table of the previous word and the word so far; what the others say is told by fewer bytes.
PAIR = 4
_ALONE = tuple(k for k in range(len(TABLES)) if k != PAIR)
#: Last bytes of the longest context of bytes.
_NEAR = 4
#: Commonest words held in memory for the base; the others are joined.
DICTIONARY = 1 << 20
#: Shares of the training documents (parts of 16, by hash of the text) of the learning steps, and
#: what older steps' curvature still counts.
STEPS, MEMORY = ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16)), 0.5
#: Bytes of text whose contexts are held at once, and bytes coded in one go.
TEXT_BYTES, BLOCK = 1_000_000, 1 << 20
#: Kinds of bits after which a step's sums by gate are taken.
KINDS = 1 << 18
FLUSH = 4_000_000
CHUNK = 1 << 16
END = b"\n"
GATES, LEVELS = 512, 33
WIDTH = len(TABLES) + 1
#: Predictions, the constant among them, that are the same for all bits of a kind.
_OWN = [*_ALONE, WIDTH - 1]
#: Sightings of the word so far at which the next gate begins.
SURE = (1, 3, 8, 32, 128, 512, 4096)
_SURE = np.searchsorted(SURE, np.arange(SURE[-1] + 1), side="right")
#: Share of the adaptive map in the final probability.
REFINED = 0.15
_U = np.uint64
_MULTIPLIER = _U(0xD6E8FEB86659FD93)
#: What a node of the byte code adds to a context hash.
_NODES = np.arange(256, dtype=_U) * _U(0x9E3779B97F4A7C15)
_OFFSETS = np.append(0, np.cumsum([1 << size for size in TABLES]))
#: log(count + 0.4), for stretched probabilities.
_LOG = np.log(np.arange(1 << 16) + 0.4).astype(np.float32)


def flat_words(words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of words data[starts:ends], a space after each; borders)."""
    data, starts, ends = words
    length = ends - starts
    borders = np.append(0, np.cumsum(length + 1))
    out = np.full(int(borders[-1]), 32, np.uint8)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(borders[:-1], length) + place] = data[np.repeat(starts, length) + place]
    return out, borders


def running_text(words: bs.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the rows' words, a space after each, an end mark after each row; row borders)."""
    data, borders = flat_words((words.data, words.starts, words.ends))
    rows = borders[words.rows]
    return np.insert(data, rows[1:], END[0]), rows + np.arange(len(rows))


@dataclass
class Code:
    """A complete prefix code of bytes: the nodes and bits of each byte, end to end."""

    starts: np.ndarray
    lengths: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def byte_code(counts: np.ndarray) -> Code:
    """The Huffman code for counts of the 256 bytes, each counted once more; ties by byte."""
    heap = [(int(n) + 1, i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    children = {}
    while len(heap) > 1:
        (m, _, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        node = 256 + len(children)
        children[node] = (a, b)
        heapq.heappush(heap, (m + n, node, node))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    open_nodes: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
    while open_nodes:
        node, path = open_nodes.pop()
        if node < 256:
            paths[node] = path
        else:
            open_nodes += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
    lengths = np.array([len(x) for x in paths])
    flat = np.array([step for path in paths for step in path], np.int64)
    return Code(np.cumsum(lengths) - lengths, lengths, flat[:, 0], flat[:, 1])


class Text:
    """Running text with borders of its rows: context hashes of any of its bytes."""

    def __init__(self, data: np.ndarray, borders: np.ndarray) -> None:
        self.data, self.borders = data, borders
        first = np.zeros(len(data) + 1, bool)
        first[1:] = np.append(data[:-1] == 32, False)[: len(data)]
        first[borders] = True
        self.words = np.flatnonzero(first[:-1])
        opening = np.zeros(len(data) + 1, bool)
        opening[borders] = True
        lengths = np.diff(np.append(self.words, len(data)))
        up, down = bs.powers(bs._BASE, len(data))
        total = np.zeros(len(data) + 1, _U)
        with np.errstate(over="ignore"):
            values = data.astype(_U)
            values += _U(1)
            values *= up[: len(data)]
            np.cumsum(values, out=total[1:])
            begun = total[self.words]
            before = np.zeros(len(self.words), _U)
            before[1:] = (begun[1:] - begun[:-1]) * down[self.words[:-1]]
            before[opening[self.words]] = 0  # a row's first word has none before it
            del values
            #: hash of the word so far, and of that and the word before it
            self.whole = total[:-1]
            self.whole -= np.repeat(begun, lengths)
            self.whole *= np.repeat(down[self.words], lengths)
        self.pair = np.repeat(bs.mix(before, 9), lengths)
        self.pair ^= self.whole
        self.place = np.arange(len(data), dtype=np.int32)
        self.place -= np.repeat(self.words.astype(np.int32), lengths)

    def history(self, at: np.ndarray) -> np.ndarray:
        """The last four bytes of the row before each of some bytes, 9 bits each, 0 for none."""
        inside = at - self.borders[np.searchsorted(self.borders, at, side="right") - 1]
        out = np.zeros(len(at), _U)
        for back in range(1, 5):
            byte = self.data[np.maximum(at - back, 0)].astype(_U) + _U(1)
            out |= np.where(inside >= back, byte, _U(0)) << _U(9 * (back - 1))
        return out

    def hashes(self, at: np.ndarray) -> list[np.ndarray]:
        """The context hashes of some bytes for each table but that of the pair, in their order."""
        history = self.history(at)
        # no byte of a text is 0, so the first table's contexts are the last byte, or 0 at a start
        short = np.maximum(history & _U(0x1FF), _U(1)) - _U(1)
        return [
            short,
            *(bs.mix(history & _U((1 << 9 * k) - 1), 8 + k) for k in (2, 3, 4)),
            bs.mix(self.whole[at], 14)
        ]


def contexts(data: np.ndarray, borders: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(context hash of each table for each byte, place in the word); borders are texts'."""
    text = Text(data, borders)
    found = text.hashes(np.arange(len(data)))
    found.insert(PAIR, bs.mix(text.pair, 13))
    return found, text.place


def _slots(context: np.ndarray, node: int, size: int) -> np.ndarray:
    """Slots of context hashes at a node of the code in a hashed table of 2^size."""
    slot = context ^ _NODES[node]
    slot *= _MULTIPLIER
    slot >>= _U(64 - size)
    return slot.view(np.int64)


@dataclass
class Bits:
    """One bit of the code of all equal bytes of a block, kind by kind.

    Bytes are of one kind if they also follow the same word so far and the same four bytes, so
    all tables but the pair's say the same of them. ``firsts`` and ``times`` are the first and
    the number of each kind. A kind has its gate (without the sightings) and its slot in each
    table of ``_ALONE``; each byte has its own slot in the pair's table.
    """

    run: slice
    firsts: np.ndarray
    times: np.ndarray
    one: int
    gate: np.ndarray
    slots: list[np.ndarray]
    pair: np.ndarray


def _blocks(code: Code, data: np.ndarray, borders: np.ndarray) -> Iterator[tuple[np.ndarray, Iterator[Bits]]]:
    """(places in the texts, their bits) of the blocks of some texts."""
    if len(data):
        text = Text(data, borders)
        recent = np.ndarray(len(data), "<u4", np.append(np.zeros(_NEAR, np.uint8), data), strides=(1,))
        for at in range(0, len(data), BLOCK):
            order, kind = _by_kind(text, at, min(at + BLOCK, len(data)), recent)
            yield order, _bits(code, text, order, kind)


def _by_kind(text: Text, at: int, to: int, recent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places sorted by byte and kind, their kinds' hashes) of a block."""
    # a word's first bytes are among the last four, or the last four are in the word so far
    kind = np.where(text.place[at:to] < _NEAR, recent[at:to], text.whole[at:to])
    low, high = np.searchsorted(text.borders, (at - _NEAR, to))
    opening = np.unique(text.borders[low:high, None] + np.arange(_NEAR))
    opening = opening[(opening >= at) & (opening < to)]
    kind[opening - at] = np.where(text.place[opening] < _NEAR, text.history(opening) | _U(1 << 40), kind[opening - at])
    kind *= _MULTIPLIER
    index = _U((to - at - 1).bit_length())
    keys = kind >> _U(8)
    keys >>= index
    keys <<= index
    keys |= np.arange(to - at, dtype=_U)
    keys |= text.data[at:to].astype(_U) << _U(56)
    keys.sort()
    keys &= (_U(1) << index) - _U(1)
    order = keys.view(np.int64)
    kind = kind[order]
    order += at
    return order, kind


def _bits(code: Code, text: Text, order: np.ndarray, kind: np.ndarray) -> Iterator[Bits]:
    data = text.data[order]
    borders = np.flatnonzero(np.append(True, data[1:] != data[:-1]))
    new = np.append(True, kind[1:] != kind[:-1])
    new[borders] = True
    firsts = np.flatnonzero(new)
    chosen = order[firsts]
    hashes, place = text.hashes(chosen), np.minimum(text.place[chosen], 7) * 64
    hashes[0] = hashes[0].astype(np.int64) << 8
    times = np.diff(np.append(firsts, len(order)))
    kinds = np.append(np.searchsorted(firsts, borders), len(firsts))
    for byte, start, end, a, z in zip(data[borders].tolist(), borders.tolist(), [*borders[1:].tolist(), len(order)], kinds[:-1].tolist(), kinds[1:].tolist(), strict=True):
        pair = bs.mix(text.pair.take(order[start:end]), 13)
        for depth in range(int(code.lengths[byte])):
            step = int(code.starts[byte]) + depth
            node = int(code.nodes[step])
            slots = [hashes[0][a:z] | node]
            slots += [_slots(h[a:z], node, TABLES[k]) for k, h in zip(_ALONE[1:], hashes[1:], strict=True)]
            yield Bits(
                slice(start, end),
                firsts[a:z] - start,
                times[a:z],
                int(code.bits[step]),
                place[a:z] + min(depth, 7) * 8,
                slots,
                _slots(pair, node, TABLES[PAIR])
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in bs.slices(batch.column("text"), TEXT_BYTES):
            yield running_text(bs.find_words(part, lower=True))


@dataclass
class Mixer:
    """The byte code, stretched predictions (8 fraction bits), weights and adaptive map by gate."""

    code: Code
    tables: list[np.ndarray]
    sure: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def cost(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Bits of each text."""
        total = np.zeros(len(data), np.float32)
        columns = np.ascontiguousarray(self.weights.T)
        for order, parts in _blocks(self.code, data, borders):
            spent = np.zeros(len(order), np.float32)
            for bits in parts:
                gate = bits.gate + self.sure.take(bits.slots[-1])
                mixed = columns[-1].take(gate)
                for k, slot in zip(_ALONE, bits.slots, strict=True):
                    mixed += columns[k].take(gate) * self.tables[k].take(slot)
                x = np.repeat(columns[PAIR].take(gate), bits.times)
                x *= self.tables[PAIR].take(bits.pair)
                x += np.repeat(mixed, bits.times)
                p = final(x, np.repeat(_starts(gate), bits.times), self.refined)
                spent[bits.run] -= np.log(p if bits.one else 1 - p)
            total[order] = spent
        total = total.astype(np.float64) / np.log(2)
        return np.add.reduceat(total, borders[:-1]) if len(borders) > 1 else np.zeros(0)


def _starts(gate: np.ndarray) -> np.ndarray:
    """Where in the adaptive map gates have their middle levels; small enough to be exact."""
    return (gate * LEVELS + LEVELS // 2).astype(np.float32)


def _place(mixed: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Place in the adaptive map of stretched probabilities."""
    level = np.clip(mixed, -8, 8)
    level *= 2
    np.rint(level, out=level)
    level += start
    return level.astype(np.int64)


def final(mixed: np.ndarray, start: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Probability of a 1, from the mixer and the adaptive map; never 0 or 1.

    ``start`` tells where in the map each bit's gate begins.
    """
    place = _place(mixed, start)
    p = _squashed(mixed)
    p *= 1 - REFINED
    map_p = refined.ravel().take(place)
    map_p *= REFINED
    p += map_p
    return np.clip(p, 1e-6, 1 - 1e-6, out=p)


def _squashed(mixed: np.ndarray) -> np.ndarray:
    p = np.clip(mixed, -16, 16)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of distinct words and end marks, by flush: h, word, n."""

    def flush(held: list) -> pa.RecordBatch:
        hashes, counts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        words = pa.concat_arrays([x[2] for x in held])
        names, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_pydict(
            {
                "h": pa.array(names.view(np.int64)),
                "word": words.take(pa.array(first)),
                "n": pa.array(np.bincount(place, counts).astype(np.int64))
            }
        )

    held, count = [], 0
    for batch in batches:
        for part in bs.slices(batch.column("text")):
            words = bs.find_words(part, lower=True)
            names, first, counts = np.unique(words.hashes(), return_index=True, return_counts=True)
            length = words.ends[first] - words.starts[first]
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            raw = words.data[np.repeat(words.starts[first], length) + place]
            own = pa.Array.from_buffers(
                pa.binary(),
                len(first),
                [None, pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]
            )
            held.append(
                (
                    np.append(names, end_hash()),
                    np.append(counts, part.rows),
                    pa.concat_arrays([own, pa.array([END], pa.binary())])
                )
            )
            count += len(first)
            if count >= FLUSH // 4:
                yield flush(held)
                held, count = [], 0
    if held:
        yield flush(held)


def end_hash() -> np.uint64:
    return bs.mix(np.array([0], _U), 99)[0]


def _slot_rows(code: Code):
    """Mapper: bit counts of the texts of a task, a row for each chunk of slots, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * -(-int(_OFFSETS[-1]) // CHUNK) * CHUNK, np.uint32)
        views = [total[2 * a : 2 * z].reshape(-1, 2) for a, z in zip(_OFFSETS[:-1], _OFFSETS[1:], strict=True)]
        for data, borders in _texts(batches):
            for _, parts in _blocks(code, data, borders):
                for bits in parts:
                    times = bits.times.astype(np.uint32)
                    for k, slot in zip(_ALONE, bits.slots, strict=True):
                        np.add.at(views[k][:, bits.one], slot, times)
                    np.add.at(views[PAIR][:, bits.one], bits.pair, np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        for number, own in enumerate(total.reshape(-1, 2 * CHUNK)):
            met = np.flatnonzero(own)
            if len(met):
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([number], pa.int32()),
                    "places": pa.array([bs.pack_sorted(met.astype(np.uint32))], pa.binary()),
                    "counts": pa.array([pack(own[met].astype("<u4").tobytes())], pa.binary()),
                })

    return run


def _narrow(pairs: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 in 16 bits; larger ones are scaled down together."""
    over = np.maximum(1, pairs.max(axis=1, keepdims=True) / 65535)
    return np.rint(pairs / over).astype("<u2")


def _chunk_sum(table: pa.Table) -> pa.Table:
    total = np.zeros(2 * CHUNK, np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    for places, counts in zip(table.column("places").to_pylist(), table.column("counts").to_pylist(), strict=True):
        total[bs.unpack_sorted(places)] += np.frombuffer(unpack(counts), "<u4")
    packed = zstandard.ZstdCompressor(level=1).compress(_narrow(total.reshape(-1, 2)).tobytes())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([packed], pa.binary())})


def _sums(
    code: Code, pairs: np.ndarray, weights: np.ndarray, texts: Iterable[tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, curvature, hits) of some texts, by gate."""
    pull, curve = np.zeros((GATES, WIDTH)), np.zeros((GATES, WIDTH, WIDTH))
    hits = np.zeros((GATES * LEVELS, 2))
    both = np.ascontiguousarray(pairs).view("<u4").ravel()
    tables = [both[a:z] for a, z in zip(_OFFSETS[:-1], _OFFSETS[1:], strict=True)]
    columns = np.ascontiguousarray(weights.T)
    found, held = [], 0
    for data, borders in texts:
        for _, parts in _blocks(code, data, borders):
            for bits in parts:
                x = np.ones((len(_OWN), len(bits.gate)), np.float32)
                for k, (number, slot) in enumerate(zip(_ALONE, bits.slots, strict=True)):
                    zeros, ones = _without_own(tables[number].take(slot), bits.one)
                    np.subtract(_LOG.take(ones), _LOG.take(zeros), out=x[k])
                seen = zeros + ones  # of the last table, the word so far
                gate = bits.gate + _SURE.take(np.minimum(seen, SURE[-1]))
                alone = columns[-1].take(gate)
                for k, number in enumerate(_ALONE):
                    alone += columns[number].take(gate) * x[k]
                zeros, ones = _without_own(tables[PAIR].take(bits.pair), bits.one)
                y = _LOG.take(ones)
                y -= _LOG.take(zeros)
                mixed = np.repeat(columns[PAIR].take(gate), bits.times)
                mixed *= y
                mixed += np.repeat(alone, bits.times)
                np.clip(mixed, -16, 16, out=mixed)
                met = np.bincount(_place(mixed, np.repeat(_starts(gate), bits.times)))
                hits[: len(met), bits.one] += met
                p = _squashed(mixed)
                error = bits.one - p
                steep = p
                steep *= 1 - p
                sums = np.empty((5, len(gate)), np.float32)
                for k, some in enumerate((error, steep)):
                    np.add.reduceat(some, bits.firsts, out=sums[k])
                    some *= y
                    np.add.reduceat(some, bits.firsts, out=sums[k + 2])
                steep *= y
                np.add.reduceat(steep, bits.firsts, out=sums[4])
                found.append((gate, x, sums))
                held += len(gate)
                if held >= KINDS:
                    _add_kinds(found, pull, curve)
                    found, held = [], 0
    if found:
        _add_kinds(found, pull, curve)
    return pull, curve, hits.reshape(GATES, LEVELS, 2)


def _add_kinds(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], pull: np.ndarray, curve: np.ndarray) -> None:
    """Adds kinds of bits to the sums of their gates: gates, their own predictions, and the sums
    over each kind of error, steepness, both times the pair's prediction, the last times it again."""
    gate, x, sums = (np.concatenate(some, axis=-1) for some in zip(*found, strict=True))
    order = np.argsort(gate.astype(np.uint16), kind="stable")
    gate, x, sums = gate[order], x.take(order, axis=1), sums.take(order, axis=1)
    error, steep, error_y, steep_y, steep_yy = sums
    right = np.concatenate([x * steep, error[None], steep_y[None]])
    met, first = np.unique(gate, return_index=True)
    ends = [*first[1:].tolist(), len(gate)]
    both = np.stack([x[:, a:z] @ right[:, a:z].T for a, z in zip(first.tolist(), ends, strict=True)])
    pull[met[:, None], _OWN] += both[:, :, -2]
    pull[met, PAIR] += np.add.reduceat(error_y, first)
    curve[np.ix_(met, _OWN, _OWN)] += both[:, :, :-2]
    curve[met[:, None], PAIR, _OWN] += both[:, :, -1]
    curve[met[:, None], _OWN, PAIR] += both[:, :, -1]
    curve[met, PAIR, PAIR] += np.add.reduceat(steep_yy, first)


def _without_own(pair: np.ndarray, one: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and of 1, from packed ones, without one occurrence of a bit."""
    zeros, ones = pair & np.uint32(0xFFFF), pair >> np.uint32(16)
    own = ones if one else zeros
    np.maximum(own, np.uint32(1), out=own)
    own -= np.uint32(1)
    return zeros, ones


class _Learner:
    """Weights and adaptive map, moved by the sums of one step after the other."""

    def __init__(self) -> None:
        self.weights = np.full((GATES, WIDTH), 0.15, np.float32)
        self.weights[:, -2:] = 0.4, 0
        self.curve, self.hits = np.zeros((GATES, WIDTH, WIDTH)), np.zeros((GATES, LEVELS, 2))

    def move(self, pull: np.ndarray, curve: np.ndarray, hits: np.ndarray) -> None:
        self.curve = MEMORY * self.curve + curve
        self.hits = MEMORY * self.hits + hits
        move = np.linalg.solve(self.curve + 3 * np.eye(WIDTH), pull[:, :, None])[:, :, 0]
        self.weights += np.clip(move, -0.3, 0.3).astype(np.float32)

    def mixer(self, code: Code, pairs: np.ndarray) -> Mixer:
        # in steps, so that the driver holds little besides the counts and the tables
        tables, sure = [np.empty(1 << size, np.int16) for size in TABLES], np.empty(1 << TABLES[-1], np.uint8)
        for table, start in zip(tables, _OFFSETS.tolist(), strict=False):
            for at in range(0, len(table), CHUNK):
                pair = pairs[start + at : start + min(at + CHUNK, len(table))]
                table[at : at + CHUNK] = (_LOG[pair[:, 1]] - _LOG[pair[:, 0]]) * 256
                if table is tables[-1]:
                    sure[at : at + CHUNK] = np.searchsorted(SURE, pair.sum(axis=1, dtype=np.int32), side="right")
        scale = np.full(WIDTH, 1 / 256, np.float32)
        scale[-1] = 1
        prior = 1 / (1 + np.exp(-(np.arange(LEVELS) - LEVELS // 2) / 2))
        refined = (self.hits[:, :, 1] + 8 * prior) / (self.hits.sum(axis=2) + 8)
        return Mixer(code, tables, sure, self.weights * scale, refined.astype(np.float32))


def _learn(counts: np.ndarray, batches: list[list[tuple[bytes, int]]]) -> Mixer:
    """The mixer of given counts, learned from batches of (text, times) in one process."""
    pairs, learner, code = _narrow(counts.reshape(-1, 2)), _Learner(), byte_code(np.zeros(256))
    for some in batches:
        texts = [w for w, n in some for _ in range(n)]
        learner.move(
            *_sums(
                code,
                pairs,
                learner.weights,
                [(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(w) for w in texts])))]
            )
        )
    return learner.mixer(code, pairs)


def _held_out(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", held)


def vocabulary(training: DataFrame) -> DataFrame:
    """h, word, n: all tokens of all training texts, the end mark among them; stored."""
    counted = training.select("text").mapInArrow(bs.tidy(_tokens), "h long, word binary, n long")
    return stored(counted.groupBy("h").agg(F.first("word").alias("word"), F.sum("n").alias("n")), "vocabulary")


def _byte_counts(words: DataFrame) -> np.ndarray:
    """How often each byte occurs in the running text of all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            data, offsets = bs.column_bytes(batch.column("word"))
            many = np.asarray(batch.column("n"))
            total += np.bincount(data[offsets[0] : offsets[-1]], np.repeat(many, np.diff(offsets)), minlength=256)
            total[32] += many.sum()  # the space after each word
        yield pa.RecordBatch.from_pydict({"byte": pa.array(np.arange(256), pa.int32()), "n": pa.array(total.astype(np.int64))})

    counts = np.zeros(256)
    for r in words.select("word", "n").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        counts[r.byte] = r.n
    return counts


def train(training: DataFrame, words: DataFrame) -> Mixer:
    """Byte code, predictors, weights and adaptive map from all training documents."""
    code = byte_code(_byte_counts(words))
    found = training.select("text").mapInArrow(bs.tidy(_slot_rows(code)), "chunk int, places binary, counts binary")
    found = found.groupBy("chunk").applyInArrow(_chunk_sum, "chunk int, counts binary")
    pairs = np.zeros((-(-int(_OFFSETS[-1]) // CHUNK) * CHUNK, 2), np.uint16)
    for r in found.toLocalIterator():  # a part at a time
        pairs[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(
            zstandard.ZstdDecompressor().decompress(bytes(r.counts)), "<u2"
        ).reshape(-1, 2)
    shared = training.sparkSession.sparkContext.broadcast(pairs)  # a fixed size
    dealt = training.select("text", F.pmod(F.xxhash64("text"), F.lit(16)).alias("share"))
    learner = _Learner()
    for low, high in STEPS:
        learner.move(*_summed(dealt.where(F.col("share").between(low, high - 1)).select("text"), code, shared, learner.weights))
    mixer = learner.mixer(code, pairs)
    shared.destroy()
    return mixer


def _summed(texts: DataFrame, code: Code, shared: Broadcast, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of a step over all its texts: a row for each gate that a task met, then for each gate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pull, curve, hits = _sums(code, shared.value, weights, _texts(batches))
        rows = np.concatenate([x.reshape(GATES, -1) for x in (pull, curve, hits)], axis=1)
        met = np.flatnonzero(hits.any(axis=(1, 2)))
        yield pa.RecordBatch.from_pydict(
            {"gate": pa.array(met, pa.int32()), "sums": pa.array([rows[g].tobytes() for g in met], pa.binary())}
        )

    def add(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("sums").to_pylist())).reshape(len(table), -1)
        return pa.table({"gate": table.column("gate").slice(0, 1), "sums": pa.array([rows.sum(axis=0).tobytes()], pa.binary())})

    total = np.zeros((GATES, WIDTH + WIDTH * WIDTH + LEVELS * 2))
    for r in texts.mapInArrow(  # a row for each gate
        bs.tidy(run), "gate int, sums binary"
    ).groupBy("gate").applyInArrow(add, "gate int, sums binary").collect():
        total[r.gate] = np.frombuffer(bytes(r.sums))
    pull, curve, hits = np.split(total, [WIDTH, WIDTH + WIDTH * WIDTH], axis=1)
    return pull, curve.reshape(GATES, WIDTH, WIDTH), hits.reshape(GATES, LEVELS, 2)


def _least_count(words: DataFrame, limit: int) -> int:
    """Count from which at most limit words are met so often."""
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(1000 + F.floor(F.log2(F.col("n").cast("double")) * 16))
    sizes = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()  # some 2,000 rows at most
    total, least = 0, 1 << 62
    for r in sorted(sizes, reverse=True):
        if total + r.words > limit:
            break
        total, least = total + r.words, r.least
    return least


def _common(words: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, counts) of at most limit commonest words, sorted by hash; least count among them."""
    least = _least_count(words, limit)
    found = words.where(F.col("n") >= least).select("h", "n").toArrow()
    hashes, counts = np.asarray(found.column("h").combine_chunks()).view(_U), np.asarray(found.column("n").combine_chunks())
    order = np.argsort(hashes, kind="stable")
    return hashes[order], counts[order], least


def scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes, bits_per_byte.

    ``docs`` needs doc_id and text; other columns are ignored. Documents whose crc32(doc_id as
    text) mod 7 is 2 are held out: scored, never learned from (a null doc_id counts as the
    empty text, remainder 0, and is learned from). Tokens are the lower-cased (A-Z) words and
    one end for each text; a null or empty text is its end alone. base_score is the add-one
    unigram log10 probability, score the mixer's, n_bytes the coded bytes (words, a space
    after each, the end). Repeated rows are scored and learned from as often as they come; an
    empty table gives none. Words are told apart by 64-bit hashes.
    """
    marked = _held_out(docs)
    training = marked.where(~F.col("held_out")).select("doc_id", "text")
    words = vocabulary(training)
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_words = int(totals.n), int(totals.v)
    mixer = train(training, words)
    names, counts, least = _common(words, DICTIONARY)
    gains = np.log10(counts + 1.0)
    end_at = np.searchsorted(names, end_hash())
    end_count = int(counts[end_at]) if end_at < len(names) and names[end_at] == end_hash() else 0
    model = docs.sparkSession.sparkContext.broadcast((mixer, names, gains))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, names, gains = model.value
        for batch in batches:
            for part in bs.slices(batch.column("text"), TEXT_BYTES):
                found = bs.find_words(part, lower=True)
                data, ends = running_text(found)
                bits = mixer.cost(data, ends)
                hashes, row = found.hashes(), found.row_of()
                unique, place = np.unique(hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(names, unique), max(0, len(names) - 1))
                listed = names[at] == unique if len(names) else np.zeros(len(unique), bool)
                gain = np.where(listed, gains[at] if len(names) else 0.0, 0.0)
                tokens = np.diff(found.rows) + 1
                rest = np.flatnonzero(~listed[place])
                order = np.lexsort((hashes[rest], row[rest]))
                lone, lone_row = hashes[rest][order], row[rest][order]
                borders = np.searchsorted(lone_row, np.arange(part.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(part.first, part.rows),
                    "k": batch.column("k").slice(part.first, part.rows),
                    "held_out": batch.column("held_out").slice(part.first, part.rows),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "known": pa.array(np.bincount(row, listed[place], minlength=part.rows).astype(np.int64) + (end_count > 0)),
                    "gain": pa.array(np.bincount(row, gain[place], minlength=part.rows) + np.log10(end_count + 1.0)),
                    "bits": pa.array(bits),
                    "n_bytes": pa.array(np.diff(ends), pa.int64()),
                    "rest": pa.ListArray.from_arrays(pa.array(borders), pa.array(lone.view(np.int64))),
                })

    kind = dict(marked.dtypes)["doc_id"]
    schema = f"doc_id {kind}, k long, held_out boolean, n_tokens long, known long, gain double, bits double, n_bytes long, rest array<long>"
    scored = stored(
        marked.withColumn("k", F.xxhash64("text")).select("doc_id", "k", "held_out", "text").mapInArrow(bs.tidy(run), schema), "scored"
    )
    # words outside the dictionary: each distinct (row, word) once, joined with its count
    rare = scored.where(F.size("rest") > 0).select(
        "doc_id", "k", F.explode("rest").alias("h")
    ).groupBy("doc_id", "k", "h").agg(F.count(F.lit(1)).alias("times"))
    copies = scored.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("copies"))
    counted = rare.join(words.where(F.col("n") < least).select("h", "n"), "h").groupBy("doc_id", "k").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_gain"), F.sum("times").alias("rare_known")
    )
    counted = counted.withColumnsRenamed({"doc_id": "d", "k": "kk"}).join(copies.withColumnsRenamed({"doc_id": "dd", "k": "kkk"}), F.col("d").eqNullSafe(F.col("dd")) & (F.col("kk") == F.col("kkk"))).select(
        "d",
        "kk",
        (F.col("rare_gain") / F.col("copies")).alias("rare_gain"),
        (F.col("rare_known") / F.col("copies")).cast("long").alias("rare_known")
    )
    out = scored.drop("rest").join(counted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("kk")), "left")
    base = F.col("gain") + F.coalesce("rare_gain", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n_train + n_words + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-F.col("bits") * float(np.log10(2.0))).alias("score"),
        "n_bytes",
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte")
    )
