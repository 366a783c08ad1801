"""Exact substring removal by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``BLOCK`` words, and those blocks
are looked up among all rolling windows of that length. ``WINDOW`` consecutive words always
hold one whole block of their own text (2 * BLOCK - 1 <= WINDOW), so a repeated window's
block is met again as a rolling window elsewhere. Blocks that are met again are anchors; hits
are extended around the anchors by comparing the windows that hold them, and neighbouring
repeated windows merge to maximal exact repeats.

Both exchanges are hash-dealt in packed form: a task sends, per bucket, its sorted distinct
hashes (about 2.5 bytes each), so a passage in a third of all rows costs a row per flush.
A row is known by a 64-bit hash of its text: exact copies share one address.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .storage import bucket_count

WINDOW = 35
BLOCK = 18
#: Hashes that a task holds before it sends them.
FLUSH = 4_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of docs with k, the hash of the text; other columns are numbered, so none clashes."""
    kept = docs.select(*(F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)))
    return kept.withColumn("text", F.col("text").cast("string")).withColumn("k", F.xxhash64(F.coalesce("text", F.lit(""))))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct, occurs twice or more, place of each input)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ranked[first], np.diff(np.append(first, len(ranked))) > 1, place


def _probe_rows(buckets: int, block: int, window: int):
    """Mapper of the anchor search: rolling windows and reference blocks, dealt by hash."""

    def flush(held: list) -> pa.RecordBatch | None:
        if not held:
            return None
        rolling = np.concatenate([x[0] for x in held])
        hashes, again = np.unique(rolling, return_counts=True)
        again = again > 1
        copies = np.concatenate([x[1] for x in held])
        if len(copies):
            again |= np.isin(hashes, copies)
        rest, number, border = bs.split_sorted(hashes, buckets)
        anchors = np.concatenate([x[2] for x in held])
        keys = np.concatenate([x[3] for x in held])
        index = np.concatenate([x[4] for x in held])
        order = np.argsort(anchors, kind="stable")
        anchors, keys, index = anchors[order], keys[order], index[order]
        arest, anumber, aborder = bs.split_sorted(anchors, buckets)
        at = dict(zip(anumber.tolist(), range(len(anumber)), strict=True))
        out = {"bucket": [], "probes": [], "twice": [], "rests": [], "keys": [], "blocks": []}
        for i, b in enumerate(number.tolist()):
            a, z = border[i], border[i + 1]
            own, more = np.unique(rest[a:z], return_index=True)
            flags = np.logical_or.reduceat(again[a:z], more)
            flags |= np.diff(np.append(more, z - a)) > 1
            out["bucket"].append(b)
            out["probes"].append(bs.pack_sorted(own))
            out["twice"].append(bs.pack_sorted(own[flags]))
            j = at.get(b)
            lo, hi = (aborder[j], aborder[j + 1]) if j is not None else (0, 0)
            out["rests"].append(arest[lo:hi].tobytes())
            out["keys"].append(keys[lo:hi].tobytes())
            out["blocks"].append(index[lo:hi].astype("<i4").tobytes())
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array(out["bucket"], pa.int32())} | {
                c: pa.array(v, pa.binary()) for c, v in out.items() if c != "bucket"
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, {}
        for batch in batches:
            text, key = batch.column("text"), np.asarray(batch.column("k"))
            for part in bs.slices(text):
                words = bs.find_words(part)
                length = np.diff(words.rows)
                own = key[part.first : part.first + part.rows]
                starts, hashes = bs.run_hashes(words, words.hashes(), block)
                row = np.searchsorted(words.rows, starts, side="right") - 1
                long = length[row] >= window
                starts, hashes, row = starts[long], hashes[long], row[long]
                # exact copies within a flush: one address, and every window is a repeat
                fresh = np.ones(part.rows, bool)
                copy = np.zeros(part.rows, bool)
                for r in np.flatnonzero(length >= window).tolist():
                    k = int(own[r])
                    if k in seen:
                        fresh[r], copy[r] = False, seen[k]
                        seen[k] = False
                    else:
                        seen[k] = True
                keep, twice = fresh[row], copy[row]
                held_hash = hashes[keep]
                place = starts - words.rows[row]
                anchor = keep & (place % block == 0)
                held.append((held_hash, hashes[twice], hashes[anchor], own[row[anchor]], (place[anchor] // block)))
                count += len(held_hash)
                if count >= FLUSH:
                    yield flush(held)
                    held, count, seen = [], 0, {}
        last = flush(held) if count else None
        if last is not None:
            yield last

    return run


def _met_again(table: pa.Table) -> pa.Table:
    """Reducer of a bucket: the blocks whose hash is met at another place too."""
    values = np.concatenate([bs.unpack_sorted(x) for x in table.column("probes").to_pylist()])
    values.sort()
    several = values[1:][values[1:] == values[:-1]]
    flagged = np.concatenate([several, *(bs.unpack_sorted(x) for x in table.column("twice").to_pylist())])
    flagged.sort()
    join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    rests = join("rests", np.uint32)
    place = np.searchsorted(flagged, rests)
    hit = np.zeros(len(rests), bool)
    inside = place < len(flagged)
    hit[inside] = flagged[place[inside]] == rests[inside]
    key, block = join("keys", np.int64)[hit], join("blocks", "<i4")[hit]
    order = np.lexsort((block, key))
    key, block = key[order], block[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
    return pa.table({"k": pa.array(key[new], pa.int64()), "block": pa.array(block[new], pa.int32())})


def _window_rows(buckets: int, block: int, window: int):
    """Mapper of the extension: the windows that hold an anchor, dealt by hash."""

    def flush(held: list) -> pa.RecordBatch | None:
        if not held:
            return None
        hashes, check, keys, starts, twice = (np.concatenate([x[i] for x in held]) for i in range(5))
        order = np.argsort(hashes, kind="stable")
        hashes, check, keys, starts, twice = hashes[order], check[order], keys[order], starts[order], twice[order]
        _, number, border = bs.split_sorted(hashes, buckets)
        cut = lambda a, kind: pa.array(
            [a[border[i] : border[i + 1]].astype(kind).tobytes() for i in range(len(number))], pa.binary()
        )
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(number, pa.int32()),
                "hashes": cut(hashes, "<u8"),
                "checks": cut(check, "<u2"),
                "keys": cut(keys, "<i8"),
                "starts": cut(starts, "<i4"),
                "twice": cut(twice, "u1")
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, {}
        for batch in batches:
            text, key, hits = batch.column("text"), np.asarray(batch.column("k")), batch.column("blocks")
            borders = np.asarray(hits.offsets)
            values = np.asarray(hits.values)
            for part in bs.slices(text):
                chosen, copied = [], {}
                for r in range(part.rows):
                    k = int(key[part.first + r])
                    if k in seen:
                        seen[k] += 1
                        copied[k] = True
                    else:
                        seen[k] = 1
                        chosen.append(r)
                if copied:
                    for x in held:  # copies of rows that wait already
                        x[4] |= np.isin(x[2], np.fromiter(copied, np.int64))
                if not chosen:
                    continue
                words = bs.find_words(part)
                hashes = words.hashes()
                first, full = bs.run_hashes(words, hashes, window)
                _, other = bs.run_hashes(words, hashes, window, salt=7)
                want = np.zeros(len(words.starts) + window, bool)
                for r in chosen:
                    a, z = words.rows[r], words.rows[r + 1]
                    for b in values[borders[part.first + r] : borders[part.first + r + 1]].tolist():
                        at = a + b * block
                        want[max(a, at - (window - block)) : min(at + 1, z)] = True
                use = want[first]
                at = first[use]
                row = np.searchsorted(words.rows, at, side="right") - 1
                own = key[part.first + row]
                copy = np.fromiter((seen[int(k)] > 1 for k in key[part.first : part.first + part.rows]), bool, part.rows)[row]
                held.append([full[use], (other[use] >> np.uint64(48)).astype(np.uint16), own, at - words.rows[row], copy])
                count += int(use.sum())
                if count >= FLUSH // 4:
                    yield flush(held)
                    held, count, seen = [], 0, {}
        if count:
            yield flush(held)

    return run


def _repeated(table: pa.Table, buckets: int) -> pa.Table:
    """Reducer of a bucket: the places of windows that start at two places at least."""
    join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    hashes, checks, keys, starts, twice = join("hashes", "<u8"), join("checks", "<u2"), join("keys", "<i8"), join("starts", "<i4"), join("twice", "u1")
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    again = (np.bincount(group, minlength=1) + np.bincount(group, twice[order], minlength=1)) > 1
    out = order[again[group]]
    key, start = keys[out], starts[out]
    # dealt on by the row's hash: one packed row for each pair of buckets
    group = (bs.mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, key, group))
    key, start, group = key[order], start[order], group[order]
    number, first = np.unique(group, return_index=True)
    borders = np.append(first, len(group))
    packed = [_pack_places(key[a:z], start[a:z]) for a, z in zip(borders[:-1], borders[1:], strict=True)]
    return pa.table({"part": pa.array(number, pa.int32()), "places": pa.array(packed, pa.binary())})


def _pack_places(key: np.ndarray, start: np.ndarray) -> bytes:
    """Entries sorted by key and start: distinct keys, their sizes, and differences of starts."""
    import zstandard

    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key))).astype("<i4")
    gaps = np.diff(start, prepend=np.int32(0)).astype("<i4")
    planes = np.ascontiguousarray(np.concatenate((size, gaps)).view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(edge).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(
        key[edge].astype("<i8").tobytes() + planes
    )


def _unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(blob[:4], "little")
    data = zstandard.ZstdDecompressor().decompress(blob[4:])
    numbers = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=8 * n).reshape(4, -1).T).view("<i4").ravel()
    return np.repeat(np.frombuffer(data, "<i8", n), numbers[:n]), np.cumsum(numbers[n:], dtype=np.int32)


def _gather(table: pa.Table) -> pa.Table:
    """All places of some texts: a row for each text, its starts packed."""
    some = [_unpack_places(x) for x in table.column("places").to_pylist()]
    key, start = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return pa.table(
        {
            "k": pa.array(key[edge], pa.int64()),
            "starts": pa.array(
                [start[a:z].astype("<i4").tobytes() for a, z in zip(edge, np.append(edge, len(key))[1:], strict=True)],
                pa.binary()
            )
        }
    )


def repeats(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Addresses of repeated windows: k (hash of the text), starts (packed int32, may repeat).

    keyed: rows of :func:`_keyed`. All their columns go through the join with the anchors, though
    only k and text are read: so that join and the one that brings the starts back to the rows
    need the same exchange of the texts, and Spark makes it once.
    """
    block = (window + 1) // 2
    buckets = bucket_count(keyed)
    probes = keyed.select("k", "text").mapInArrow(
        bs.tidy(_probe_rows(buckets, block, window)), "bucket int, probes binary, twice binary, rests binary, keys binary, blocks binary"
    )
    anchors = probes.groupBy("bucket").applyInArrow(bs.tidy_group(_met_again), "k long, block int")
    hits = anchors.groupBy("k").agg(F.collect_list("block").alias("blocks"))
    schema = "bucket int, hashes binary, checks binary, keys binary, starts binary, twice binary"
    windows = keyed.join(hits, "k").mapInArrow(bs.tidy(_window_rows(buckets, block, window)), schema)
    places = windows.groupBy("bucket").applyInArrow(bs.tidy_group(lambda rows: _repeated(rows, buckets)), "part int, places binary")
    return places.groupBy("part").applyInArrow(bs.tidy_group(_gather), "k long, starts binary")


def _cover(starts: bytes | None, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(covered words, maximal repeated spans as begin, end pairs)."""
    if not starts:
        return np.zeros(n, bool), np.zeros((0, 2), np.int32)
    at = np.unique(np.frombuffer(starts, "<i4"))
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    covered = np.cumsum(step[:-1]) > 0
    cut = np.flatnonzero(np.diff(at) > 1)
    return covered, np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + window], axis=1)


def _cut_rows(window: int):
    """(words, kept words, spans) of each row of a batch with text and starts."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[bytes], np.ndarray]]:
        data, offsets = bs.column_bytes(batch.column("text"))
        for r, hits in enumerate(batch.column("starts")):
            words = data[offsets[r] : offsets[r + 1]].tobytes().split()
            covered, span = _cover(hits.as_py(), len(words), window)
            yield words, [words[i] for i in np.flatnonzero(~covered).tolist()] if len(span) else words, span

    return rows


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, kept_sha256, spans.

    ``docs`` needs doc_id and text; other columns are ignored. Words are maximal runs without
    ASCII white space. Every word of a window of ``window`` words that also starts anywhere
    else (the same row included) goes; spans are the maximal repeats as [begin, end) words.
    A null or empty text has no words and keeps the empty text; rows are never merged, so
    repeated rows and null ids come out as often as they went in; an empty table gives none.
    Windows are compared by 80 bits of hash and texts are known by 64.
    """
    rows = _cut_rows(window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(words), len(words) - len(left), b" ".join(left), span.tolist()) for words, left, span in rows(batch)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("c0"),
                "n_words": pa.array([x[0] for x in found], pa.int64()),
                "n_removed": pa.array([x[1] for x in found], pa.int64()),
                "kept_text": pa.array([x[2] for x in found], pa.binary()).cast(pa.string()),
                "kept_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string()),
                "spans": pa.array([x[3] for x in found], pa.list_(pa.list_(pa.int32()))),
            })

    kind = dict(docs.dtypes)["doc_id"]
    keyed = _keyed(docs.select("doc_id", "text"))
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<array<int>>"
    return keyed.join(repeats(keyed, window), "k", "left").mapInArrow(bs.tidy(cut), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with repeated windows cut out of their texts.

    All columns stay as they are but text: where words were removed it becomes the kept words
    with one space between; other texts, null ones among them, aren't touched. Every row comes
    out once, so null and repeated ids decide nothing.
    """
    rows = _cut_rows(window)
    keyed = _keyed(docs)
    names, own = docs.columns, [c for c in keyed.columns if c != "k"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b" ".join(left) if len(span) else None for _, left, span in rows(batch)]
            text = pa.array(kept, pa.binary()).cast(pa.string())
            columns = {c: batch.column(o) for c, o in zip(names, own, strict=True)}
            yield pa.RecordBatch.from_pydict(columns | {"text": pc.if_else(pc.is_valid(text), text, columns["text"])})

    return keyed.join(repeats(keyed, window), "k", "left").mapInArrow(bs.tidy(cut), docs.schema)
