"""Similarity join on word shingles with adaptive multi-match prefixes.

Two sets that share enough elements share at least m elements within prefixes that are
n - (needed overlap) + m long, whatever total order sorts them. A longer prefix (larger m)
reads more postings but asks for m common prefix elements before a pair is verified.

1. All documents, in hash order: prefixes with m = ``SCREEN`` of the size, dealt in packed
   form. A document stays only if enough of its prefix occurs in the prefix of another text.
2. Documents with the same set form one class; one of them goes on.
3. Classes, rarest elements first: each picks m in ``CHOICES`` by the estimated cost of its
   postings and of the candidates that they give, and then its prefix.
4. Links are found in two rounds. Round one verifies each posting's members against its
   smallest member, which already joins most large groups of near copies. Round two counts,
   for pairs that are not yet in one component, the prefix elements that they share, in packed
   form, and verifies those that share enough for their sizes; pairs within a component can't
   change it. In large postings, sketches of the sets tell most pairs that can't link before
   they are counted. So a group never turns into rows of all its pairs, and no link between different
   components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .components import connected
from .storage import bucket_count, scratch, stored

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Share of a set by which the screening prefix is longer than the shortest one.
SCREEN = 0.15
#: Match counts that a class may choose.
CHOICES = (1, 2, 4, 8, 16)
#: Postings read per element compared when a candidate is verified.
VERIFY = 0.05
#: Prefix elements, and pairs, that a task holds before it sends them.
FLUSH, HELD_PAIRS = 200_000, 400_000
#: Members of a posting that are compared with each other in one step; larger ones are cut in
#: parts, and every two parts are compared.
POSTING = 512
#: Postings of so many members carry sketches: for sets of at most ``SKETCH`` elements, how many
#: of them fall in each of ``SKETCH`` buckets. No overlap is larger than the sum of the smaller
#: counts, so most pairs of a large group that can't link are left out before they are counted.
SKETCHED, SKETCH = 64, 512
#: Pairs expanded at once.
PAIRS = 200_000


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap with any partner: ceil(PERCENT / 100 * n)."""
    return -(-n * PERCENT // 100)


def shingle_sets(words: bs.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, sorted by row, then hash."""
    hashes = words.hashes()
    starts, runs = bs.run_hashes(words, hashes, k)
    row = np.searchsorted(words.rows, starts, side="right") - 1
    length = np.diff(words.rows)
    short = np.flatnonzero((length > 0) & (length < k))
    if len(short):  # the whole sequence is one shingle; its length is part of the hash
        own = bs.mix(
            bs.spans_hash(
                hashes, words.rows[short], words.rows[short + 1], np.uint64(0xD6E8FEB86659FD93)
            ) ^ length[short].astype(np.uint64),
            1
        )
        row, runs = np.concatenate((row, short)), np.concatenate((runs, own))
    order = np.lexsort((runs, row))
    row, runs = row[order], runs[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (runs[1:] != runs[:-1])
    return row[new], runs[new]


def _screen_rows(buckets: int, k: int):
    """Mapper of the screening: prefixes in hash order, with their rows, dealt by hash."""

    def flush(held: list) -> pa.RecordBatch:
        keys = np.concatenate([x[0] for x in held])
        base = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
        rows = np.concatenate([x[1] + b for x, b in zip(held, base, strict=True)])
        hashes = np.concatenate([x[2] for x in held])
        order = np.argsort(hashes, kind="stable")
        hashes, rows = hashes[order], rows[order]
        rest, number, border = bs.split_sorted(hashes, buckets)
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        out = {"rests": [], "rows": [], "keys": []}
        for a, z in zip(border[:-1], border[1:], strict=True):
            gaps = np.diff(rest[a:z], prepend=np.uint32(0)).astype("<u4")
            used, local = np.unique(rows[a:z], return_inverse=True)
            out["rests"].append(press(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()))
            out["rows"].append(press(np.ascontiguousarray(local.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()))
            out["keys"].append(keys[used].tobytes())
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array(number, pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in out.items()}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()
        for batch in batches:
            key = np.asarray(batch.column("k"))
            for part in bs.slices(batch.column("text")):
                words = bs.find_words(part, lower=True)
                own = key[part.first : part.first + part.rows]
                row, hashes = shingle_sets(words, k)
                size = np.bincount(row, minlength=part.rows)
                prefix = np.minimum(size, size - needed(size) + np.ceil(SCREEN * size).astype(np.int64))
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                fresh = np.zeros(part.rows, bool)
                for r in np.flatnonzero(size).tolist():  # copies of a text count once
                    fresh[r] = own[r] not in seen
                    seen.add(own[r])
                use = (place < prefix[row]) & fresh[row]
                held.append((own, row[use], hashes[use]))
                count += int(use.sum())
                if count >= FLUSH:
                    yield flush(held)
                    held, count, seen = [], 0, set()
        if count:
            yield flush(held)

    return run


def _shared(table: pa.Table, parts: int) -> pa.Table:
    """Reducer of a bucket: for each text, how many of its prefix elements another text has.

    Packed and dealt on by text: one row for each pair of buckets.
    """
    rests, texts = [], []
    for r, w, k in zip(*(table.column(c).to_pylist() for c in ("rests", "rows", "keys")), strict=True):
        rests.append(bs.unpack_sorted(r))
        import zstandard

        local = np.ascontiguousarray(
            np.frombuffer(zstandard.ZstdDecompressor().decompress(w), np.uint8).reshape(4, -1).T
        ).view("<u4").ravel()
        texts.append(np.frombuffer(k, np.int64)[local])
    names, text = np.unique(np.concatenate(texts), return_inverse=True)
    pair = np.unique((np.concatenate(rests).astype(np.uint64) << np.uint64(32)) | text.astype(np.uint64))
    rest = pair >> np.uint64(32)
    again = np.zeros(len(pair), bool)
    same = rest[1:] == rest[:-1]
    again[1:] |= same
    again[:-1] |= same
    count = np.bincount((pair[again] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
    hit = count > 0
    names, count = names[hit], count[hit]
    part = (bs.mix(names.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    number, first = np.unique(part[order], return_index=True)
    borders = np.append(first, len(part))
    cut = lambda a, kind: pa.array(
        [a[order[x:z]].astype(kind).tobytes() for x, z in zip(borders[:-1], borders[1:], strict=True)], pa.binary()
    )
    return pa.table({"part": pa.array(number, pa.int32()), "keys": cut(names, "<i8"), "counts": cut(count, "<u4")})


def _total(table: pa.Table) -> pa.Table:
    """Sum of the counts of each text of a part."""
    join = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    names, place = np.unique(join("keys", "<i8"), return_inverse=True)
    return pa.table(
        {
            "k": pa.array(names, pa.int64()),
            "shared": pa.array(np.bincount(place, join("counts", "<u4"), minlength=len(names)).astype(np.int64))
        }
    )


def _set_rows(k: int):
    """Size and name of each row's set, and the set, if the row passed the screening."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = np.asarray(batch.column("shared").fill_null(0))
            for part in bs.slices(batch.column("text")):
                row, hashes = shingle_sets(bs.find_words(part, lower=True), k)
                size = np.bincount(row, minlength=part.rows)
                columns = {
                    c: batch.column(c).slice(part.first, part.rows) for c in ("doc_id", "k", "k2")
                } | {"n_shingles": pa.array(size, pa.int64())}
                # what the smallest possible partner asks for, less room for equal short hashes
                least = np.ceil(SCREEN * needed(size)) - 1 - size // 5000
                stays = (size > 0) & (shared[part.first : part.first + part.rows] >= least)
                # a set is named by 128 bits of its elements' sums
                sums = []
                for salt in (3, 4):
                    total = np.zeros(len(row) + 1, np.uint64)
                    np.cumsum(bs.mix(hashes, salt), out=total[1:])
                    edge = np.append(0, np.cumsum(size))
                    sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                borders = np.append(0, np.cumsum(np.where(stays, size, 0))).astype(np.int32)
                columns |= {
                    "set_a": pa.array(sums[0]),
                    "set_b": pa.array(sums[1]),
                    "stays": pa.array(stays),
                    "elements": pa.ListArray.from_arrays(pa.array(borders), pa.array(hashes[stays[row]].view(np.int64)))
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _candidate_prefixes(classes: DataFrame) -> DataFrame:
    """cls, n, r, rest, place, element: the adaptive prefix of each class, rarest elements first.

    r is how many of the n elements any other class has; an overlap can't be larger. place is
    the element's place among those r, rest how many of them lie behind the prefix.
    """
    posts = classes.select("cls", "n", F.explode("elements").alias("element"))
    frequency = posts.groupBy("element").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = posts.join(frequency, "element").groupBy("cls", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "element"))).alias("ranked")
    )
    # elements of one class only come first in the order, and need no posting
    unique = F.col("n") - F.size("ranked")
    ranked = ranked.withColumn("spare", F.col("n") - F.expr(f"div(n * {PERCENT} + 99, 100)") - unique).where("spare >= 0")
    prices = []
    for m in CHOICES:
        part = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), F.col("spare") + m).cast("int"))
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x["df"])
        prices.append(F.struct((total + total / m * F.col("n") * VERIFY).alias("price"), F.lit(m).alias("m")))
    allowed = F.filter(F.array(*prices), lambda x: (x["m"] == 1) | (x["m"] * 2 <= F.expr(f"div(n * {PERCENT} + 99, 100)")))
    chosen = ranked.withColumn("m", F.array_min(allowed)["m"]).withColumn("r", F.size("ranked"))
    length = F.least(F.col("r"), (F.col("spare") + F.col("m")).cast("int"))
    chosen = chosen.withColumn("rest", F.col("r") - length).withColumn("prefix", F.slice("ranked", F.lit(1), length))
    return chosen.select("cls", "n", "r", "rest", F.posexplode("prefix").alias("place", "x")).select(
        "cls", "n", "r", "rest", "place", F.col("x.element").alias("element")
    )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            xo, yo, xv, yv = np.asarray(x.offsets), np.asarray(y.offsets), np.asarray(x.values), np.asarray(y.values)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                both = np.sort(np.concatenate((p, q)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= PERCENT * (len(both) - common)
            yield pa.RecordBatch.from_pydict(
                {"a": batch.column("a").filter(pa.array(keep)), "b": batch.column("b").filter(pa.array(keep))}
            )

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(bs.tidy(link), "a long, b long")


def _expanded(left: np.ndarray, right: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left member, right member) of all pairs of some postings, ``PAIRS`` at a time.

    left, right: borders of the members of each posting's two parts; own: whether they are the
    same part, of which each pair comes once.
    """
    many = np.diff(left) * np.diff(right)
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), PAIRS, side="right")) + at)
        a = np.arange(left[at], left[to])
        posting = np.repeat(np.arange(at, to), np.diff(left[at : to + 1]))
        width = np.diff(right)[posting]
        place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        x, y = np.repeat(a, width), np.repeat(right[posting], width) + place
        once = ~np.repeat(own[posting], width) | (x < y)
        yield x[once], y[once]
        at = to


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper: the sketch of each class that isn't too large for one."""
    for batch in batches:
        column = batch.column("elements")
        offsets, values = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        slot = (bs.mix(values[offsets[0] : offsets[-1]], 5) % np.uint64(SKETCH)).astype(np.int64)
        for at in range(0, len(size), 1024):
            own = (row >= at) & (row < at + 1024)
            counts = np.bincount(
                (row[own] - at) * SKETCH + slot[own], minlength=min(1024, len(size) - at) * SKETCH
            ).reshape(-1, SKETCH)
            fits = np.flatnonzero(counts.max(axis=1) < 256)
            sketches = pa.array([counts[i].astype(np.uint8).tobytes() for i in fits], pa.binary())
            yield pa.RecordBatch.from_pydict({"cls": batch.column("cls").take(pa.array(fits + at)), "sketch": sketches})


def _overlap_bound(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of members i and j by their sketches (all zero: none)."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 8192):
        a, b = x[i[at : at + 8192]], y[j[at : at + 8192]]
        most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
        out[at : at + 8192] = np.where(a.any(axis=1) & b.any(axis=1), most, 1 << 40)
    return out


def _pair_counts(buckets: int):
    """Mapper of round two: for pairs of open classes, how many of these postings they share.

    Pairs within a component and those whose sizes or places leave too small an overlap are
    left out. Counts are added up within the task and dealt by the pair's smaller class, packed.
    """
    import zstandard

    names = ("a", "b", "least", "common")

    def flush(held: list) -> pa.RecordBatch:
        a, b, least = (np.concatenate([x[i] for x in held]) for i in range(3))
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        common = np.diff(np.append(first, len(a)))
        a, b, least = a[first], b[first], least[first]
        bucket = (bs.mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number, edge = np.unique(bucket[order], return_index=True)
        press = zstandard.ZstdCompressor(level=1).compress
        spans = list(zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True))
        cut = lambda v, kind: pa.array([press(v[order[i:j]].astype(kind).tobytes()) for i, j in spans], pa.binary())
        columns = zip(names, (a, b, least, common), ("<i8", "<i8", "<i4", "<i4"), strict=True)
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array(number, pa.int32())} | {c: cut(v, kind) for c, v, kind in columns}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            own = np.asarray(batch.column("own").cast(pa.int8())).astype(bool)
            sides = []
            for side in ("x", "y"):
                column = batch.column(side)
                if side == "y":  # a posting of one part stands on both sides
                    column = pa.concat_arrays([batch.column("x").filter(pa.array(own)), column.filter(pa.array(~own))])
                else:
                    column = pa.concat_arrays([column.filter(pa.array(own)), column.filter(pa.array(~own))])
                members = column.values
                fields = {c: np.asarray(members.field(c)) for c in ("cls", "n", "r", "rest", "place", "component")}
                known = members.field("sketch").is_valid().to_numpy(zero_copy_only=False)
                fields["sketch"] = np.zeros((len(members), SKETCH if known.any() else 0), np.uint8)
                if known.any():
                    fields["sketch"][known] = np.frombuffer(
                        b"".join(members.field("sketch").drop_null().to_pylist()), np.uint8
                    ).reshape(-1, SKETCH)
                sides.append((np.asarray(column.offsets).astype(np.int64), fields))
            (left, x), (right, y) = sides
            for i, j in _expanded(left, right, np.sort(own)[::-1]):
                far = x["component"][i] != y["component"][j]
                i, j = i[far], j[far]
                least = -(-(x["n"][i] + y["n"][j]) * PERCENT // (100 + PERCENT))  # the overlap of a link
                p, q = x["place"][i], y["place"][j]
                most = np.minimum(p, q) + 1 + np.minimum(x["r"][i] - 1 - p, y["r"][j] - 1 - q)
                able = most >= least
                i, j, least = i[able], j[able], least[able]
                if len(i) and x["sketch"].shape[1] and y["sketch"].shape[1]:
                    able = _overlap_bound(x["sketch"], y["sketch"], i, j) >= least
                    i, j, least = i[able], j[able], least[able]
                if not len(i):
                    continue
                one, two = x["cls"][i], y["cls"][j]
                # what lies behind the prefix that ends first can't be shared more than once
                least = np.maximum(1, least - np.maximum(x["rest"][i], y["rest"][j]))
                held.append((np.minimum(one, two), np.maximum(one, two), least))
                count += len(i)
                if count >= HELD_PAIRS:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return run


def _enough(table: pa.Table) -> pa.Table:
    """Reducer of a bucket: the pairs that share enough elements of their prefixes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    join = lambda c, kind: np.frombuffer(b"".join(unpack(x) for x in table.column(c).to_pylist()), kind)
    a, b, least, common = join("a", "<i8"), join("b", "<i8"), join("least", "<i4"), join("common", "<i4")
    order = np.lexsort((b, a))
    a, b, least, common = a[order], b[order], least[order], common[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    keep = first[np.add.reduceat(common, first) >= least[first]]
    return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id, component_id, k, k2, first.

    ``docs`` needs doc_id (integer) and text; other columns are ignored. A-Z are lower-cased;
    a set holds the distinct k-word shingles, or the whole sequence if it has fewer words. A
    null or empty text, or one of white space, has the empty set: n_shingles 0, linked with
    nothing, component_id its own doc_id. Documents of the same set share class_id (the
    smallest doc_id of them); component_id is the smallest doc_id reachable by links. Rows
    with a null doc_id get null ids and link nothing; repeated rows come out repeatedly, and
    rows of one doc_id with other texts are rows of their own. k and k2 are 128 bits of the
    text's hash; ``first`` is true for one row of each component (of those with its
    component_id) and for every row that links nothing. Sets are compared by 64-bit hashes of
    their shingles and named by 128 bits; a text's shared elements are counted under k, where
    texts of equal hash would only keep each other in the search.
    """
    buckets = bucket_count(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("k", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    screened = base.where("doc_id is not null").select("k", "text").mapInArrow(
        bs.tidy(_screen_rows(buckets, k)), "bucket int, rests binary, rows binary, keys binary"
    )
    shared = screened.groupBy("bucket").applyInArrow(
        bs.tidy_group(lambda rows: _shared(rows, buckets)), "part int, keys binary, counts binary"
    )
    shared = shared.groupBy("part").applyInArrow(bs.tidy_group(_total), "k long, shared long")
    found = base.join(shared, "k", "left").select("doc_id", "k", "k2", "text", "shared").mapInArrow(
        bs.tidy(_set_rows(k)),
        "doc_id long, k long, k2 long, n_shingles long, set_a long, set_b long, stays boolean, elements array<long>",
    )
    sets = stored(found.withColumn("row", F.monotonically_increasing_id()), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    # a class is known by the row that stands for it
    named = full.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("class_id"),
        F.min(F.when(F.col("stays"), F.col("row"))).alias("cls"),
        F.min(F.struct("doc_id", "row"))["row"].alias("head")
    )
    named = stored(named, "classes")
    standing = named.where("cls is not null").select("cls")
    classes = stored(
        sets.where("stays").join(standing, F.col("row") == F.col("cls"), "left_semi").select(
            F.col("row").alias("cls"), F.col("n_shingles").alias("n"), "elements"
        ),
        "class-sets"
    )
    with scratch(docs.sparkSession):
        joined = stored(_components(classes, buckets), "joined", keep=True)
    least = joined.join(named, "cls").groupBy("component").agg(F.min(F.struct("class_id", "head")).alias("p"))
    linked = joined.join(least, "component").select(
        "cls", F.col("p.class_id").alias("component_id"), F.col("p.head").alias("first_row")
    )
    known = named.join(linked, "cls", "left").select(
        "set_a",
        "set_b",
        "class_id",
        F.coalesce("component_id", "class_id").alias("component_id"),
        F.coalesce("first_row", "head").alias("first_row")
    )
    columns = ("doc_id", "n_shingles", "class_id", "component_id", "k", "k2", "first")
    alone = sets.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    alone = alone.withColumn("class_id", F.col("doc_id")).withColumn(
        "component_id", F.col("doc_id")
    ).withColumn("first", F.lit(True))
    several = full.drop("elements", "stays").join(known, ["set_a", "set_b"]).withColumn(
        "first", F.col("row") == F.col("first_row")
    )
    return several.select(*columns).unionByName(alone.select(*columns))


def _components(classes: DataFrame, buckets: int) -> DataFrame:
    """cls, component of every class that is linked with another."""
    prefixes = stored(_candidate_prefixes(classes), "prefixes")
    enough = f"least(ra, rb) * {100 + PERCENT} >= {PERCENT} * (na + nb)"  # else the overlap is too small
    # round one: each posting's members against its smallest one
    star = prefixes.groupBy("element").agg(F.min(F.struct("cls", "n", "r")).alias("p"), F.count(F.lit(1)).alias("size"))
    star = star.where("size > 1").select(
        "element", F.col("p.cls").alias("a"), F.col("p.n").alias("na"), F.col("p.r").alias("ra")
    )
    pairs = prefixes.withColumnsRenamed({"n": "nb", "r": "rb"}).join(star, "element").where(f"a < cls and {enough}").select(
        "a", F.col("cls").alias("b")
    ).distinct()
    links = stored(_verified(pairs, classes), "links")
    joined = stored(connected(links), "components")
    # round two: pairs with enough common prefix elements, across components
    own = prefixes.join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    opened = own.groupBy("element").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")
    ).where("low < high")
    parts = F.ceil(F.col("size") / POSTING).cast("int")
    dealt = own.join(
        opened.select("element", "size", parts.alias("parts")), "element"
    ).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    dealt = stored(dealt, "open")
    large = dealt.where((F.col("size") >= SKETCHED) & (F.col("n") <= SKETCH)).select("cls").distinct()
    sketches = classes.join(large, "cls", "left_semi").select("cls", "elements").mapInArrow(
        bs.tidy(_sketches), "cls long, sketch binary"
    )
    dealt = dealt.join(sketches, "cls", "left").withColumn("sketch", F.when(F.col("size") >= SKETCHED, F.col("sketch")))
    member = F.struct("cls", "n", "r", "rest", "place", "component", "sketch")
    posting = stored(dealt.groupBy("element", "parts", "part").agg(F.collect_list(member).alias("x")), "postings")
    whole = posting.select("x", F.lit(None).cast(posting.schema["x"].dataType).alias("y"), F.lit(True).alias("own"))
    cut = posting.where("parts > 1").select("element", "part", "x")
    across = cut.join(
        cut.withColumnsRenamed({"x": "y", "part": "other"}), "element"
    ).where("part < other").select("x", "y", F.lit(False).alias("own"))
    counted = whole.unionByName(across).mapInArrow(
        bs.tidy(_pair_counts(buckets)), "bucket int, a binary, b binary, least binary, common binary"
    )
    more = counted.groupBy("bucket").applyInArrow(bs.tidy_group(_enough), "a long, b long")
    rest = _verified(more, classes)
    return connected(stored(links.unionByName(rest), "all-links"))
