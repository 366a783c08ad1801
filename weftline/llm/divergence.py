"""How far the sources of a language differ in their words: exact chi-square sums.

The counts of a language form a sparse matrix, a row for each source and a column for each kept
term. It is cut into tiles of columns and blocks of rows, and each tile is kept as a k2-tree with
k = 2: level by level one bit for each quadrant of the quadrants that aren't all zero, found by
rank. Two rows are compared by going down the tree from the root for both at once, all pairs of a
tile together: where both rows' quadrants are all zero, each of its columns adds the same value,
which is known from the two totals alone, so the quadrant is priced by its width and left; leaves
that aren't zero for both are priced one by one. Columns that no row of a tile has never enter a
tree: they are priced by their number at the end.

All numbers are whole: p = 1 + floor(SCALE (count + 1) / (N + V)), and a term adds
floor((p - q)^2 / q). A sum over terms stays below SCALE (SCALE + V), which a long holds for up to
8 thousand million kept terms a language; products go through decimals, or through Python's
integers where a long could not hold them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .storage import stored

#: Probabilities are whole multiples of 1 / SCALE.
SCALE = 1_000_000_000
#: A term is kept in a language if so many of its documents have it.
LEAST_DOCUMENTS = 3
#: Ranks of part `term` that are reported.
TOP_TERMS = 200
#: Kept terms of a tile, on average, and rows of a block.
TILE_TERMS, BLOCK_ROWS = 2048, 32
#: Columns that pairs of rows go down together.
STRIP = 128
#: Counted terms that a task holds before it passes them on.
HELD_TERMS = 400_000

_TERMS = re.compile(rb"[a-z\x80-\xff]+")


def terms_of(text: str) -> list[bytes]:
    """Terms [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of a text, A-Z lower-cased, as UTF-8."""
    return _TERMS.findall(text.encode("utf-8", "surrogatepass").lower())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in groups.items():
            terms = list(counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(terms), pa.string()),
                    "source": pa.array([source] * len(terms), pa.string()),
                    "term": pa.array(terms, pa.binary()).cast(pa.string()),
                    "n": pa.array([counts[t] for t in terms], pa.int64()),
                    "documents": pa.array([documents[t] for t in terms], pa.int64()),
                }
            )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            counts, documents = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            found = terms_of(text.as_py())
            before = len(counts)
            counts.update(found)
            documents.update(set(found))
            held += len(counts) - before
            if held > HELD_TERMS:
                yield from flushed()
                groups.clear()
                held = 0
    yield from flushed()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def cells(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, total, first: the nonzero counts of the kept terms.

    ``total`` is the language's count of the term, ``first`` marks one row of each term. Counts
    are summed in each task before they are dealt by language and term, so a common term is a row
    for each task and source at most, and a large source is spread as its terms are. One exchange
    serves the sums by source and those over sources.
    """
    parts = _texts(docs).mapInArrow(bs.tidy(_counted), "lang string, source string, term string, n long, documents long")
    dealt = parts.repartition("lang", "term")
    sums = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    term = Window.partitionBy("lang", "term")
    return (
        sums.withColumn("all", F.sum("documents").over(term))
        .withColumn("total", F.sum("n").over(term))
        .withColumn("first", F.min("source").over(term) == F.col("source"))
        .where(F.col("all") >= LEAST_DOCUMENTS)
        .select("lang", "source", "term", "n", "total", "first")
    )


def groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """lang, source, size (N), lang_size, terms (V), row: every group, with a number in its language."""
    size = found.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("first").alias("own"))
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    every = own.join(size, ["lang", "source"], "left").fillna(0, ["size", "own"])
    lang = Window.partitionBy("lang")
    return every.select(
        "lang",
        "source",
        "size",
        F.sum("size").over(lang).alias("lang_size"),
        F.sum("own").over(lang).alias("terms"),
        (F.row_number().over(lang.orderBy("source")) - 1).alias("row"),
    )


def share(count: str, size: str) -> str:
    """SQL of p for a count, with the group's size; exact through decimals."""
    return f"1 + cast({SCALE} as decimal(20, 0)) * (cast({count} as decimal(20, 0)) + 1) div ({size} + terms)"


def term_part(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The terms that a group uses more than its language does, by what they add: ranks to TOP_TERMS."""
    both = found.select("lang", "source", "term", "n", "total").join(sizes, ["lang", "source"])
    both = both.withColumn("p", F.expr(share("n", "size"))).withColumn("q", F.expr(share("total", "lang_size")))
    priced = both.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = priced.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def shares(counts: np.ndarray, denominators: np.ndarray) -> np.ndarray:
    """p for counts of groups with N + V as denominators."""
    if counts.size and int(counts.max()) >= (1 << 63) // SCALE - 1:
        exact = [1 + SCALE * (c + 1) // d for c, d in zip(counts.tolist(), denominators.tolist(), strict=True)]
        return np.array(exact, np.int64)
    return 1 + SCALE * (counts + 1) // denominators


def priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


@dataclass
class Tree:
    """A k2-tree (k = 2) of a square matrix with a side of 2**height.

    ``bits[l]`` has four bits (upper left, upper right, lower left, lower right) for each nonzero
    quadrant of level l, level 0 being the whole; ``ranks[l]`` counts the ones before each bit,
    so a set bit's quadrant is found at that number on the next level. ``leaves`` are the values.
    """

    height: int
    bits: list[np.ndarray]
    ranks: list[np.ndarray]
    leaves: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> Tree:
        """From the places and values of distinct nonzero cells."""
        code = np.zeros(len(rows), np.int64)  # row and column bits in turn: a quadrant is a prefix
        for bit in range(height):
            code |= ((rows >> bit) & 1) << (2 * bit + 1) | ((columns >> bit) & 1) << (2 * bit)
        order = np.argsort(code)
        code, bits = code[order], []
        for level in range(height):
            child = np.unique(code >> 2 * (height - level - 1))
            parents, number = np.unique(child >> 2, return_inverse=True)
            here = np.zeros(4 * max(len(parents), 1), bool)
            here[4 * number + (child & 3)] = True
            bits.append(here)
        return cls(height, bits, [np.cumsum(b) - b for b in bits], values[order])

    def child(self, level: int, quadrant: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Number of a quadrant's child on the next level; -1 if that is all zero."""
        at = 4 * np.maximum(quadrant, 0) + which
        return np.where((quadrant >= 0) & self.bits[level][at], self.ranks[level][at], -1)


def compare(tree: Tree, size: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows (g, h): the sums over all columns of priced(p of g, p of h), and of h, g.

    ``size`` is N + V of each row. Pairs start together at the root and go down each for itself,
    a strip of columns at a time so that what is held is bounded.
    """
    own, other = pairs
    nothing = shares(np.zeros(len(size), np.int64), size)
    at_zero = priced(nothing[own], nothing[other]), priced(nothing[other], nothing[own])
    total = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    top = max(0, tree.height - (STRIP - 1).bit_length())
    for strip in range(0, columns, STRIP):
        pair = np.arange(len(own))
        a = np.zeros(len(own), np.int64) if len(tree.leaves) else np.full(len(own), -1)
        b, column = a.copy(), np.zeros(len(own), np.int64)
        for level in range(tree.height):
            below = tree.height - level - 1
            if level < top:  # one way: to the strip
                right = np.full(len(pair), (strip >> below) & 1)
            else:
                pair, a, b, column = (np.repeat(x, 2) for x in (pair, a, b, column))
                right = np.tile([0, 1], len(pair) // 2)
            column = 2 * column + right
            keep = column << below < columns
            if not keep.all():
                pair, a, b, column, right = (x[keep] for x in (pair, a, b, column, right))
            a = tree.child(level, a, 2 * (own[pair] >> below & 1) + right)
            b = tree.child(level, b, 2 * (other[pair] >> below & 1) + right)
            zero = (a < 0) & (b < 0)
            if zero.any():  # uniform: as many times the value at zero as there are columns
                first = np.maximum(column[zero] << below, strip)
                width = np.minimum(np.minimum((column[zero] + 1) << below, strip + STRIP), columns) - first
                free = np.bincount(pair[zero], width, len(own)).astype(np.int64)
                for x, y in zip(total, at_zero, strict=True):
                    x += free * y
                pair, a, b, column = (x[~zero] for x in (pair, a, b, column))
        if len(pair):
            leaf = lambda at: np.where(at >= 0, tree.leaves[np.maximum(at, 0)], 0)
            p, q = shares(leaf(a), size[own[pair]]), shares(leaf(b), size[other[pair]])
            np.add.at(total[0], pair, priced(p, q))
            np.add.at(total[1], pair, priced(q, p))
    return total


def _tile(table: pa.Table) -> pa.Table:
    """One tile of columns and two blocks of rows: the sum of each ordered pair between them.

    Rows without a term name the groups; ``side`` is 0 and 1 for the blocks, 0 alone for a block
    with itself.
    """
    named = pc.is_null(table.column("term"))
    heads = table.filter(named)
    body = table.filter(pc.invert(named))
    source = heads.column("source").to_pylist()
    side = heads.column("side").to_numpy()
    size = heads.column("size").to_numpy() + heads.column("terms").to_numpy()
    number = {s: i for i, s in enumerate(source)}
    terms = body.column("term").combine_chunks().dictionary_encode()
    columns = len(terms.dictionary)
    column = terms.indices.to_numpy().astype(np.int64)
    row = np.array([number[s] for s in body.column("source").to_pylist()], np.int64)
    height = max(1, (max(len(source), columns) - 1).bit_length())
    tree = Tree.build(row, column, body.column("n").to_numpy(), height)
    own, other = (x.ravel() for x in np.meshgrid(np.arange(len(source)), np.arange(len(source)), indexing="ij"))
    meet = (own < other) & ((side[own] != side[other]) | (side.max(initial=0) == 0))
    own, other = own[meet], other[meet]
    value = np.concatenate(compare(tree, np.maximum(size, 1), (own, other), columns))
    own, other = np.concatenate([own, other]), np.concatenate([other, own])
    return pa.table(
        {
            "lang": pa.array([table.column("lang")[0].as_py()] * len(value), pa.string()),
            "source": pa.array([source[i] for i in own.tolist()], pa.string()),
            "item": pa.array([source[i] for i in other.tolist()], pa.string()),
            "value": pa.array(value, pa.int64()),
            "columns": pa.array(np.full(len(value), columns), pa.int64()),
        }
    )


def pair_part(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """How far each group is from each other source of its language, all ranks.

    A tile's work is dealt by (language, tile, two blocks of at most BLOCK_ROWS groups), so
    neither a large group nor a language of many sources is one task's; rows are repeated for
    each block that theirs meets, as the result is.
    """
    blocks = F.expr(f"cast(row div {BLOCK_ROWS} as int)")
    tiles = F.greatest(F.ceil(F.col("terms") / TILE_TERMS), F.lit(1)).cast("long")
    last = F.max("block").over(Window.partitionBy("lang"))
    placed = sizes.withColumn("block", blocks).withColumn("last", last).withColumn("tiles", tiles)
    slim = placed.select("lang", "source", "size", "terms", "block", "last", "tiles")
    heads = slim.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    body = found.select("lang", "source", "term", "n").join(slim, ["lang", "source"])
    body = body.withColumn("tile", F.pmod(F.xxhash64("term"), "tiles"))
    columns = ["lang", "tile", "block", "last", "source", "size", "terms", "term", "n"]
    heads = heads.withColumn("term", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long"))
    both = heads.select(columns).unionByName(body.select(columns))
    met = both.withColumn("with", F.explode(F.sequence(F.lit(0), "last")))
    met = met.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    met = met.withColumn("side", F.when(F.col("low") == F.col("high"), 0).otherwise((F.col("block") == F.col("high")).cast("int")))
    sums = (
        met.select("lang", "tile", "low", "high", "side", "source", "size", "terms", "term", "n")
        .groupBy("lang", "tile", "low", "high")
        .applyInArrow(bs.tidy_group(_tile), "lang string, source string, item string, value long, columns long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("seen"), F.sum("columns").alias("columns"))
    )
    own = sizes.select("lang", "source", F.col("size").alias("own"), "terms")
    other = sizes.select("lang", F.col("source").alias("item"), F.col("size").alias("other"))
    nothing = F.lit(0)
    ends = sums.join(own, ["lang", "source"]).join(other, ["lang", "item"]).withColumn("zero", nothing)
    ends = ends.where("terms > 0").withColumn("p", F.expr(share("zero", "own"))).withColumn("q", F.expr(share("zero", "other")))
    ends = ends.withColumn("value", F.expr("seen + (terms - columns) * ((p - q) * (p - q) div q)"))
    empty = sums.join(own, ["lang", "source"]).where("terms = 0").withColumn("value", F.lit(0).cast("long"))
    values = ends.select("lang", "source", "item", "value").unionByName(empty.select("lang", "source", "item", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return values.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item (string), value (long), rank (int, from 1 per group and part).

    ``docs`` needs lang, source and text, other columns are ignored; null counts as the empty
    string in all three. Part ``pair`` has for each group of a language and source every other
    source of the language, with 0 where the language keeps no term; part ``term`` has the kept
    terms that the group uses more than the language. Ties go to the smaller item in UTF-8 order;
    repeated rows count each; a language with one source has no pair; an empty table has no row.
    """
    found = stored(cells(docs), "cells")
    sizes = stored(groups(docs, found), "sizes")
    return pair_part(found, sizes).unionByName(term_part(found, sizes))
