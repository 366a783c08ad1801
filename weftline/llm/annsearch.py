"""Nearest neighbours with an inverted file and product-quantised residuals.

Equal vectors are indexed once, with the smallest ids that they have, so a large group of copies
takes one place among the candidates. Coarse centroids and the residual code books are k-means
models, fitted on the driver from a bounded sample. Every vector is indexed: its list is the
nearest centroid, its code the nearest entry of each sub-space's code book for the residual. A
query scans the lists of its nearest centroids with a table of distances from its own residual
to every code book entry (asymmetric: the query isn't quantised), keeps the best candidates and
orders them by exact distance.

Lists grow with the table. How many of them a query scans is measured on the sample: as many as
hold ``COVER`` of its rows' true neighbours. Queries and index are packed in blocks and chunks of
a bounded size, and every block of queries meets every chunk in some task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Vectors that the models are fitted on, by hash.
SAMPLE = 8_192
#: Lists: a power of two near the root of the number of vectors, within these.
LISTS = (16, 1024)
#: Sampled queries, and the share of their neighbours that the scanned lists have to hold.
ASKED, COVER = 256, 0.98
SUBSPACES = 16
CODES = 256
#: Candidates with exact distances for each query: so many up to ``RERANK_AT`` vectors, beyond
#: that more with the root of their number.
RERANK, RERANK_AT = 400, 50_000
NEAREST = 10
EVERY = 100
#: Queries and vectors packed together.
QUERY_BLOCK, CHUNK = 512, 16_384
ROUNDS = 12


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, by a matrix product."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """At most k centroids of the rows of x; empty clusters take far points."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        lacking = np.flatnonzero(~full)
        if len(lacking):
            centres[lacking] = x[np.argsort(-far, kind="stable")[: len(lacking)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance) for each row, in steps."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    step = max(1, (1 << 20) // max(1, len(centres)))
    for at in range(0, len(x), step):
        d = squares(x[at : at + step], centres)
        near[at : at + step] = d.argmin(axis=1)
        far[at : at + step] = d.min(axis=1)
    return near, far


class Index:
    """Coarse centroids and code books, with what a query needs of them."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int) -> None:
        self.coarse = kmeans(sample, lists)
        near, _ = nearest(sample, self.coarse)
        residual = sample - self.coarse[near]
        self.borders = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:z], CODES) for a, z in zip(self.borders[:-1], self.borders[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, _ = nearest(x, self.coarse)
        residual = x - self.coarse[near]
        codes = [
            nearest(residual[:, a:z], book)[0] for a,
            z,
            book in zip(self.borders[:-1], self.borders[1:], self.books, strict=True)
        ]
        return near, np.stack(codes, axis=1).astype(np.uint8)

    def order(self, q: np.ndarray) -> np.ndarray:
        """The lists of each query, nearest first."""
        return np.argsort(squares(q, self.coarse), axis=1, kind="stable")

    def needed(self, sample: np.ndarray, k: int) -> int:
        """How many lists hold ``COVER`` of the k nearest other sampled rows of sampled queries."""
        asked = np.random.default_rng(2).permutation(len(sample))[:ASKED]
        d = squares(sample[asked], sample)
        d[np.arange(len(asked)), asked] = np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.coarse)
        true = np.argpartition(d, k - 1, axis=1)[:, :k]
        near, _ = nearest(sample, self.coarse)
        place = np.argsort(self.order(sample[asked]), axis=1)  # of every list for every query
        ranks = np.sort(np.take_along_axis(place, near[true], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(COVER * len(ranks))))]) + 1

    def table(self, q: np.ndarray, which: int) -> np.ndarray:
        """[sub-space, query, code]: squared distances of the queries' residuals in one list."""
        residual = q - self.coarse[which]
        out = np.full((len(self.books), len(q), CODES), np.inf, np.float32)
        for s, (a, z, book) in enumerate(zip(self.borders[:-1], self.borders[1:], self.books, strict=True)):
            out[s, :, : len(book)] = squares(residual[:, a:z], book)
        return out


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v: rows whose vector isn't null, empty or zero and has only finite components."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("id").isNotNull()
    good &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(
        F.col(id_column).cast("long").alias("id"), v.alias("v")
    ).where(good).where(F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """r, v, ids: every vector once, with the smallest ids of its rows; stored.

    Each task keeps its own smallest ids of a vector before the exchange (a group limit), so a
    vector that a third of all rows have isn't gathered.
    """
    order = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ids)
    grouped = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return stored(grouped.withColumn("r", F.monotonically_increasing_id()), "vectors")


def search(
    vectors: DataFrame,
    k: int = NEAREST,
    every: int = EVERY,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    probes: int | None = None,
    rerank: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query.

    Queries are the rows whose id is divisible by ``every``; every other usable row is a
    candidate (Euclidean distance in double precision on the original vectors, ties to the
    smaller id). Null, zero and non-finite vectors and null ids take no part; other columns are
    ignored. Rows that repeat an id are rows of their own: each of them is a candidate for the
    others, and each is asked. Vectors of different lengths have no distance: more than one
    length among the usable rows is an error. An empty table gives none. probes, rerank: how
    many lists are scanned and candidates reranked, if not by the measures above.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    width = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if width.low is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if width.low != width.high:
        raise ValueError(f"vectors of {width.low} and of {width.high} components have no distance")
    known = distinct_vectors(rows, k + 1)
    total = known.count()
    sample = np.array([r.v for r in known.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()], np.float32)  # SAMPLE rows
    lists = int(np.clip(2 ** round(np.log2(max(1.0, total**0.5))), *LISTS))
    index = Index(sample, lists, SUBSPACES)
    probes = probes or index.needed(sample, k)
    rerank = rerank or int(RERANK * max(1.0, (total / RERANK_AT) ** 0.5))
    queries = stored(rows.where(F.col("id") % every == 0).withColumn("q_row", F.monotonically_increasing_id()), "queries")
    chunks = stored(known.select("r", "v").mapInArrow(_encoded(index), "rs binary, lists binary, codes binary"), "ivfpq")
    blocks = queries.select("q_row", "v").mapInArrow(_packed, "q_rows binary, q binary")
    pairs = chunks.crossJoin(blocks)  # packed: a row for each block of queries and chunk of vectors
    found = pairs.mapInArrow(_scan(index, probes, rerank, width.low), "q_row long, r long, estimate float")
    best = Window.partitionBy("q_row").orderBy("estimate", "r")
    candidates = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rerank).select("q_row", "r")
    asked = queries.select("q_row", F.col("id").alias("query_id"), F.col("v").alias("q"))
    square = F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    # the query's own row: one of its id among the rows of an equal vector
    own = F.when(F.col("v") == F.col("q"), F.array_position("ids", F.col("query_id"))).otherwise(0)
    others = F.filter("ids", lambda x, i: i + 1 != own)
    exact = candidates.join(known, "r").join(asked, "q_row").select(
        "q_row", "query_id", F.sqrt(square).alias("score"), F.explode(others).alias("vec_id")
    )
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("q_row").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _encoded(index: Index):
    """Mapper: chunks of vectors with their lists and codes, packed by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                near, codes = index.encode(_matrix(some.column("v")).astype(np.float32))
                order = np.argsort(near, kind="stable")
                parts = (
                    np.asarray(some.column("r"))[order].astype("<i8"),
                    near[order].astype("<i4"),
                    np.ascontiguousarray(codes[order].T)
                )
                yield pa.RecordBatch.from_pydict(
                    {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("rs", "lists", "codes"), parts, strict=True)}
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper: blocks of queries, packed."""
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_BLOCK):
            some = batch.slice(at, QUERY_BLOCK)
            parts = (np.asarray(some.column("q_row")).astype("<i8"), _matrix(some.column("v")).astype("<f4"))
            yield pa.RecordBatch.from_pydict(
                {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("q_rows", "q"), parts, strict=True)}
            )


def _scan(index: Index, probes: int, rerank: int, width: int):
    """Mapper: the best candidates of each query in a chunk, by asymmetric distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_rows, q = np.frombuffer(row["q_rows"], "<i8"), np.frombuffer(row["q"], "<f4").reshape(-1, width)
                rs, lists = np.frombuffer(row["rs"], "<i8"), np.frombuffer(row["lists"], "<i4")
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(rs))
                wanted = np.zeros((len(q), len(index.coarse)), bool)
                np.put_along_axis(wanted, index.order(q)[:, :probes], True, axis=1)
                met, first = np.unique(lists, return_index=True)
                ends = [*first[1:].tolist(), len(lists)]
                for few in range(0, len(q), 64):
                    distance = np.full((min(64, len(q) - few), len(rs)), np.inf, np.float32)
                    for w, a, z in zip(met.tolist(), first.tolist(), ends, strict=True):
                        ask = np.flatnonzero(wanted[few : few + 64, w])
                        if len(ask):
                            table = index.table(q[few + ask], w)
                            distance[ask, a:z] = sum(table[s][:, codes[s, a:z]] for s in range(len(codes)))
                    keep = min(rerank, len(rs))
                    top = np.argpartition(distance, keep - 1, axis=1)[:, :keep]
                    found = np.take_along_axis(distance, top, axis=1)
                    good = np.isfinite(found)
                    who = np.repeat(q_rows[few : few + 64], keep).reshape(found.shape)
                    yield pa.RecordBatch.from_pydict(
                        {"q_row": pa.array(who[good]), "r": pa.array(rs[top][good]), "estimate": pa.array(found[good])}
                    )

    return run
