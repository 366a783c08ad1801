"""Queries on the shape of a set of vectors: nearest rows, spectrum, dimensions that tell labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allnearest as A
from ..operators import spectra as S
from .common import split_sql
from .evaluation import split_vectors, vectors

NEAREST = (
    "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: "
    "x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM n), s AS (SELECT a.vec_id AS id, b.vec_id AS nearest, "
    "round(list_dot_product(a.u, b.u), 9) AS similarity FROM u a JOIN u b ON a.vec_id <> b.vec_id) SELECT id, arg_max(nearest, "
    "(similarity, -nearest)) AS nearest, max(similarity) AS similarity FROM s GROUP BY id"
)
ENTROPY = (
    f"WITH near AS ({NEAREST}), c AS (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM near GROUP BY nearest) SELECT "
    "round(-sum(p * ln(p)), 9) AS nearest_neighbor_entropy FROM c"
)


def nearest_rows_cosine(s, d):
    return A.nearest_rows(vectors(s, d), "id", "v")


def nearest_neighbour_entropy(s, d):
    found = A.neighbour_entropy(A.nearest_rows(vectors(s, d), "id", "v"))
    return found.select(F.round("nearest_neighbor_entropy", 9).alias("nearest_neighbor_entropy"))


def top_eigenvalues(s, d):
    return S.top_eigenvalues(vectors(s, d)).select("rank", F.round("eigenvalue", 9).alias("eigenvalue"))


def dimension_associations(s, d):
    return S.dimension_associations(split_vectors(s, d), by="split", top=16).select("split", "dim", F.round("eta_squared", 6).alias("eta_squared"), "dominant_label")


def stable_dimensions(s, d):
    return S.stable_dimensions(S.dimension_associations(split_vectors(s, d), by="split", top=32), "split")


ETA = f"""WITH x AS (SELECT {split_sql("vec_id::VARCHAR")} AS split, label::VARCHAR AS l, unnest(embedding::DOUBLE[]) AS x, unnest(range(64))::INT AS dim FROM embeddings WHERE label IS NOT NULL),
  g AS (SELECT split, dim, l, count(*) AS n, avg(x) AS m FROM x GROUP BY ALL), t AS (SELECT split, dim, avg(x) AS m, var_pop(x) * count(*) AS whole FROM x GROUP BY ALL),
  e AS (SELECT t.split, t.dim, CASE WHEN any_value(whole) <= 0 THEN 0 ELSE least(1.0, sum(g.n * (g.m - t.m) ** 2) / any_value(whole)) END AS eta, arg_max(g.l, (g.m, g.l)) AS dominant_label
  FROM t JOIN g ON g.split = t.split AND g.dim = t.dim GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(eta, 9) DESC, dim) AS rank FROM e)"""
QUERIES = {f.__name__: f for f in (nearest_rows_cosine, nearest_neighbour_entropy, top_eigenvalues, dimension_associations, stable_dimensions)}
ORACLES = {
    "nearest_rows_cosine": NEAREST,
    "nearest_neighbour_entropy": ENTROPY,
    "dimension_associations": ETA + " SELECT split, dim, round(eta, 6) AS eta_squared, dominant_label FROM r WHERE rank <= 16",
    "stable_dimensions": ETA + " SELECT dim FROM r WHERE rank <= 32 GROUP BY dim HAVING count(DISTINCT split) = (SELECT count(DISTINCT split) FROM r)",
}
