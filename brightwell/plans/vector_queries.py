"""Vector queries over the embeddings table and numeric columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, vectors
from .registry import query, read, rounded

_CELLS = "SELECT label, pos, avg(x / n) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos, {} AS n FROM embeddings) GROUP BY 1, 2"
_POOL = "WITH c AS ({}), l AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY 1) SELECT label, (pos - 1)::INTEGER AS pos, round(CASE WHEN n > 1e-9 THEN x / n ELSE x END, 6) AS x FROM c JOIN l USING (label)"
_NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9"


def _pooled(spark, sf, method):
    out = vectors.pool(read(spark, sf, "embeddings"), "label", "embedding", method)
    return rounded(out.select("label", F.posexplode("pooled").alias("pos", "x")))


@query(_POOL.format(_CELLS.format(_NORM)))
def room_pool_normmean(spark, sf):
    return _pooled(spark, sf, "normmean")


@query(_POOL.format(_CELLS.format("1.0::DOUBLE")))
def room_pool_mean(spark, sf):
    return _pooled(spark, sf, "mean")


_PAIRS = "SELECT vec_id AS u, (48271 * vec_id + 11) % 2147483647 % (SELECT count(*) FROM embeddings) AS v FROM embeddings"


@query(
    f"""SELECT u, v, round(d / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-9), 6) AS cos, round(d, 6) AS dot
    FROM (SELECT u, v, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM ({_PAIRS}) JOIN embeddings a ON a.vec_id = u JOIN embeddings b ON b.vec_id = v)"""
)
def pair_cosine_dot(spark, sf):
    e = read(spark, sf, "embeddings")
    pairs = e.select(F.col("vec_id").alias("u"), (graph.affine(F.col("vec_id"), 48271, 11) % e.count()).alias("v"))
    return rounded(vectors.pair_cosine_dot(e, pairs, "vec_id", "embedding"))


def _asked(e):
    """The stated query set of the searches: every row whose id is divisible by 50, against all rows."""
    return e.where("vec_id % 50 = 0")


_KNN = """
    s AS (SELECT a.vec_id AS q, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, (a.label = b.label)::DOUBLE AS same FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s)"""


@query(f"WITH {_KNN} SELECT k, round(avg(same), 6) AS precision FROM r JOIN (VALUES (1), (5), (10), (20)) t(k) ON rank <= k GROUP BY k")
def knn_precision_at_k(spark, sf):
    e = read(spark, sf, "embeddings")
    return rounded(vectors.precision_at_k(vectors.nearest_neighbours(_asked(e), e, 20, "vec_id", "embedding"), e, [1, 5, 10, 20], "vec_id", "label"))


@query(f"WITH {_KNN} SELECT q, id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def nearest_neighbours(spark, sf):
    e = read(spark, sf, "embeddings")
    return rounded(vectors.nearest_neighbours(_asked(e), e, 3, "vec_id", "embedding"))


@query("WITH c AS (SELECT count(*)::DOUBLE AS c FROM embeddings GROUP BY label) SELECT round(sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)), 6) AS base_rate FROM c")
def label_base_rate(spark, sf):
    return rounded(vectors.label_base_rate(read(spark, sf, "embeddings"), "label"))


@query(
    """WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) + 1e-6 AS d, avg(p_size) AS n, stddev_pop(p_size) + 1e-6 AS e FROM part)
    SELECT p_partkey, round((p_retailprice - m) / d, 6) AS price, round((p_size - n) / e, 6) AS size FROM part, s"""
)
def standardize(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return rounded(vectors.standardize(part, vectors.fit_scaler(part, ["price", "size"])))


@query()
def pca_project(spark, sf):
    out = vectors.pca(read(spark, sf, "embeddings"), "vec_id", "embedding", 8)
    # Signs of the axes are arbitrary, lengths are not.
    return rounded(out.select("vec_id", vectors.norm(F.col("projected")).alias("length")), 4)
