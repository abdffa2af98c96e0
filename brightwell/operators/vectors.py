"""Vector operators on array<float> columns: pooling, cosine, scaling, nearest neighbours, PCA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Queries of a block in nearest_neighbours, whose vectors go to the driver and out with each task, and rows compared with
#: them at a time: a product has at most their product of doubles, 80 MB.
BLOCK_ROWS, CHUNK_ROWS = 10_000, 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pool(items: DataFrame, group: str, vector: str, method: str = "normmean") -> DataFrame:
    """(group, pooled): the mean of a group's vectors, scaled to length 1 unless it is all but zero.

    normmean scales each vector to length 1 first, mean does not. Groups
    without vectors are absent. Sums are by position, so a group of any size
    is pre-aggregated in each task.
    """
    if method not in ("mean", "normmean"):
        raise ValueError(f"unknown pooling method {method!r}")
    v = F.transform(vector, lambda x: x.cast("double"))
    if method == "normmean":
        length = norm(F.col(vector)) + 1e-9
        v = F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(length, F.size(vector)).alias("n")), lambda p: p["x"] / p["n"])
    cells = items.where(F.size(vector) > 0).select(group, F.posexplode(v).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"))
    mean = cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("p"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return mean.select(group, F.when(F.col("n") > 1e-9, F.transform("p", lambda x: x / F.col("n"))).otherwise(F.col("p")).alias("pooled"))


def pair_cosine_dot(vectors: DataFrame, pairs: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(u, v, cos, dot) of each pair."""
    a = vectors.select(F.col(id_col).alias("u"), F.col(vector).alias("a"))
    b = vectors.select(F.col(id_col).alias("v"), F.col(vector).alias("b"))
    d = dot(F.col("a"), F.col("b"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", (d / (norm(F.col("a")) * norm(F.col("b")) + 1e-9)).alias("cos"), d.alias("dot"))


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation + 1e-6 of each column: as many numbers as columns."""
    row = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return {c: (row[f"m_{c}"] or 0.0, (row[f"s_{c}"] or 0.0) + 1e-6) for c in columns}


def standardize(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def nearest_neighbours(queries: DataFrame, base: DataFrame, k: int, id_col: str, vector: str, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, id, sim, rank): the k rows of base nearest by dot product to each query, itself excluded; ties by id.

    A stated query set (a hundredth or less of a large base) against all rows,
    one pass over them for each block: queries go in blocks of at most
    block_rows, held as a matrix by each task, which keeps its best k of each
    query over all its batches; only those are shuffled to be ranked. Products
    are matrix products in a worker, as array lambdas are some hundred times
    slower; they are rounded to 12 digits, so that equal vectors tie.
    """
    total = queries.count()
    blocks = max(1, -(-total // block_rows))
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out, so that a small file is not one task.
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("b")).repartition(parts, "id")
    out = None
    for block in range(blocks):
        part = queries.select(F.col(id_col).cast("bigint").alias("q"), F.col(vector).alias("a"))
        part = part if blocks == 1 else part.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        near = _block_neighbours(part.orderBy("q").collect(), rows, k)
        out = near if out is None else out.unionByName(near)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= k)


def _block_neighbours(block: list, rows: DataFrame, k: int) -> DataFrame:
    """(q, id, sim): each task's best k rows for each query of the block."""
    names = np.array([r["q"] for r in block], dtype=np.int64)
    matrix = np.array([r["a"] for r in block], dtype=np.float64).reshape(len(block), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sims = np.empty((len(names), 0), dtype=np.int64), np.empty((len(names), 0))
        for b in (batch.slice(at, CHUNK_ROWS) for batch in batches for at in range(0, batch.num_rows, CHUNK_ROWS)):
            here = b.column(0).to_numpy()
            other = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            s = np.round(matrix @ other.T, 12)
            s[names[:, None] == here[None, :]] = -np.inf
            ids, sims = np.hstack([ids, np.broadcast_to(here, s.shape)]), np.hstack([sims, s])
            best = np.lexsort((ids, -sims), axis=-1)[:, :k]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        ok = np.isfinite(sims)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], ids.shape)[ok]), pa.array(ids[ok]), pa.array(sims[ok])], names=["q", "id", "sim"])

    return rows.mapInArrow(run, "q bigint, id bigint, sim double")


def precision_at_k(neighbours: DataFrame, labels: DataFrame, ks: list[int], id_col: str, label: str) -> DataFrame:
    """(k, precision): the share of the k nearest that have the query's label, over all queries."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label).alias("l"))
    both = neighbours.join(lab, "id").join(lab.select(F.col("id").alias("q"), F.col("l").alias("m")), "q")
    grid = F.explode(F.array(*map(F.lit, ks))).alias("k")
    return both.select("rank", (F.col("l") == F.col("m")).cast("double").alias("same"), grid).where("rank <= k").groupBy("k").agg(F.avg("same").alias("precision"))


def label_base_rate(df: DataFrame, label: str) -> DataFrame:
    """The chance that another row has the same label: sum c(c-1) / (n(n-1))."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return counts.agg((F.sum(F.col("c") * (F.col("c") - 1)) / (F.sum("c") * (F.sum("c") - 1))).alias("base_rate"))


def pca(df: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(id, projected): centred vectors on their k principal axes (signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    means = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()  # one number for each dimension
    centre = F.array(*(F.lit(r["m"]) for r in means))
    centred = df.select(id_col, array_to_vector(F.zip_with(vector, centre, lambda x, m: x.cast("double") - m)).alias("f"))
    return PCA(k=k, inputCol="f", outputCol="p").fit(centred).transform(centred).select(id_col, vector_to_array("p").alias("projected"))
