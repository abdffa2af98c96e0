"""Ranks and running sums over all rows without one task that reads them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import written


def running(df: DataFrame, order: Sequence[str | Column], *, by: Sequence[str] = (), value: str | None = None, how: str = "sum", parts: int | None = None) -> DataFrame:
    """Add rank (from 1) and, with a value, cum (its running sum, or maximum by how="max") in a total order, within each `by`.

    Rows are ranged by `by` and the order and written, so that a lost block is
    read again and not ranged anew. They are numbered in their range, and each
    range starts from the totals of those before it; only the totals (a row
    for each range and `by`) go through a wider window.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *by, *order).withColumn("part__", F.spark_partition_id()), "ranges")
    fold = {"sum": F.sum, "max": F.max}[how]
    add = F.lit(0) if value is None else F.col(value)
    totals = ranged.groupBy(*by, "part__").agg(F.count(F.lit(1)).alias("n__"), fold(add).alias("s__"))
    ahead = W.partitionBy(*by).orderBy("part__").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*by, "part__", F.coalesce(F.sum("n__").over(ahead), F.lit(0)).alias("n0__"), (F.coalesce(F.sum("s__").over(ahead), F.lit(0)) if how == "sum" else F.max("s__").over(ahead)).alias("s0__"))
    inside = W.partitionBy(*by, "part__").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumn("n1__", F.row_number().over(inside))
    if value is not None:
        local = local.withColumn("s1__", fold(value).over(inside))
    right = before.select(*(F.col(c).alias(f"{c}__of") for c in by), F.col("part__").alias("at__"), "n0__", "s0__")
    on = [F.col("part__") == F.col("at__"), *(F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in by)]
    # One row for each range that a `by` has rows in.
    out = local.join(F.broadcast(right), on).withColumn("rank", (F.col("n0__") + F.col("n1__")).cast("bigint"))
    if value is not None:
        out = out.withColumn("cum", F.col("s0__") + F.col("s1__") if how == "sum" else F.greatest("s0__", "s1__"))
    return out.select(*df.columns, "rank", *(["cum"] if value is not None else []))
