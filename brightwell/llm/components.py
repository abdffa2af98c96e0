"""Connected components of a graph given by edges, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch

#: Rounds after which it gives up; each round at least halves the depth of the trees.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of the edges (a, b of one type that can be ordered).

    Alternating star contraction: in a large star each node links its larger
    neighbours to its smallest one, in a small star its smaller ones. Both are
    a minimum by node and a join on the node, rows stay at most the edges'.
    A hub's rows are split by the adaptive skew join. Each round is written to
    the shared folder, the one before the last is deleted; the driver sees
    only two counts a round.
    """
    spark = edges.sparkSession
    schema = edges.select("a", "b").schema
    past: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = scratch(spark, "components")
        df.write.mode("overwrite").parquet(path)
        past.append(path)
        while len(past) > 2:
            drop_path(spark, past.pop(0))
        return spark.read.schema(schema).parquet(path)

    # a > b throughout
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        now = keep(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = seen
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
