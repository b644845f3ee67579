"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrisk.llm.common import release, staged


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is its component's smallest node.

    A large-star step hangs each node's larger neighbours under its smallest neighbour, a small-star step its smaller
    ones; rounds are logarithmic in the longest path. Each round is written and read back, and minima are
    aggregated before the shuffle, so a node with very many edges is no hot spot in the aggregation, and the joins
    have one row per node on one side, which adaptive skew handling can split against."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    e, path = staged(e, "edges")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        new = (small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
               .unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        new, after = staged(new, "edges")
        release(spark, path)
        e, path, was, mark = new, after, mark, _mark(new)
        if mark == was:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
