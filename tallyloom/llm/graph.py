"""Connected components of an edge table, by alternating large and small stars.

Edges stay distributed throughout. Every round is written to the shared folder, in as many files
as the edges of the round before need, so lineage stays short; the number of rounds is logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import written

#: Edges of a file, about: the number of partitions may be far above what a round's edges need.
EDGES = 1 << 15


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b) that has another neighbour."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "components")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("x"), F.least("u", "low").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        e = written(small.where(F.col("u") != F.col("v")).distinct().coalesce(1 + mark[0] // EDGES), "components")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _mark(e: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
