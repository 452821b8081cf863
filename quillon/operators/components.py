"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.cuts import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): every node with the least node that edges lead to from it.

    Edges are moved between stars until all are: a node hands its greater neighbours
    to its least one, then its smaller ones. The number of edges stays, that of rounds
    is logarithmic. Of a node with very many neighbours only the least is aggregated, before
    the shuffle; nothing is gathered. Null ends make no edge.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        met = large.join(least, F.col("a") == F.col("n"))
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        small = cut(small)
        moved = not small.exceptAll(edges).isEmpty()
        edges = small
        if not moved:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
