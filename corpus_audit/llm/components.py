"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import shared_folder


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest node of its neighbourhood.

    ``larger``: the larger neighbours of a node, else the smaller ones and the node itself.  The smallest node
    comes from an aggregation and a join, so a node with many neighbours is pre-aggregated and its join split.
    """
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = pairs.join(least, "a")
    if larger:
        linked = linked.where("b > a").select(F.col("b").alias("x"), "m")
    else:
        linked = linked.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    return linked.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(node, component)``, the component being its smallest node.

    Alternates two star operations, which takes a number of rounds logarithmic in the longest path, until
    nothing changes.  Each round is checkpointed.  Nodes without an edge to another node have no row.
    """
    shared_folder(edges.sparkSession)
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = tuple(mark)
        large = _star(_both_ways(current), larger=True)
        current = _star(large, larger=False).checkpoint()
