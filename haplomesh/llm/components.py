"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (larger ones, or smaller ones and itself) to its least neighbour.

    ``both`` holds (node, other). The least neighbour is an aggregate with
    map-side combine, joined back, so a hub's edges never meet in one task.
    """
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))
    joined = both.join(materialise(least, "least"), "node")
    if large:
        return joined.filter("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    return joined.select(F.col("other").alias("a"), F.col("low").alias("b")).union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its least node.

    Each round is written to the shared folder, so that a lost executor costs
    one round, and the tables of the round before go. The rounds end when the
    edges no longer change: the sum of the edges' lower ends falls in every
    other round, so there is an end. Loops and repeated edges are allowed; null
    ends are dropped.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    nodes = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    state = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if state.isEmpty():
        return nodes.select("node", F.col("node").alias("component"))
    before, now = None, ()
    while now != before:
        before = now
        with scratch(spark) as keep:
            both = state.select(F.col("a").alias("node"), F.col("b").alias("other")).union(state.select(F.col("b").alias("node"), F.col("a").alias("other")))
            grown = materialise(_star(both, True).filter("a <> b").distinct(), "large")
            down = grown.select(F.col("a").alias("node"), F.col("b").alias("other"))
            state = keep(_star(down, False).filter("a <> b").distinct(), "small")
        now = state.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).head()
    return nodes.join(state.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
