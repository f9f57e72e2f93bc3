"""Connected components of links, by rounds of star contractions over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): the smallest node of each one's component.

    Each round links every node's larger neighbours to the smallest, then its smaller ones;
    it ends when a round changes nothing. Neighbours are never gathered in a list: a
    minimum for each node, with partial minima before the shuffle, is joined back.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        edges = written(small.where("a <> b").distinct())
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
