"""Connected components of links between ids, by alternating stars in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``links`` (a, b), the component named by its smallest id.

    Each round ties a node's larger neighbours, then its smaller ones, to its
    smallest; rounds grow with the logarithm of a component's size.  A node's
    minimum is a partial aggregate and joins back on the node, so a node with
    very many links is an ordinary skewed join.  A link of an id to itself
    keeps that id.
    """
    alone = links.filter("a = b").select(F.col("a").alias("id")).distinct()
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a")
        edges = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = written(edges, name)
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = found.unionByName(roots)
    return found.unionByName(alone.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
