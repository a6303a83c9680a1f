"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two aggregates and joins over the links; nothing but a count reaches the driver. Links are rows (a, b)
of longs. The smallest id of a component names it. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """id, component for every id that has a link to another one."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        large = _star(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True)
        small = written(_star(large, large=False), "links")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(edges)
        edges = small
        if tuple(state) == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
        before = tuple(state)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: edges both ways; every neighbour above u is linked to the smallest around u. Else: edges downward;
    every neighbour of u, and u itself, is linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = low.repartition(F.xxhash64("u"))  # so the join deals the edges itself, and may split those of a hub
    if large:
        out = edges.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
