"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.session import stage


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (two columns of one type, in either direction).

    Large-star and small-star steps in turn (Kiveris et al., Connected Components
    in MapReduce and Beyond, 2014): each node's neighbours are hung below its
    least neighbour until every component is a star around its least node. Minima
    are combined before they are shuffled, and each round is written to the
    shared folder, so a lost executor costs one round. Loops and repeated links are
    allowed; an empty table gives no rows.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = stage(links.select(a.alias("u"), b.alias("v")).filter("u != v").distinct(), "links")
    told = _mark(edges)
    while told[0]:
        edges = stage(_small_star(_large_star(edges)), "links")
        before, told = told, _mark(edges)
        if told == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
