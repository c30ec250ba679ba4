"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of a table (a long, b long) of links.

    The component is its smallest node. Only linked nodes are returned; a node
    without links is its own component. Links to itself and repeated links are
    harmless. Every round hangs larger neighbours, then smaller ones, below the
    smallest neighbour, so rounds grow with the logarithm of a chain. Every table
    between rounds is written to the shared folder; nothing reaches the driver
    but a count.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = cut_lineage(links, "links")
    while True:
        # A star forest has one lower neighbour per node and no node that is both.
        above = links.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        below = links.select(F.col("lo").alias("hi"), F.lit(True).alias("chained")).distinct()
        state = above.join(below, "hi", "left").agg(F.max("n").alias("n"), F.max("chained").alias("chained")).first()
        if (state.n is None) or (state.n == 1 and not state.chained):
            break
        links = cut_lineage(_small_stars(_large_stars(links)), "links")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _large_stars(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the smallest node around it."""
    around = links.select(F.col("hi").alias("u"), F.col("lo").alias("m")).unionByName(links.select(F.col("lo").alias("u"), F.col("lo").alias("m")))
    least = around.groupBy("u").agg(F.min("m").alias("m"))
    moved = links.join(least, links.lo == least.u).select("hi", F.col("m").alias("lo"))
    return moved.distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node below the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
