"""Connected components of a long edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of an edge between two different nodes.

    Each round links every node's larger neighbours to its smallest one (large star), then its smaller neighbours (small star), until the
    edges are stars. Rounds grow with the logarithm of the longest path; each is written to the shared checkpoint folder. Smallest
    neighbours are found by aggregation, so a hub is combined before its shuffle; no neighbour list is ever built.
    """
    edges = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "edges")
    mark = _mark(edges)
    while True:
        large = _star(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        small = _star(large, larger=False)
        after = stored(small, "edges")
        before, mark, edges = mark, _mark(after), after
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums over hashes of the different edges, which tell one set of edges from another."""
    h, g = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(g), F.sum(h.cast("decimal(38,0)"))).first())


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Edges ``(u, v)`` with ``u > v`` after one star step; ``links`` lists each node's neighbours (``larger``) or its smaller ones."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Merged and not broadcast: rounds are many, and what is broadcast goes through the driver.
    joined = links.join(least.hint("merge"), "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()
