"""Connected components by alternating star joins; rounds are written, nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (least node reachable) of the undirected edges ``a``, ``b``.

    Large star: each node's larger neighbours are linked to its least neighbour; small star: the
    smaller ones. Both together converge in a logarithmic number of rounds. A round aggregates
    before it shuffles, and splits no group by node, so a hub is a hot key of a join only, which
    adaptive execution splits."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "large-star")
        # every edge points down here, so the neighbours not above a node are its edges
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = written(small.filter("a <> b").distinct(), "small-star")
        stable = _same(edges, small)
        edges = small
        if stable:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _same(before: DataFrame, after: DataFrame) -> bool:
    """Both hold the same edges: counts and order-free checksums agree."""
    def sums(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return sums(before) == sums(after)
