"""Connected components by alternating stars, with lineage cut at files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node in links(a, b), self-links and repeats allowed.

    Large-star joins every node's larger neighbours to its smallest one, small-star its smaller ones; a node's
    neighbours are never gathered, only their minimum is, by partial aggregates. In the joins a hub's links have one key: Spark splits them
    at run time (adaptive execution), else they meet in one task. The number of links doesn't grow. Ends when a round changes nothing; the rounds grow with the logarithm of the longest path.
    """
    edges = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    total = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: a's neighbours above a link to the least of a and its neighbours
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # small-star: a and its neighbours below a link to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where(F.col("a") != F.col("b")).distinct()
        edges = materialise(small, "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == total or not now["n"]:
            break
        total = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
