"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagspark.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node can reach.

    `links` has whole numbers `a` and `b`; direction, repeats and loops do not matter, null ends
    are no links, and no links give no rows. Large and small stars alternate (Kiveris et al.,
    2014): all larger neighbours of a node move to the smallest node that it sees, then all
    smaller ones do. Each round is written to the shared folder, and the rounds end when the links
    stay the same, after a number of rounds that grows with the logarithm of the longest chain. A
    node's neighbours meet in a minimum and in a join whose other side has one row per node, so
    a node with most links is split like any other.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges, "links")
    before = None
    turn = 0
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, turn = now, turn + 1
        edges = cut_lineage(_small_star(_large_star(edges)), f"stars-{turn}")


# The minima are written before they are joined: only a join of two exchanges is split by key.


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge leads from a larger node `u` to a smaller one `v`."""
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")), "minima")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
