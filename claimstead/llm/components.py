"""Connected components of a graph given by its edges, as alternating star contractions.

Every round replaces each node's edges by edges to the smallest of its neighbours, first for the larger
neighbours, then for the smaller ones; a component ends as a star. A node's smallest neighbour is a partial
aggregate, so no neighbourhood meets in one task, and each round is cut off in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.llm.common import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    """edges (u, v), u > v -> the same components, nearer to stars."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u > v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, kept: Scratch) -> DataFrame:
    """edges (a, b), longs -> node, label: the smallest node of its component, for nodes that aren't it themselves."""
    now = kept.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before, said = None, tuple(now.agg(*sums).first())
    while said != before:
        last, now, before = now, kept.keep(_stars(now), "edges"), said
        said = tuple(now.agg(*sums).first())
        kept.drop(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def joined_components(labels: DataFrame, edges: DataFrame, kept: Scratch) -> DataFrame:
    """labels, as of components(), after more edges (a, b)."""
    ends = edges
    for end in ("a", "b"):
        root = labels.select(F.col("node").alias(end), F.col("label").alias("root"))
        ends = ends.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    more = components(ends, kept)
    moved = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return kept.keep(moved.select("node", F.coalesce("to", "label").alias("label")).unionByName(more), "labels")
