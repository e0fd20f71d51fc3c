"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u long, v long): the smallest node that it reaches.

    Each round sends every node to the smallest of itself and its neighbours and puts these in the links'
    place; links within one node vanish, and no link is left when all nodes of a component have become
    its smallest.  Stars vanish in one round, chains shrink by half or more.  What is left is written to the shared folder
    after each round.  Links of a node to itself add nothing; no links give no rows.  A node with very many links is
    split over tasks: the smallest neighbour is an aggregate with partial sums, and the joins have one row
    per node on their other side.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        if labels is None:
            labels = least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        else:
            labels = labels.join(least, F.col("component") == F.col("u"), "left").select("node", F.coalesce("m", "component").alias("component"))
        to = lambda name, m=least: m.select(F.col("u").alias(name), F.col("m").alias(f"{name}_m"))
        moved = edges.join(to("u"), "u").join(to("v"), "v").select(F.greatest("u_m", "v_m").alias("u"), F.least("u_m", "v_m").alias("v"))
        edges = stored(moved.where("u <> v"), "links")  # as they lie: equal links meet in the partial minima
    return labels
