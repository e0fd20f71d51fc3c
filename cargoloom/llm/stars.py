"""Linked groups from bucket entries, with star-shaped candidates.

Within a bucket only pairs with its centre (the smallest node) are candidates, so their number follows the
number of entries.  After they are judged, a centre has met every member and leaves the bucket.  Nodes of buckets
whose other members aren't in one component yet are put together, with all that share a bucket with
them, and go through more rounds, with MORE times as many centres in each; only pairs of different
components are asked.  A group of no more members than centres has all of them as centres and is done.  So no pair of a bucket
is left out that could still join two components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Growth of the number of centres from round to round.
MORE = 64
#: Tasks over which the members of one group meet its centres.
SHARES = 16


def star_components(entries: DataFrame, facts: DataFrame, may_link: Callable[[Column, Column], Column], prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(node, component) of the nodes that have links; ``entries`` are (key, node).

    ``facts`` are (node, fact), one row per node; ``may_link`` tells of two facts whether their nodes can be linked at
    all, and is part of the joins that make pairs.  ``prepare`` takes all nodes that may be compared and gives the function
    that confirms pairs (c, v).  The joins on the key are plain: a bucket that holds much of the entries is
    split by Spark, its centre being one row.
    """
    of = lambda name: facts.select(F.col("node").alias(name), F.col("fact").alias(f"{name}_fact"))
    centres = entries.groupBy("key").agg(F.min("node").alias("c"))
    rest = stored(entries.join(centres, "key").where("node > c").select("key", "c", "node"), "buckets")
    nodes = rest.select(F.col("c").alias("node")).unionByName(rest.select("node")).distinct()
    confirm, fan = prepare(nodes), 1
    first = rest.select("c", F.col("node").alias("v")).distinct().join(of("c"), "c")
    others = of("v").withColumnRenamed("v", "at")
    tested = stored(first.join(others, (F.col("v") == F.col("at")) & may_link(F.col("c_fact"), F.col("v_fact"))).select("c", "v"), "pairs")
    links = new = stored(confirm(tested), "confirmed")
    rest, labels = rest.select("key", "node"), None
    while True:
        if labels is None or not new.isEmpty():
            labels = stored(components(links.select(F.col("c").alias("u"), F.col("v").alias("v"))), "components")
        known = rest.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("least"), F.count("*").alias("members")).where("lo < hi").select("key", "least", "members")
        rest = stored(known.join(mixed, "key"), "buckets")
        if rest.isEmpty():
            return labels
        if fan == 1:  # from now on a node has one key, the smallest node that shared buckets lead to
            together = components(rest.select(F.col("node").alias("u"), F.col("least").alias("v")))
            together = stored(together.select("node", F.col("component").alias("key")), "groups")
            rest = rest.select("node", "component").distinct().join(together, "node").join(together.groupBy("key").agg(F.count("*").alias("members")), "key")
            rest = stored(rest, "buckets")
        fan *= MORE
        rows = rest.select("key", "node", "component").join(facts, "node").withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SHARES)))
        part = F.when(F.col("members") > fan, F.pmod(F.xxhash64("node"), F.lit(fan))).otherwise(F.col("node"))
        centres = rest.groupBy("key", part.alias("part")).agg(F.min("node").alias("node")).select("key", "node")
        heads = rows.join(centres, ["key", "node"]).select(
            F.col("key").alias("at"), F.col("node").alias("c"), F.col("component").alias("c_component"), F.col("fact").alias("c_fact"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("c_share"))
        asked = rows.join(heads, (F.col("key") == F.col("at")) & (F.col("share") == F.col("c_share")) & (F.col("component") != F.col("c_component"))
                          & may_link(F.col("fact"), F.col("c_fact")))
        pairs = stored(asked.select(F.least("c", "node").alias("c"), F.greatest("c", "node").alias("v")).distinct().join(tested, ["c", "v"], "left_anti"), "pairs")
        new = stored(confirm(pairs), "confirmed")
        links, tested = links.unionByName(new), tested.unionByName(pairs)
        rest = rest.select("key", "node").join(centres, ["key", "node"], "left_anti")
