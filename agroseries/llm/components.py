"""Connected components of a link table, by hooking and shortcutting with joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroseries.sources.shared import saved


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Each round, a node and its parent take the smallest grandparent among the neighbours, and nodes
    shortcut to their grandparent; the rounds grow with the logarithm of the longest path. Parents
    are written to the shared folder each round. All groupings are minima, combined before the
    shuffle, so a component or a hub with most of the nodes stays spread.
    """
    there = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = saved(there.unionByName(there.select(F.col("other").alias("node"), F.col("node").alias("other"))), "edges")
    state = saved(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), "parents")
    while True:
        up = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        now = saved(state.join(up, "parent").select("node", "parent", "grand"), "grand")
        seen = now.select(F.col("node").alias("other"), F.col("grand").alias("offer"))
        offers = edges.join(seen, "other").groupBy("node").agg(F.min("offer").alias("offer"))
        best = F.least("offer", "grand")
        moves = F.array(
            F.struct(F.col("node"), best.alias("parent")),
            F.struct(F.col("parent").alias("node"), best.alias("parent")),
        )
        hooked = now.join(offers, "node").select(F.inline(moves)).groupBy("node").agg(F.min("parent").alias("parent"))
        state = saved(hooked, "parents")
        moved = now.join(state.withColumnRenamed("parent", "new"), "node")
        if moved.where((F.col("new") != F.col("parent")) | (F.col("grand") != F.col("parent"))).isEmpty():
            return state.withColumnRenamed("parent", "label")
