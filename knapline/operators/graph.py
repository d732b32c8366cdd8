"""Connected components within keys, by hooking and pointer jumping: no key's edges meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Scratch, settle


def _jumped(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, v, p) with p, smaller than v, replaced by where its own hooks lead in the end."""
    while True:
        up = hooks.select("key", F.col("v").alias("p"), F.col("p").alias("q"))
        hooks = scratch.settle(hooks.join(up, ["key", "p"], "left").select("key", "v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        if not hooks.where("moved").limit(1).count():
            return hooks.select("key", "v", "p")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, v, component) of nodes (key, v), which edges (key, a, b) connect: the least node of each component. Nodes are
    named once; loops and repeated edges change nothing; edges to no node and null ends are ignored.

    In a round each root hooks to its least neighbour if that is smaller, chains of hooks are cut short by pointer jumping,
    and the edges between the roots that are left go on. A node follows the rounds' hooks one after another.
    """
    with Scratch(nodes.sparkSession) as scratch:
        labels = scratch.settle(nodes.select("key", F.col("v"), F.col("v").alias("component")))
        known = labels.select("key", F.col("v").alias("a"))
        live = edges.where("a <> b").select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = scratch.settle(live.join(known, ["key", "a"], "left_semi").join(known.withColumnRenamed("a", "b"), ["key", "b"], "left_semi"))
        while live.limit(1).count():
            # a < b: only the greater end can hook to the other.
            hooks = scratch.settle(live.groupBy("key", F.col("b").alias("v")).agg(F.min("a").alias("p")))
            hooks = _jumped(hooks, scratch)
            to = lambda name, new, h=hooks: h.select("key", F.col("v").alias(name), F.col("p").alias(new))
            labels = scratch.settle(labels.join(to("component", "_p"), ["key", "component"], "left").select("key", "v", F.coalesce("_p", "component").alias("component")))
            ends = live.join(to("a", "_a"), ["key", "a"], "left").join(to("b", "_b"), ["key", "b"], "left").select("key", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
            live = scratch.settle(ends.where("a <> b").select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        return settle(labels)
