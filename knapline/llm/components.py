"""Connected components of an edge table, without the driver holding any of it.

Each task first reduces its own edges to stars; then large-star and small-star rounds alternate until nothing
changes. Every round's table is written to the shared folder, and deleted after
the next one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released, rows, settle

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Roots:
    """Union-find over any keys; the smallest key of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, at = self.up, x
        while (y := up.get(at, at)) != at:
            at = y
        while (y := up.get(x, x)) != at:
            up[x], x = at, y
        return at

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


@released
def _stars(batches):
    """A task's edges as stars; given out and forgotten once they are many."""
    roots, n = Roots(), 0

    def out():
        nodes = [x for x in roots.up if roots.find(x) != x]
        return rows(EDGE, nodes, [roots.find(x) for x in nodes])

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            n += roots.join(x, y)
        if n > 500_000:
            yield out()
            roots, n = Roots(), 0
    if n:
        yield out()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long and not null: root is the least node that edges
    lead to. Loops and repeated edges change nothing; no edges give no rows."""
    spark = edges.sparkSession
    old, new = Scratch(spark), Scratch(spark)
    with old, new:
        now = new.settle(edges.where("a <> b").mapInArrow(_stars, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        seen = None
        for _ in range(rounds):
            mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if mark == seen or not mark["n"]:
                break
            seen = mark
            both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            first = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(first, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
            old, new = new, old
            now = new.settle(small.where("a <> b").distinct())
            old.drop()
        else:
            raise RuntimeError("components did not settle")
        return settle(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
