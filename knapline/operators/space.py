"""Nearest points in space, within a key, by cells: no pair of points is ever a row.

A key's space is cut into cells with about equally many points: slabs across x, each cut across y, those cut across z. A
query first looks into the cell that it lies in; what it finds there bounds its search, and it then visits just the cells that
come as near as the farthest of its k, if there are any. A cell's points are compared with its visitors in numpy, and k
rows a visit come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import Scratch, settle

AXES = "xyz"
CELL = 1024
#: A table with a row a key is broadcast up to so many keys, one of boundaries up to so many numbers.
KEYS = 100_000
NUMBERS = 1_000_000


def _slot(edges: Column, value: Column) -> Column:
    """How many of the edges lie at or below a value."""
    return F.size(F.filter(edges, lambda e: e <= value))


class Cells:
    """The cells of points (key, p, x, y, z). `powers`: a key with 2^j slabs an axis has j; `edges`: for each axis a
    table (key, path, edges) of the boundaries within each part that the axes before it made."""

    def __init__(self, points: DataFrame, cell: int, scratch: Scratch):
        n = points.groupBy("key").agg(F.count("*").alias("n"))
        power = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / cell) / 3)).cast("int")
        self.powers = scratch.settle(n.select("key", power.alias("power")))
        self.most = self.powers.agg(F.max("power")).first()[0] or 0
        self.edges: list[DataFrame] = []
        if not self.most:
            return
        placed = points.join(F.broadcast(self.powers) if self.powers.count() <= KEYS else self.powers, "key").withColumn("path", F.lit(0).cast("long"))
        whole = 1 << self.most
        for axis in AXES:
            cuts = F.percentile_approx(axis, [i / whole for i in range(1, whole)], 2_000)
            step = F.pow(F.lit(2), self.most - F.first("power")).cast("int")
            grown = placed.groupBy("key", "path").agg(cuts.alias("cuts"), step.alias("step"))
            # A key takes every step-th of the finest cuts.
            edges = F.filter("cuts", lambda _, i: (i + 1) % F.col("step") == 0)
            table = scratch.settle(grown.select("key", "path", edges.alias("edges")))
            self.edges.append(F.broadcast(table) if table.count() * whole <= NUMBERS else table)
            placed = self._down(placed, axis)

    def _with_edges(self, df: DataFrame, axis: str) -> DataFrame:
        return df.join(self.edges[AXES.index(axis)], ["key", "path"], "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))

    def _down(self, df: DataFrame, axis: str) -> DataFrame:
        found = self._with_edges(df, axis)
        return found.withColumn("path", F.col("path") * (1 << self.most) + _slot(F.col("edges"), F.col(axis))).drop("edges")

    def home(self, df: DataFrame) -> DataFrame:
        """df with `path`, the cell of each point."""
        df = df.withColumn("path", F.lit(0).cast("long"))
        for axis in AXES if self.most else "":
            df = self._down(df, axis)
        return df

    def around(self, df: DataFrame, reach: Column) -> DataFrame:
        """df with a row for every cell that comes within `reach` of the point."""
        df = df.withColumn("path", F.lit(0).cast("long")).withColumn("_reach", reach)
        for axis in AXES if self.most else "":
            found = self._with_edges(df, axis)
            lo, hi = (_slot(F.col("edges"), F.col(axis) + sign * F.col("_reach")) for sign in (-1, 1))
            df = found.withColumn("_slot", F.explode(F.sequence(lo, hi))).withColumn("path", F.col("path") * (1 << self.most) + F.col("_slot")).drop("edges", "_slot")
        return df.drop("_reach")


def _compared(k: int, kinds: dict[str, str]):
    """The k nearest points of a cell for each of its visitors, ties to the smaller p."""

    def near(visits: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("p")
        x, ids = np.column_stack([np.asarray(points.column(c)) for c in AXES]), points.column("p")
        at = np.column_stack([np.asarray(visits.column(c)) for c in AXES])
        rows, hits, far = [], [], []
        step = max(1, 1_000_000 // max(1, len(x)))
        for lo in range(0, len(at) if len(x) else 0, step):
            part = at[lo : lo + step]
            d = sum((part[:, c, None] - x[None, :, c]) ** 2 for c in range(3))
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(lo, lo + len(part)), top.shape[1]))
            hits.append(top.ravel())
            far.append(np.take_along_axis(d, top, axis=1).ravel())
        rows, hits, far = (np.concatenate(v) if v else np.empty(0, int) for v in (rows, hits, far))
        return pa.table({"key": visits.column("key").take(rows), "q": visits.column("q").take(rows), "p": ids.take(hits), "d": pa.array(far, pa.float64())})

    return near, f"key {kinds['key']}, q {kinds['q']}, p {kinds['p']}, d double"


def nearest(queries: DataFrame, points: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """(key, q, rank, p, d): of every query (key, q, x, y, z) the k nearest of the points (key, p, x, y, z) of its key, by
    squared distance d, ties to the smaller p, rank from 1; all of them where they are fewer.

    (key, q) and (key, p) name their rows. Queries of a key without points, rows with a null and NaN coordinates take no
    part. Of points at one place no more than k with the smallest p can be among the nearest, so that no more are kept,
    and a cell stays small however many copies a place has.
    """
    spark = points.sparkSession
    clean = lambda df, name: df.select("key", name, *(F.col(c).cast("double").alias(c) for c in AXES)).where(" and ".join(f"{c} is not null and not isnan({c})" for c in AXES) + f" and key is not null and {name} is not null")
    queries, points = clean(queries, "q"), clean(points, "p")
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *points.schema)}
    best = W.partitionBy("key", "q").orderBy("d", "p")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("key", "q", "rank", "p", "d")
    fn, schema = _compared(k, kinds)
    meet = lambda visits, cells: visits.groupBy("key", "path").cogroup(cells.groupBy("key", "path")).applyInArrow(fn, schema)
    cell = max(cell, 4 * k)
    most = points.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= cell:  # a key is a cell
        whole = lambda df: df.withColumn("path", F.lit(0).cast("long"))
        return ranked(meet(whole(queries), whole(points)))
    with Scratch(spark) as scratch:
        place = W.partitionBy("key", *AXES).orderBy("p")
        points = scratch.settle(points.withColumn("_copy", F.row_number().over(place)).where(F.col("_copy") <= k).drop("_copy"))
        cells = Cells(points, cell, scratch)
        dealt = scratch.settle(cells.home(points))
        first = scratch.settle(meet(cells.home(queries), dealt))
        # Fewer than k found: no bound, every cell of the key is visited.
        bound = first.groupBy("key", "q").agg(F.max("d").alias("far"), F.count("*").alias("n"))
        reach = F.when(F.col("n") >= k, F.sqrt("far") * (1 + 1e-9)).otherwise(float("inf"))
        bounded = queries.join(bound, ["key", "q"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        visits = scratch.settle(cells.around(bounded.select("key", "q", *AXES, reach.alias("far")), F.col("far")).drop("far"))
        own = cells.home(queries).select("key", "q", "path")
        others = meet(visits.join(own, ["key", "q", "path"], "left_anti"), dealt)
        return settle(ranked(first.unionByName(others)))
