"""Point sampling on surfaces, farthest-point sampling, patches and splits.

Random numbers come from hashes of (mesh, index, seed): a mesh's sample doesn't depend on other meshes, on
partitioning, or on a task being run again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import barycentric
from . import geometry, space
from .lineage import Scratch, settle
from .ordinals import numbered


XYZ = ["x", "y", "z"]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts alone."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*parts), 11), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def weights(vertices: DataFrame, faces: DataFrame, mode: str = "uniform", m: DataFrame | None = None) -> DataFrame:
    """(mesh_id, fid, w): each face's share of its mesh's samples. uniform: area; curvature: area by 1 + 3 mean corner
    curvature; edge: area by 1 + 5 dihedral / pi. A mesh without area has null weights. m: measured(), if at hand."""
    m = geometry.measured(vertices, faces) if m is None else m
    if mode == "curvature":
        k = geometry.curvature(vertices, faces, m)
        spread = m.select("mesh_id", "fid", "area", F.explode(F.array("a", "b", "c")).alias("vid")).join(geometry.shuffled(k), ["mesh_id", "vid"])
        raw = spread.groupBy("mesh_id", "fid").agg((F.first("area") * (1 + 3 * F.avg("curvature"))).alias("raw"))
    elif mode == "edge":
        d = geometry.max_dihedral(vertices, faces, m=m)
        raw = m.select("mesh_id", "fid", "area").join(geometry.shuffled(d), ["mesh_id", "fid"]).select("mesh_id", "fid", (F.col("area") * (1 + 5 * F.col("dihedral") / F.pi())).alias("raw"))
    elif mode == "uniform":
        raw = m.select("mesh_id", "fid", F.col("area").alias("raw"))
    else:
        raise ValueError(f"unknown sampling mode {mode!r}")
    total = F.sum("raw").over(W.partitionBy("mesh_id"))
    return raw.select("mesh_id", "fid", F.when(total > 0, F.col("raw") / total).alias("w"))


def sample(vertices: DataFrame, faces: DataFrame, points: int, mode: str = "uniform", seed: int = 42, m: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(mesh_id, pid, x, y, z, nx, ny, nz): `points` points on each mesh, with replacement, by inverse cumulative
    weights. Meshes without area give no rows. m: measured(), if at hand. Weights are read twice: `keep` may settle them."""
    m = geometry.measured(vertices, faces) if m is None else m
    w = keep(weights(vertices, faces, mode, m).where("w > 0"))
    upto = F.sum("w").over(W.partitionBy("mesh_id").orderBy("fid"))
    ranges = w.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("w"))
    last = F.max("fid").over(W.partitionBy("mesh_id"))
    ranges = ranges.withColumn("hi", F.when(F.col("fid") == last, 1.0).otherwise(F.col("hi")))
    # Draws are dealt into as many cells as a mesh has points; a face's range covers few of them.
    draws = w.select("mesh_id").distinct().select("mesh_id", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("pid"))
    draws = draws.withColumn("u", uniform(F.col("mesh_id"), F.col("pid"), F.lit(seed))).withColumn("cell", F.floor(F.col("u") * points))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * points), F.least(F.floor(F.col("hi") * points), F.lit(points - 1)))))
    hit = draws.join(geometry.shuffled(cells.select("mesh_id", "cell", "fid", "lo", "hi")), ["mesh_id", "cell"]).where("u >= lo and u < hi").select("mesh_id", "pid", "fid")
    hit = hit.dropDuplicates(["mesh_id", "pid"])
    r1, r2 = uniform(F.col("mesh_id"), F.col("pid"), F.lit(seed + 1)), uniform(F.col("mesh_id"), F.col("pid"), F.lit(seed + 2))
    u, v, t = barycentric(r1, r2)
    at = [(u * F.col(f"a{k}") + v * F.col(f"b{k}") + t * F.col(f"c{k}")).alias(k) for k in "xyz"]
    return hit.join(geometry.shuffled(m), ["mesh_id", "fid"]).select("mesh_id", "pid", *at, "nx", "ny", "nz")


def sample_edge_aware(vertices: DataFrame, faces: DataFrame, points: int, edge_ratio: float = 0.3, seed: int = 42, m: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A share of edge-weighted points after the uniform ones, numbered on. m and keep as in sample."""
    n = max(1, int(points * edge_ratio))
    flat = sample(vertices, faces, points - n, "uniform", seed, m, keep)
    sharp = sample(vertices, faces, n, "edge", seed + 10, m, keep).withColumn("pid", F.col("pid") + (points - n))
    return flat.unionByName(sharp)


def resize(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n points of each mesh: a random part of more, or all and random repeats of fewer."""
    order = W.partitionBy("mesh_id").orderBy(F.xxhash64("mesh_id", "pid", F.lit(seed)), "pid")
    ranked = points.withColumn("r", F.row_number().over(order) - 1).withColumn("m", F.count("*").over(W.partitionBy("mesh_id")))
    copies = F.expr(f"sequence(0, cast(({n} - 1 - r) div m as int))")
    return ranked.where(F.col("r") < n).select("*", F.explode(copies).alias("lap")).select("mesh_id", (F.col("r") + F.col("lap") * F.col("m")).cast("int").alias("pid"), *[c for c in points.columns if c not in ("mesh_id", "pid")])


LARGE = 100_000  # points from which a cloud is more than one task's work


def farthest(points: DataFrame, n: int, key: str = "mesh_id", index: str = "pid", large: int = LARGE) -> DataFrame:
    """(key, g, pid): farthest-point sampling from the first point; ties go to the first. A cloud of up to `large` points
    is one task's work and holds three numbers a point; in larger ones all tasks look for each next point."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        x = pdf[["x", "y", "z"]].to_numpy(float)
        near, at, out = np.full(len(x), np.inf), 0, []
        for _ in range(min(n, len(x))):
            out.append(at)
            near = np.minimum(near, ((x - x[at]) ** 2).sum(axis=1))
            at = int(near.argmax())
        return pd.DataFrame({key: pdf[key].iloc[0], "g": range(len(out)), index: pdf[index].to_numpy()[out]})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    in_groups = lambda p: p.select(key, index, *XYZ).groupBy(key).applyInPandas(pick, f"{key} {kinds[key]}, g int, {index} {kinds[index]}")
    big = points.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > large).select(key)
    if not big.limit(1).count():
        return in_groups(points)
    shared = _farthest_of_all(points.join(big, key, "left_semi").select(F.col(key).alias("key"), F.col(index).alias("p"), *XYZ), n)
    return in_groups(points.join(big, key, "left_anti")).unionByName(shared.select(F.col("key").alias(key), "g", F.col("p").alias(index)))


def _farthest_of_all(points: DataFrame, n: int) -> DataFrame:
    """(key, g, p): a job for each of the n points, in which every task gives its farthest point of each key. Distances
    are measured anew from the centres so far, so that nothing has to be kept between jobs but those."""
    with Scratch(points.sparkSession) as scratch:
        points = scratch.settle(points.select("key", "p", *(F.col(c).cast("double").alias(c) for c in XYZ)))
        place = F.struct("p", *XYZ)
        first = points.groupBy("key").agg(F.min(place).alias("s")).select("key", F.lit(0).alias("g"), "s.*")
        chosen = scratch.settle(first)
        few = chosen.count() * n <= 100_000
        for g in range(1, n):
            centres = chosen.groupBy("key").agg(F.collect_list(F.struct(*XYZ)).alias("centres"))  # at most n a key
            d = F.array_min(F.transform("centres", lambda c: sum(((F.col(k) - c[k]) ** 2 for k in XYZ), F.lit(0.0))))
            far = points.join(F.broadcast(centres) if few else centres, "key").select("key", F.struct((-d).alias("d"), "p", *XYZ).alias("s"))
            new = far.groupBy("key").agg(F.min("s").alias("s")).select("key", F.lit(g).alias("g"), "s.p", *(f"s.{c}" for c in XYZ))
            chosen = scratch.settle(chosen.unionByName(new))
        return settle(chosen.where(F.col("g") < n).select("key", "g", "p"))


def patches(points: DataFrame, centres: DataFrame, k: int, key: str = "mesh_id", index: str = "pid") -> DataFrame:
    """(key, g, k_rank, pid, lx, ly, lz): each centre's k nearest points, itself included, in local coordinates. Cells of
    space are searched, not all pairs."""
    p = points.select(F.col(key).alias("key"), F.col(index).alias("p"), *XYZ)
    c = centres.select(F.col(key).alias("key"), F.col("g").alias("q"), F.col(index).alias("p")).join(p, ["key", "p"])
    found = space.nearest(c.select("key", "q", *XYZ), p, k)
    from_ = c.select("key", "q", *(F.col(d).alias(f"c{d}") for d in XYZ))
    local = [(F.col(d) - F.col(f"c{d}")).alias(f"l{d}") for d in XYZ]
    return found.join(p, ["key", "p"]).join(from_, ["key", "q"]).select(F.col("key").alias(key), F.col("q").alias("g"), F.col("rank").alias("k_rank"), F.col("p").alias(index), *local)


def chamfer(left: DataFrame, right: DataFrame, key: str = "mesh_id") -> DataFrame:
    """(key, chamfer): mean least squared distance there and back, summed, of the two point sets of each key."""

    def way(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        named = lambda df, i: df.select(F.col(key).alias("key"), F.col("pid").alias(i), *XYZ)
        return space.nearest(named(a, "q"), named(b, "p"), 1).groupBy("key").agg(F.avg("d").alias(name))

    both = way(left, right, "there").join(way(right, left, "back"), "key")
    return both.select(F.col("key").alias(key), (F.col("there") + F.col("back")).alias("chamfer"))


def _least(items: DataFrame, h: Column, key: str, m: int) -> Column:
    """Whether a row is among the m first by hash and key. The border is found by counts of the hash's leading 16 bits and
    of the 16 that follow; only the rows that share all 32 with it are sorted, and the answer is a comparison."""
    top, next_ = F.shiftrightunsigned(h, 48), F.shiftrightunsigned(h, 32).bitwiseAND(65535)
    where, met = F.lit(True), F.lit(False)
    for part in (top, next_):
        counts = items.where(where).groupBy(part.alias("b")).agg(F.count("*").alias("n"))  # at most 65,536 rows
        upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)))
        edge = upto.where(F.col("upto") >= m).orderBy("b").first()
        if edge is None:
            return F.lit(True)
        met, where, m = met | (where & (part < edge["b"])), where & (part == edge["b"]), m - (edge["upto"] - edge["n"])
    last = items.where(where).select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(m).orderBy(F.desc("h"), F.desc("k")).first()
    return met | (where & ((h < last["h"]) | ((h == last["h"]) & (F.col(key) <= last["k"]))))


def split(items: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """items with `part`: max(1, int(n * share)) rows of "val", the rest "train", by hash order. Rows with equal keys
    fall on the same side."""
    n = items.count()
    h = F.xxhash64(key, F.lit(seed))
    return items.withColumn("part", F.when(_least(items, h, key, max(1, int(n * share))), "val").otherwise("train"))


def batches(items: DataFrame, key: str, size: int = 16, seed: int = 42, least: int = 2) -> DataFrame:
    """(key, batch): the rows in random order, `size` at a time; a last batch of fewer than `least` rows is left out."""
    dealt = numbered(items.select(key, F.xxhash64(key, F.lit(seed)).alias("_h")), ["_h", key], name="_at", total="_n")
    batch = F.expr(f"_at div {size}")
    return dealt.where((batch < F.expr(f"_n div {size}")) | (F.col("_n") % size >= least)).select(key, batch.alias("batch"))


def mask_groups(groups: DataFrame, key: str, ratio: float = 0.6, seed: int = 42) -> DataFrame:
    """groups with `masked`: int(G * ratio) random groups of each key, however many a key has."""
    dealt = groups.withColumn("_h", F.xxhash64(key, "g", F.lit(seed)))
    ranked = numbered(dealt, ["_h", "g"], [key], name="_at", total="_n")
    return ranked.withColumn("masked", F.col("_at") < F.floor(F.col("_n") * ratio)).drop("_h", "_at", "_n")
