"""Fewer faces: clustering by grid, which is joins and group-bys over all meshes at once, and edge collapse by quadric
error, which is sequential within a mesh and runs as one group a mesh, or, for larger ones, as one a cell of it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import geometry, space
from .lineage import Scratch, settle
from .ordinals import numbered

CELL = 20_000  # faces that one task collapses together
PRECLUSTER = 150_000  # fixed value: faces beyond which meshes are clustered before edges collapse


def dedupe_faces(faces: DataFrame) -> DataFrame:
    """Of faces with the same three corners the one with the least id stays."""
    three = F.sort_array(F.array("a", "b", "c"))
    rank = F.row_number().over(W.partitionBy("mesh_id", three).orderBy("fid"))
    return faces.withColumn("_r", rank).where("_r = 1").drop("_r")


def cluster(vertices: DataFrame, faces: DataFrame, target: int | Column) -> tuple[DataFrame, DataFrame]:
    """Vertices of one grid cell become their mean; degenerate and repeated faces go. A mesh with `target` faces or
    fewer is left as it is. The target, a number or an expression of a mesh's faces `nf`, is not met exactly."""
    target = F.lit(target) if isinstance(target, int) else target
    n_faces = faces.groupBy("mesh_id").agg(F.count("*").alias("nf"))
    w = W.partitionBy("mesh_id")
    v = vertices.join(n_faces.where(F.col("nf") > target), "mesh_id")
    grid = F.greatest(F.lit(4), F.floor(F.cbrt(F.count("*").over(w) * (target.cast("double") / F.col("nf"))) * 1.5))
    v = v.withColumn("grid", grid)

    def cell(k: str):
        low, span = F.min(k).over(w), F.max(k).over(w) - F.min(k).over(w)
        return F.floor((F.col(k) - low) / F.when(span > 0, span).otherwise(1.0) * (F.col("grid") - 1)).alias(f"g{k}")

    v = v.select("mesh_id", "vid", "x", "y", "z", *(cell(k) for k in "xyz"))
    means = v.groupBy("mesh_id", "gx", "gy", "gz").agg(*(F.avg(k).alias(k) for k in "xyz"))
    means = means.withColumn("new", F.row_number().over(w.orderBy("gx", "gy", "gz")) - 1)
    new = v.join(means.select("mesh_id", "gx", "gy", "gz", "new"), ["mesh_id", "gx", "gy", "gz"]).select("mesh_id", F.col("vid").alias("old"), "new")
    out = dedupe_faces(geometry.renamed(faces, new).where("a <> b and b <> c and a <> c"))
    small = n_faces.where(F.col("nf") <= target).select("mesh_id")
    same_v, same_f = vertices.join(small, "mesh_id", "left_semi"), faces.join(small, "mesh_id", "left_semi")
    cols = lambda df, names: df.select("mesh_id", *(F.col(c).cast("long").alias(c) if c in ("vid", "fid", "a", "b", "c") else F.col(c) for c in names))
    return cols(means.withColumnRenamed("new", "vid"), ["vid", "x", "y", "z"]).unionByName(cols(same_v, ["vid", "x", "y", "z"])), cols(out, ["fid", "a", "b", "c"]).unionByName(cols(same_f, ["fid", "a", "b", "c"]))


def collapse(x: np.ndarray, f: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Quadric-error edge collapse of one mesh down to `target` faces: always the cheapest edge, to the point of least
    error, or the middle where that is ill-defined. Costs of all edges at a changed vertex are renewed."""
    x, f, used = collapse_between(x, f, target, np.zeros(len(x), bool))
    return x[used], np.searchsorted(used, f)


def collapse_between(x: np.ndarray, f: np.ndarray, target: int, locked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, faces, which vertices are used) after edges collapse that no locked vertex ends; numbers stay those of x,
    and a vertex that another merges into has the smaller number."""
    x, f = x.astype(float).copy(), f.astype(int).copy()
    q = np.zeros((len(x), 4, 4))
    n = np.cross(x[f[:, 1]] - x[f[:, 0]], x[f[:, 2]] - x[f[:, 0]])
    size = np.linalg.norm(n, axis=1)
    n = n / np.where(size > 0, size, 1)[:, None]
    p = np.column_stack([n, -(n * x[f[:, 0]]).sum(axis=1)])
    k = p[:, :, None] * p[:, None, :] * (size / 2)[:, None, None]
    for j in range(3):
        np.add.at(q, f[:, j], k)
    of: list[set[int]] = [set() for _ in x]
    for i, face in enumerate(f):
        for v in face:
            of[v].add(i)
    alive, left, stamp, heap = np.ones(len(f), bool), len(f), np.zeros(len(x), int), []

    def push(u: int, v: int) -> None:
        u, v = min(u, v), max(u, v)
        s = q[u] + q[v]
        at = np.linalg.solve(s[:3, :3], -s[:3, 3]) if np.linalg.cond(s[:3, :3]) < 1e10 else (x[u] + x[v]) / 2
        h = np.append(at, 1)
        heapq.heappush(heap, (float(h @ s @ h), u, v, stamp[u], stamp[v], tuple(at)))

    for u, v in {(min(a, b), max(a, b)) for face in f for a, b in zip(face, np.roll(face, -1), strict=True) if a != b and not locked[a] and not locked[b]}:
        push(u, v)
    while left > target and heap:
        _, u, v, su, sv, at = heapq.heappop(heap)
        if stamp[u] != su or stamp[v] != sv:
            continue
        x[u], q[u] = at, q[u] + q[v]
        stamp[v] = -1
        stamp[u] += 1
        for i in list(of[v]):
            f[i][f[i] == v] = u
            of[u].add(i)
        of[v] = set()
        for i in list(of[u]):
            if len(set(f[i])) < 3:
                alive[i] = False
                left -= 1
                for w in set(f[i]):
                    of[w].discard(i)
        for w in {w for i in of[u] for w in f[i]} - {u}:
            if not locked[w]:
                push(u, int(w))
    f = f[alive].reshape(-1, 3)
    return x, f, np.unique(f)


def _grouped(vertices: DataFrame, faces: DataFrame, run, out: str) -> DataFrame:
    kind = vertices.schema["mesh_id"].dataType.simpleString()
    return vertices.groupBy("mesh_id").cogroup(faces.groupBy("mesh_id")).applyInPandas(run, f"mesh_id {kind}, {out}")


def _arrays(v: pd.DataFrame, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    v, f = v.sort_values("vid"), f.sort_values("fid")
    at = {k: i for i, k in enumerate(v["vid"])}
    return v[["x", "y", "z"]].to_numpy(float), np.array([[at[k] for k in t] for t in f[["a", "b", "c"]].to_numpy()], int).reshape(-1, 3)


def in_cells(vertices: DataFrame, faces: DataFrame, goals: DataFrame, cell: int = CELL, passes: int = 8) -> tuple[DataFrame, DataFrame]:
    """Meshes collapsed towards their goals (mesh_id, goal), in cells of about `cell` faces that tasks work on side by side.

    Vertices that faces of several cells share are locked, so that cells fit together again; the next pass cuts space
    along other directions, and what was a border is within a cell. A mesh is done when it has its goal or one cell, or
    when a pass takes nothing from any mesh; `collapse` does the rest.
    """
    kind = vertices.schema["mesh_id"].dataType.simpleString()
    ddl = f"mesh_id {kind}, what string, n long, a long, b long, c long, x double, y double, z double"

    def run(corners: pd.DataFrame) -> pd.DataFrame:
        corners = corners.sort_values(["fid", "corner"])
        ids, first, at = np.unique(corners["vid"].to_numpy(), return_index=True, return_inverse=True)
        x, locked = corners[["x", "y", "z"]].to_numpy(float)[first], corners["locked"].to_numpy(bool)[first]
        f = at.reshape(-1, 3)
        goal = int(len(f) * corners["share"].iloc[0])
        x, f, used = collapse_between(x, f, goal, locked)
        mesh = corners["mesh_id"].iloc[0]
        v = pd.DataFrame({"mesh_id": mesh, "what": "v", "n": ids[used], "a": 0, "b": 0, "c": 0, "x": x[used, 0], "y": x[used, 1], "z": x[used, 2]})
        return pd.concat([v, pd.DataFrame({"mesh_id": mesh, "what": "f", "n": 0, **{k: ids[f[:, j]] for j, k in enumerate("abc")}, **dict.fromkeys("xyz", 0.0)})])

    count = lambda f: f.groupBy("mesh_id").agg(F.count("*").alias("nf"))
    with Scratch(vertices.sparkSession) as scratch:
        v = scratch.settle(vertices.select("mesh_id", F.col("vid").cast("long").alias("vid"), "x", "y", "z"))
        f = scratch.settle(faces.select("mesh_id", F.col("fid").cast("long").alias("fid"), *(F.col(k).cast("long").alias(k) for k in "abc")))
        left = None
        for turn in range(passes):
            todo = scratch.settle(count(f).join(goals, "mesh_id").where((F.col("nf") > F.col("goal")) & (F.col("nf") > cell)).select("mesh_id", (F.col("goal") / F.col("nf")).alias("share"), "nf"))
            now = todo.agg(F.sum("nf")).first()[0]
            if now is None or now == left:
                break
            left = now
            mine = f.join(todo.select("mesh_id"), "mesh_id", "left_semi")
            m = geometry.face_centres(geometry.corners(v, mine))
            t = 0.7 * turn
            turned = (F.col("fx") * math.cos(t) + F.col("fy") * math.sin(t), F.col("fy") * math.cos(t) - F.col("fx") * math.sin(t))
            turned = (turned[0], turned[1] * math.cos(t) + F.col("fz") * math.sin(t), F.col("fz") * math.cos(t) - turned[1] * math.sin(t))
            centres = scratch.settle(m.select(F.col("mesh_id").alias("key"), F.col("fid").alias("p"), *(e.alias(k) for e, k in zip(turned, "xyz", strict=True))))
            path = space.Cells(centres, cell, scratch).home(centres).select(F.col("key").alias("mesh_id"), F.col("p").alias("fid"), "path")
            corner = F.posexplode(F.array("a", "b", "c")).alias("corner", "vid")
            corners = scratch.settle(mine.join(path, ["mesh_id", "fid"]).select("mesh_id", "path", "fid", corner))
            shared = corners.groupBy("mesh_id", "vid").agg((F.min("path") < F.max("path")).alias("locked"))
            whole = corners.join(shared, ["mesh_id", "vid"]).join(v, ["mesh_id", "vid"]).join(todo.select("mesh_id", "share"), "mesh_id")
            out = scratch.settle(whole.groupBy("mesh_id", "path").applyInPandas(run, ddl))
            done = todo.select("mesh_id")
            new_v = out.where("what = 'v'").groupBy("mesh_id", F.col("n").alias("vid")).agg(*(F.first(k).alias(k) for k in "xyz"))
            new_f = numbered(out.where("what = 'f'").select("mesh_id", "a", "b", "c"), ["a", "b", "c"], ["mesh_id"], name="fid", scratch=scratch).select("mesh_id", "fid", "a", "b", "c")
            v = scratch.settle(v.join(done, "mesh_id", "left_anti").unionByName(new_v))
            f = scratch.settle(f.join(done, "mesh_id", "left_anti").unionByName(new_f))
        return settle(v), settle(f)


def decimate(vertices: DataFrame, faces: DataFrame, target: int | None = None, ratio: float = 0.05, method: str = "qem", cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Meshes with about `target` faces each. cluster: by grid. qem: by edge collapse, after clustering meshes of more
    than PRECLUSTER faces; meshes of more than `cell` faces collapse in cells first. Without a target it is `ratio` of
    each mesh's own faces, 500 at least."""
    if method not in ("qem", "cluster"):
        raise ValueError(f"unknown method {method!r}")
    if target is None:
        goal = F.greatest(F.lit(500), F.floor(F.col("nf") * ratio).cast("int"))
    else:
        goal = F.lit(target)
    if method == "cluster":
        return cluster(vertices, faces, goal)
    big = faces.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") > PRECLUSTER).select("mesh_id")
    pre_v, pre_f = cluster(vertices.join(big, "mesh_id", "left_semi"), faces.join(big, "mesh_id", "left_semi"), F.greatest(3 * goal, F.lit(PRECLUSTER)))
    cast = lambda df: df.select("mesh_id", *(F.col(c).cast("long").alias(c) if c in ("vid", "fid", "a", "b", "c") else F.col(c) for c in df.columns if c != "mesh_id"))
    v = cast(vertices.join(big, "mesh_id", "left_anti")).unionByName(pre_v)
    f = cast(faces.join(big, "mesh_id", "left_anti")).unionByName(pre_f)

    goals = faces.groupBy("mesh_id").agg(F.count("*").alias("nf")).select("mesh_id", goal.alias("goal"))
    if faces.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") > cell).limit(1).count():
        v, f = in_cells(v, f, goals, cell)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"mesh_id": [], "xs": [], "fs": []})
        x, t = _arrays(a, b)
        if len(t) > a["goal"].iloc[0]:
            x, t = collapse(x, t, int(a["goal"].iloc[0]))
        return pd.DataFrame({"mesh_id": [a["mesh_id"].iloc[0]], "xs": [x.ravel().tolist()], "fs": [t.ravel().tolist()]})

    packed = _grouped(v.join(goals, "mesh_id"), f, run, "xs array<double>, fs array<long>")
    part = lambda c, n, k: F.element_at(c, (F.col("i") * n + k + 1).cast("int"))
    vs = packed.where("size(xs) > 0").select("mesh_id", "xs", F.explode(F.sequence(F.lit(0), F.expr("size(xs) div 3 - 1"))).alias("i"))
    fs = packed.where("size(fs) > 0").select("mesh_id", "fs", F.explode(F.sequence(F.lit(0), F.expr("size(fs) div 3 - 1"))).alias("i"))
    return vs.select("mesh_id", F.col("i").alias("vid"), *(part("xs", 3, k).alias(n) for k, n in enumerate("xyz"))), fs.select("mesh_id", F.col("i").alias("fid"), *(part("fs", 3, k).alias(n) for k, n in enumerate("abc")))


def levels_of_detail(vertices: DataFrame, faces: DataFrame, levels: int = 4, least: int = 500) -> DataFrame:
    """(mesh_id, level, n_vertices, n_faces): each level collapses the one before to the next of the geometric targets;
    a mesh of `least` faces or fewer is its own and only level."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"mesh_id": [], "level": [], "n_vertices": [], "n_faces": []})
        x, f = _arrays(a, b)
        out = []
        for target in geometry.lod_targets(len(f), least, levels) or [len(f)]:
            if target < len(f):
                x, f = collapse(x, f, target)
            out.append((a["mesh_id"].iloc[0], len(out), len(x), len(f)))
            if len(f) <= least:
                break
        return pd.DataFrame(out, columns=["mesh_id", "level", "n_vertices", "n_faces"])

    return _grouped(vertices, faces, run, "level int, n_vertices long, n_faces long")
