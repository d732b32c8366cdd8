"""Triangle meshes as two tables: vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, a, b, c).

Everything is joins, windows and group-bys keyed by mesh, so that a corpus of any number of meshes is one plan. A
face whose vertex is missing drops out of every join. Null coordinates give null measures.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip, cross, dot, minus, named, norm, xyz
from . import graph
from .lineage import Scratch, settle


EPS = 1e-9  # a normal this little turned inwards counts as turned outwards


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the corpus: packed well in a file it looks small, and would be sent whole to the
    driver and held by every task."""
    return df.hint("merge")


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners: ax .. cz."""
    out = faces.select("mesh_id", "fid", "a", "b", "c")
    for k in "abc":
        v = vertices.select("mesh_id", F.col("vid").alias(k), *(F.col(d).alias(f"{k}{d}") for d in "xyz"))
        out = out.join(shuffled(v), ["mesh_id", k])
    return out.select("mesh_id", "fid", "a", "b", "c", *(f"{k}{d}" for k in "abc" for d in "xyz"))


def measured(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """corners() with unit normal nx, ny, nz, length of the cross product `twice` and area. A degenerate face has the zero normal."""
    a, b, c = xyz("a"), xyz("b"), xyz("c")
    n = cross(minus(b, a), minus(c, a))
    out = corners(vertices, faces).select("*", *named(n, "_n"))
    out = out.withColumn("twice", norm(xyz("_n")))
    unit = [F.when(F.col("twice") > 0, F.col(f"_n{k}") / F.col("twice")).otherwise(0.0).alias(f"n{k}") for k in "xyz"]
    return out.select("*", *unit, (F.col("twice") / 2).alias("area")).drop("_nx", "_ny", "_nz")


def face_centres(m: DataFrame) -> DataFrame:
    return m.select("*", *(((F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3).alias(f"f{k}") for k in "xyz"))


def drop_degenerate(vertices: DataFrame, faces: DataFrame, least: float = 1e-15) -> DataFrame:
    """Faces with three different corners that span more than `least` (twice the area)."""
    good = measured(vertices, faces.where("a <> b and b <> c and a <> c")).where(F.col("twice") > least)
    return good.select("mesh_id", "fid", "a", "b", "c")


def orient_outward(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with b and c swapped where the normal points to the mean of the mesh's face centres, by more than EPS: what lies
    in one plane with that mean, but for rounding, stays. Right for roughly convex shapes."""
    m = face_centres(measured(vertices, faces))
    w = W.partitionBy("mesh_id")
    m = m.select("*", *(F.avg(f"f{k}").over(w).alias(f"m{k}") for k in "xyz"))
    swap = dot(xyz("n"), minus(xyz("f"), xyz("m"))) < -EPS
    return m.select("mesh_id", "fid", "a", F.when(swap, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(swap, F.col("b")).otherwise(F.col("c")).alias("c"))


def surface_area(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return measured(vertices, faces).groupBy("mesh_id").agg(F.sum("area").alias("area"))


def bbox(vertices: DataFrame) -> DataFrame:
    """Extents ex, ey, ez of each mesh and, from longest to shortest, e1, e2, e3."""
    out = vertices.groupBy("mesh_id").agg(*((F.max(k) - F.min(k)).alias(f"e{k}") for k in "xyz"))
    down = F.sort_array(F.array("ex", "ey", "ez"), asc=False)
    return out.select("*", *(down[k].alias(f"e{k + 1}") for k in range(3)))


def global_extents(vertices: DataFrame, floor: float = 1e-10) -> DataFrame:
    """The largest sorted extents over all meshes: one row."""
    return bbox(vertices).agg(*(F.greatest(F.max(f"e{k}"), F.lit(floor)).alias(f"max_{n}") for k, n in ((1, "long"), (2, "mid"), (3, "short"))))


def normalize(vertices: DataFrame) -> DataFrame:
    """Vertices about their mean, over the diagonal of the bounding box (1 if that is 0)."""
    w = W.partitionBy("mesh_id")
    out = vertices.select("mesh_id", "vid", *((F.col(k) - F.avg(k).over(w)).alias(k) for k in "xyz"))
    out = out.select("*", *((F.max(k).over(w) - F.min(k).over(w)).alias(f"e{k}") for k in "xyz"))
    size = norm(xyz("e"))
    return out.select("mesh_id", "vid", *((F.col(k) / F.when(size > 0, size).otherwise(1.0)).alias(k) for k in "xyz"))


def merge_vertices(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-8, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices that round to one grid point become their mean, numbered by grid point; faces follow. With `scratch` the new
    vertices and names are made once and not anew for each join."""
    keep = scratch.settle if scratch else lambda df: df
    grid = [F.bround(F.col(k) / tolerance).cast("long").alias(f"g{k}") for k in "xyz"]
    placed = vertices.select("*", *grid)
    merged = placed.groupBy("mesh_id", "gx", "gy", "gz").agg(*(F.avg(k).alias(k) for k in "xyz"))
    merged = keep(merged.withColumn("vid", F.row_number().over(W.partitionBy("mesh_id").orderBy("gx", "gy", "gz")) - 1))
    new = keep(placed.join(shuffled(merged.select("mesh_id", "gx", "gy", "gz", F.col("vid").alias("new"))), ["mesh_id", "gx", "gy", "gz"]).select("mesh_id", F.col("vid").alias("old"), "new"))
    return merged.select("mesh_id", F.col("vid").cast("long").alias("vid"), "x", "y", "z"), renamed(faces, new)


def renamed(faces: DataFrame, new: DataFrame) -> DataFrame:
    """faces with corners renamed by (mesh_id, old, new)."""
    out = faces
    for k in "abc":
        out = out.join(shuffled(new.select("mesh_id", F.col("old").alias(k), F.col("new").cast("long").alias(f"_{k}"))), ["mesh_id", k])
    return out.select("mesh_id", "fid", *(F.col(f"_{k}").alias(k) for k in "abc"))


def reindex(vertices: DataFrame, faces: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Only the vertices that faces use, numbered by rank; a mesh without faces keeps its vertices. What `keep` settles is
    what both tables come from."""
    used = faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    bare = vertices.join(shuffled(faces.select("mesh_id").distinct()), "mesh_id", "left_anti")
    kept = vertices.join(shuffled(used), ["mesh_id", "vid"], "left_semi").unionByName(bare)
    kept = keep(kept.withColumn("new", F.row_number().over(W.partitionBy("mesh_id").orderBy("vid")) - 1))
    return kept.select("mesh_id", F.col("new").cast("long").alias("vid"), "x", "y", "z"), renamed(faces, kept.select("mesh_id", F.col("vid").alias("old"), "new"))


def vertex_normals(vertices: DataFrame, faces: DataFrame, m: DataFrame | None = None) -> DataFrame:
    """Area-weighted mean of the incident faces' normals, as unit vectors; zero where they cancel. m: measured(), if at hand."""
    m = measured(vertices, faces) if m is None else m
    spread = m.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), *((F.col(f"n{k}") * F.col("area")).alias(f"n{k}") for k in "xyz"))
    s = spread.groupBy("mesh_id", "vid").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"))
    size = norm(xyz("n"))
    return s.select("mesh_id", "vid", *(F.when(size > 0, F.col(f"n{k}") / size).otherwise(0.0).alias(f"n{k}") for k in "xyz"))


def curvature(vertices: DataFrame, faces: DataFrame, m: DataFrame | None = None) -> DataFrame:
    """Mean angle between a vertex's normal and those of its faces; 0 for a vertex without faces. m: measured(), if at hand."""
    m = measured(vertices, faces) if m is None else m
    vn = vertex_normals(vertices, faces, m).select("mesh_id", "vid", *(F.col(f"n{k}").alias(f"v{k}") for k in "xyz"))
    m = m.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), "nx", "ny", "nz")
    angle = F.acos(clip(dot(xyz("v"), xyz("n")), -1.0, 1.0))
    mean = m.join(shuffled(vn), ["mesh_id", "vid"]).groupBy("mesh_id", "vid").agg(F.avg(angle).alias("curvature"))
    return vertices.select("mesh_id", "vid").join(shuffled(mean), ["mesh_id", "vid"], "left").select("mesh_id", "vid", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))


def edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, u, v, fid): three sorted edges of each face."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select("mesh_id", "fid", F.explode(pairs).alias("e")).select("mesh_id", "e.u", "e.v", "fid")


def edge_count(faces: DataFrame) -> DataFrame:
    return edges(faces).select("mesh_id", "u", "v").distinct().groupBy("mesh_id").agg(F.count("*").alias("n_edges"))


def adjacency(faces: DataFrame) -> DataFrame:
    """(mesh_id, u, v, f1, f2): edges with exactly two faces."""
    g = edges(faces).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("n"), F.min("fid").alias("f1"), F.max("fid").alias("f2"))
    return g.where("n = 2").select("mesh_id", "u", "v", "f1", "f2")


def max_dihedral(vertices: DataFrame, faces: DataFrame, mode: str = "formula", m: DataFrame | None = None) -> DataFrame:
    """The largest angle over a face's shared edges, 0 without any. "formula": acos of the negated dot product of the
    normals, by which flat edges have the largest angle; "edge_sharp": acos of the dot product itself. m: measured(), if at
    hand."""
    n = (measured(vertices, faces) if m is None else m).select("mesh_id", "fid", "nx", "ny", "nz")
    one = n.select("mesh_id", F.col("fid").alias("f1"), *(F.col(f"n{k}").alias(f"p{k}") for k in "xyz"))
    two = n.select("mesh_id", F.col("fid").alias("f2"), *(F.col(f"n{k}").alias(f"q{k}") for k in "xyz"))
    d = dot(xyz("p"), xyz("q"))
    angle = F.acos(clip(-d if mode == "formula" else d, -1.0, 1.0))
    pairs = adjacency(faces).join(shuffled(one), ["mesh_id", "f1"]).join(shuffled(two), ["mesh_id", "f2"]).select("mesh_id", F.explode(F.array("f1", "f2")).alias("fid"), angle.alias("angle"))
    most = pairs.groupBy("mesh_id", "fid").agg(F.max("angle").alias("angle"))
    return n.select("mesh_id", "fid").join(shuffled(most), ["mesh_id", "fid"], "left").select("mesh_id", "fid", F.greatest(F.coalesce("angle", F.lit(0.0)), F.lit(0.0)).alias("dihedral"))


def quadrics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Per vertex the ten entries of the summed, area-weighted plane quadrics of its faces."""
    m = measured(vertices, faces).withColumn("nd", -dot(xyz("n"), xyz("a")))
    p = {"x": F.col("nx"), "y": F.col("ny"), "z": F.col("nz"), "d": F.col("nd")}
    names = [i + j for k, i in enumerate("xyzd") for j in "xyzd"[k:]]
    m = m.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), *((p[n[0]] * p[n[1]] * F.col("area")).alias(f"q{n}") for n in names))
    return m.groupBy("mesh_id", "vid").agg(*(F.sum(f"q{n}").alias(f"q{n}") for n in names))


LARGE = 200_000  # faces from which a mesh is more than one task's work


def _labeller() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def meshes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows that come mesh by mesh, as tables that part no mesh: what a batch has of its last one waits for the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = int(np.searchsorted(code, code[-1]))
            if held and (cut or held[-1].column(0)[-1] != batch.column(0)[0]):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(mesh_id, vid, component) of links (mesh_id, u, v) that come mesh by mesh, many small meshes at a time: roots hook to
        their least neighbour and hooks are followed to their end, until nothing moves."""
        for links in meshes(batches):
            mesh = links.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            code, known = mesh.indices.to_numpy().astype(np.int64), links.column("u").is_valid().to_numpy()
            lost = np.unique(code[~known])  # a vertex without a number is a component without one
            ends = np.concatenate([links.column(c).combine_chunks().drop_null().to_numpy() for c in ("u", "v")])
            vids, at = np.unique(ends, return_inverse=True)
            nodes, at = np.unique(np.tile(code[known], 2) * max(1, len(vids)) + at, return_inverse=True)
            u, v = np.split(at, 2)
            up = np.arange(len(nodes))
            while True:
                least, new = np.minimum(up[u], up[v]), up.copy()
                for end in (u, v):
                    np.minimum.at(new, up[end], least)
                while (new[new] != new).any():
                    new = new[new]
                if (new == up).all():
                    break
                up = new
            vid, empty = vids[nodes % max(1, len(vids))], np.repeat([False, True], [len(nodes), len(lost)])
            of = mesh.dictionary.take(pa.array(np.concatenate([nodes // max(1, len(vids)), lost])))
            columns = [pa.array(np.concatenate([x, lost]), pa.int64(), mask=empty) for x in (vid, vid[up])]
            yield pa.RecordBatch.from_arrays([of, *columns], ["mesh_id", "vid", "component"])

    return label


def components(vertices: DataFrame, faces: DataFrame, large: int = LARGE) -> DataFrame:
    """(mesh_id, vid, component): vertices that faces connect, named by their least vertex. Meshes of up to `large` faces
    are each one task's work, many in a task; larger ones are worked on by all tasks together."""

    def in_groups(vertices: DataFrame, faces: DataFrame) -> DataFrame:
        links = edges(faces).select("mesh_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
        loops = vertices.select("mesh_id", F.col("vid").cast("long").alias("u"), F.col("vid").cast("long").alias("v"))
        kind = vertices.schema["mesh_id"].dataType.simpleString()
        dealt = links.unionByName(loops).repartition("mesh_id").sortWithinPartitions("mesh_id")
        return dealt.mapInArrow(_labeller(), f"mesh_id {kind}, vid long, component long")

    big = faces.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("mesh_id")
    if not big.limit(1).count():
        return in_groups(vertices, faces)
    small = in_groups(vertices.join(big, "mesh_id", "left_anti"), faces.join(big, "mesh_id", "left_anti"))
    nodes = vertices.join(big, "mesh_id", "left_semi").select(F.col("mesh_id").alias("key"), F.col("vid").cast("long").alias("v"))
    links = edges(faces.join(big, "mesh_id", "left_semi")).select(F.col("mesh_id").alias("key"), F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b"))
    return small.unionByName(graph.components(nodes, links).select(F.col("key").alias("mesh_id"), F.col("v").alias("vid"), "component"))


def keep_largest(vertices: DataFrame, faces: DataFrame, scratch: Scratch | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Each mesh's component with most vertices (ties: the one with the least vertex), renumbered. With `scratch` components
    are found once and not anew for each join; `keep` as in reindex."""
    parts = components(vertices, faces)
    if scratch:
        parts = scratch.settle(parts)
    size = parts.groupBy("mesh_id", "component").agg(F.count("*").alias("n"))
    best = size.groupBy("mesh_id").agg(F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("component"))
    kept = parts.join(shuffled(best), ["mesh_id", "component"], "left_semi").select("mesh_id", F.col("vid").alias("a"))
    if scratch:
        kept = scratch.settle(kept)
    v = vertices.join(shuffled(kept.withColumnRenamed("a", "vid")), ["mesh_id", "vid"], "left_semi")
    f = faces.join(shuffled(kept), ["mesh_id", "a"], "left_semi").select("mesh_id", "fid", "a", "b", "c")
    return reindex(v, scratch.settle(f) if scratch else f, keep)


def clean_mesh(vertices: DataFrame, faces: DataFrame, largest: bool = True, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Merges vertices, drops degenerate faces and unused vertices, keeps the largest component, orients outward. A
    breadth-first pass over windings would change nothing, since orienting outward doesn't depend on windings. Unused
    vertices, each a component of its own, go with all but the largest one; orienting leaves the corners as they are."""
    with Scratch(vertices.sparkSession) as scratch:
        v, f = merge_vertices(vertices, faces, tolerance, scratch)
        f = scratch.settle(drop_degenerate(v, scratch.settle(f)))
        v, f = keep_largest(v, f, scratch, settle) if largest else reindex(v, f, settle)
        return v, settle(orient_outward(v, scratch.settle(f)))


def mesh_metadata(raw: tuple[DataFrame, DataFrame], clean: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row per mesh: counts before and after, centroid, scale, bounding box and area."""
    count = lambda df, name: df.groupBy("mesh_id").agg(F.count("*").alias(name))
    v, f = clean
    about = v.groupBy("mesh_id").agg(*(F.avg(k).alias(f"centroid_{k}") for k in "xyz"), *((F.max(k) - F.min(k)).alias(f"bbox_{k}") for k in "xyz"))
    size = F.sqrt(F.col("bbox_x") ** 2 + F.col("bbox_y") ** 2 + F.col("bbox_z") ** 2)
    about = about.withColumn("scale_factor", F.when(size > 0, size).otherwise(1.0))
    out = count(raw[0], "num_original_vertices")
    for part in (count(raw[1], "num_original_faces"), count(v, "num_clean_vertices"), count(f, "num_clean_faces"), about, surface_area(v, f).withColumnRenamed("area", "surface_area")):
        out = out.join(shuffled(part), "mesh_id", "left")
    return out.na.fill(0, ["num_original_faces", "num_clean_vertices", "num_clean_faces"])


def aligned(vertices: DataFrame) -> DataFrame:
    """Vertices about their mean, in the frame of the mesh's principal axes: x along the longest spread, z along the
    least. The axes come from each mesh's 3 x 3 covariance, of either sign; coordinates stay in the JVM and only the six
    moments go to Python."""
    pairs = [(i, j) for k, i in enumerate("xyz") for j in "xyz"[k:]]
    moments = vertices.groupBy("mesh_id").agg(*(F.coalesce(F.covar_pop(i, j), F.lit(0.0)).alias(i + j) for i, j in pairs), *(F.avg(k).alias(f"g{k}") for k in "xyz"))

    @F.pandas_udf("array<double>")
    def axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        import numpy as np

        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
        return pd.Series(list(np.swapaxes(np.linalg.eigh(m)[1], 1, 2)[:, ::-1].reshape(len(m), 9)))

    frame = moments.select("mesh_id", "gx", "gy", "gz", axes(*(i + j for i, j in pairs)).alias("w"))
    part = lambda k: sum((F.col("w")[3 * k + i] * (F.col(c) - F.col(f"g{c}")) for i, c in enumerate("xyz")), F.lit(0.0))
    return vertices.join(frame, "mesh_id").select("mesh_id", "vid", *(part(k).alias(c) for k, c in enumerate("xyz")))


def principal_extents(vertices: DataFrame) -> DataFrame:
    """Extents along the principal axes, longest first."""
    turned = aligned(vertices).select("mesh_id", *(F.col(c).alias(f"p{k}") for k, c in enumerate("xyz")))
    ext = turned.groupBy("mesh_id").agg(*((F.max(f"p{k}") - F.min(f"p{k}")).alias(f"p{k}") for k in range(3)))
    down = F.sort_array(F.array("p0", "p1", "p2"), asc=False)
    return ext.select("mesh_id", down[0].alias("length"), down[1].alias("width"), down[2].alias("depth"))


def canvas(extents: DataFrame, image: float = 224.0, margin: float = 0.08) -> DataFrame:
    """Scale and size of the common canvas for corpus extents (max_x, max_y): the longer one fills the image between
    its margins; sizes round half to even."""
    scale = F.lit(image * (1 - 2 * margin)) / F.greatest("max_x", "max_y")
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * scale + F.lit(2 * image * margin)).cast("int"))
    return extents.select("*", scale.alias("scale"), side("max_x").alias("canvas_w"), side("max_y").alias("canvas_h"))


def lod_targets(n: int, least: int = 500, levels: int = 4) -> list[int]:
    """Geometric face counts from n down to `least`, without n itself, each once."""
    if levels < 1 or n <= least:
        return []
    steps = [n * (least / n) ** (k / levels) for k in range(1, levels + 1)]
    return sorted({math.floor(s + 1e-9) for s in steps}, reverse=True)
