"""Rendered views of whole meshes: three, seven and eight channels from above and below, and six depth views.

Pixel coordinates are linear in a mesh's own coordinates, so that faces get theirs from one row about their mesh; the
drawing of one view of one mesh is one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, depth, encode_normal
from . import geometry, images

# Name, axes across and up, the axis that is looked along, and whether from its positive end.
SIX = [("pZ", "x", "y", "z", True), ("nZ", "x", "y", "z", False), ("pX", "y", "z", "x", True), ("nX", "y", "z", "x", False), ("pY", "x", "z", "y", True), ("nY", "x", "z", "y", False)]
FILL = 0.85  # fixed value: the share of the canvas that a view's longer side fills
NORMALS = [f"{side}{k}" for side in "tb" for k in "xyz"]
EPS = 1e-9  # a face this little turned inwards counts as turned outwards


def _about(vertices: DataFrame) -> DataFrame:
    """One row per mesh: means, middles of the bounding box, lowest values and ranges of the three axes."""
    return vertices.groupBy("mesh_id").agg(*(f(k).alias(f"{n}{k}") for k in "xyz" for n, f in (("g", F.avg), ("m", lambda k: (F.max(k) + F.min(k)) / 2), ("l", F.min), ("r", lambda k: F.max(k) - F.min(k)))))


def surface(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with corners, centres, what `_about` says of their mesh, and normals turned away from the mean vertex."""
    m = geometry.face_centres(geometry.measured(vertices, faces)).join(_about(vertices), "mesh_id")
    inward = sum((F.col(f"n{k}") * (F.col(f"f{k}") - F.col(f"g{k}")) for k in "xyz"), F.lit(0.0)) < -EPS
    return m.withColumns({f"n{k}": F.when(inward, -F.col(f"n{k}")).otherwise(F.col(f"n{k}")) for k in "xyz"})


def _placed(m: DataFrame, across: str, up: str, scale, width: int, height: int) -> DataFrame:
    return m.withColumns(_places(across, up, scale, width, height))


def _places(across: str, up: str, scale, width: int, height: int) -> dict:
    """Corners on the canvas, the middle of the mesh in its middle, rows running down."""
    px = {f"p{c}x": (F.col(f"{c}{across}") - F.col(f"m{across}")) * scale + width / 2 for c in "abc"}
    py = {f"p{c}y": height / 2 - (F.col(f"{c}{up}") - F.col(f"m{up}")) * scale for c in "abc"}
    return {**px, **py}


def _drawn(m: DataFrame, view: str, order, channels: dict, width: int, height: int) -> DataFrame:
    corners = [F.col(f"p{c}{k}").alias(f"{c}{k}") for c in "abc" for k in "xy"]
    # Channels may be named like corners, so they go by number while they are drawn.
    names = [f"c{k}" for k in range(len(channels))]
    tri = m.select("mesh_id", "fid", order.alias("order"), *corners, *(e.alias(f"_{n}") for n, e in zip(names, channels.values(), strict=True)))
    drawn = images.render(tri, height, width, [f"_{n}" for n in names], view)
    return drawn.select("mesh_id", "row", "col", *(F.col(f"_{n}").alias(c) for n, c in zip(names, channels, strict=True)))


def _both_sides(m: DataFrame, scale: float, width: int, height: int, d) -> DataFrame:
    """Pixels with encoded normals tx, ty, tz and depth td of the surface seen from above, and bx, by, bz, bd of that from
    below; 0 where a side is not drawn."""
    m = _placed(m, "x", "y", F.lit(float(scale)), width, height)
    sides = []
    for s, which, order in (("t", "top", F.col("fz")), ("b", "bottom", -F.col("fz"))):
        channels = {**{f"{s}{k}": encode_normal(F.col(f"n{k}")) for k in "xyz"}, f"{s}d": d}
        sides.append(_drawn(images.backface_cull(m, which), which, order, channels, width, height))
    return sides[0].join(sides[1], ["mesh_id", "row", "col"], "full").na.fill(0.0)


def three_views(vertices: DataFrame, faces: DataFrame, scale: float, width: int, height: int) -> DataFrame:
    """(mesh_id, row, col, tx, ty, tz, bx, by, bz, depth) in the file's own frame: normals as windings give them, not turned
    outwards, from above and below; and the heights of the faces seen from above between the lowest and the highest of
    them, 0.5 where all are as high. The middle of each mesh lies in the middle of the canvas."""
    m = geometry.face_centres(geometry.measured(vertices, faces)).join(_about(vertices), "mesh_id")
    seen = images.backface_cull(m, "top").groupBy("mesh_id").agg(F.min("fz").alias("low"), F.max("fz").alias("high"))
    m = m.join(seen, "mesh_id", "left")
    d = F.when(F.col("high") > F.col("low"), (F.col("fz") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    return _both_sides(m, scale, width, height, d).select("mesh_id", "row", "col", *NORMALS, F.col("td").alias("depth"))


def _all_ranges(vertices: DataFrame, axes: str = "z") -> DataFrame:
    """The largest range of each axis over all meshes: one row, which is what gets broadcast."""
    own = vertices.groupBy("mesh_id").agg(*((F.max(k) - F.min(k)).alias(k) for k in axes))
    return F.broadcast(own.agg(*(F.max(k).alias(f"all_{k}") for k in axes)))


def seven_channels(vertices: DataFrame, faces: DataFrame, scale: float, width: int, height: int) -> DataFrame:
    """(mesh_id, row, col, tx, ty, tz, bx, by, bz, depth): normals from above and below, and the height of the upper
    surface over the mesh's lowest point as a share of the corpus' largest range."""
    m = surface(vertices, faces).crossJoin(_all_ranges(vertices))
    d = F.when(F.col("all_z") > 1e-10, clip((F.col("fz") - F.col("lz")) / F.col("all_z"), 0.0, 1.0)).otherwise(0.5)
    return _both_sides(m, scale, width, height, d).withColumnRenamed("td", "depth").select("mesh_id", "row", "col", *NORMALS, "depth")


def eight_channels(vertices: DataFrame, faces: DataFrame, scale: float, width: int, height: int, aligned: bool = True) -> DataFrame:
    """(mesh_id, row, col, tx, ty, tz, bx, by, bz, thickness, opposing), in the frame of each mesh's principal axes:
    normals, the distance of the two surfaces where both are drawn, and how far their normals oppose each other."""
    v = geometry.aligned(vertices) if aligned else vertices
    m = surface(v, faces).crossJoin(_all_ranges(v))
    d = depth(F.col("fz") - F.col("lz"), F.greatest("all_z", "rz", F.lit(1e-10)))
    p = images.opposing(_both_sides(m, scale, width, height, d)).withColumnRenamed("value", "opposing")
    both = (F.col("td") > images.PIXEL) & (F.col("bd") > images.PIXEL)
    return p.withColumn("thickness", F.when(both, clip(F.col("td") - F.col("bd"), 0.0, 1.0)).otherwise(0.0)).select("mesh_id", "row", "col", *NORMALS, "thickness", "opposing")


def six_views(vertices: DataFrame, faces: DataFrame, canvas: int = 224, aligned: bool = True) -> DataFrame:
    """(mesh_id, view, row, col, value): depth from six sides in the frame of each mesh's principal axes, 1 for the nearest
    possible surface. Every view fills its canvas on its own; depths are shares of the corpus' largest range."""
    return images.render(_six(vertices, faces, canvas, aligned), canvas, canvas, ["value"], None)


def six_view_means(vertices: DataFrame, faces: DataFrame, canvas: int = 224, aligned: bool = True) -> DataFrame:
    """(mesh_id, view, n, mean): drawn pixels of each of `six_views` and the mean of their values. They are added up where
    they are drawn, so that no pixel is a row."""
    t = images.render(_six(vertices, faces, canvas, aligned), canvas, canvas, ["value"], None, totals=True)
    return t.groupBy("mesh_id", "view").agg(F.sum("n").alias("n"), F.try_divide(F.sum("sum_value"), F.sum("n_value")).alias("mean"))


def _six(vertices: DataFrame, faces: DataFrame, canvas: int, aligned: bool) -> DataFrame:
    """Faces as images.render takes them, once for each view."""
    v = geometry.aligned(vertices) if aligned else vertices
    m = surface(v, faces).crossJoin(_all_ranges(v, "xyz"))
    seen = []
    for name, across, up, along, positive in SIX:
        scale = canvas * FILL / F.greatest(f"r{across}", f"r{up}", F.lit(1e-10))
        far = F.col(f"f{along}") - F.col(f"l{along}")
        value = depth(far if positive else F.col(f"r{along}") - far, F.greatest(f"all_{along}", f"r{along}", F.lit(1e-10)))
        order = F.col(f"f{along}") if positive else -F.col(f"f{along}")
        seen.append(F.struct(F.lit(name).alias("view"), order.alias("order"), *(e.alias(n[1:]) for n, e in _places(across, up, scale, canvas, canvas).items()), value.alias("value")))
    return m.select("mesh_id", "fid", F.explode(F.array(*seen)).alias("s")).select("mesh_id", "fid", "s.*")


def exported(pixels: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(mesh_id, row, col, top, bottom, depth): seven channels as bytes, two colours and a grey. Meshes in `done`
    (mesh_id), which have been exported, are left out."""
    todo = pixels.join(done.select("mesh_id").distinct(), "mesh_id", "left_anti") if done is not None else pixels
    byte = lambda c: (clip(F.col(c), 0.0, 1.0) * 255).cast("int")
    return todo.select("mesh_id", "row", "col", F.array(*map(byte, ("tx", "ty", "tz"))).alias("top"), F.array(*map(byte, ("bx", "by", "bz"))).alias("bottom"), byte("depth").alias("depth"))
