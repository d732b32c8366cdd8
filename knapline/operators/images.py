"""Rendered views as tables of pixels (mesh_id, view, row, col, value, ...) and what is measured on them.

A z-buffer is a group-by with an arg-max; masks, erosion and tip widths are joins and aggregates. Only triangle
filling, the convex hull, rotation and resizing are small numpy kernels, one mesh or image a call.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, decode_normal, depth, dot, norm, xyz

MASK, PIXEL = 1.5 / 255, 0.5 / 255  # fixed values: least channel sum of a drawn pixel, least value that covers


def project(vertices: DataFrame, scale: Column, width: Column, height: Column) -> DataFrame:
    """Pixel coordinates px, py: the centre of each mesh's bounding box falls on the canvas' centre, rows run down."""
    box = vertices.groupBy("mesh_id").agg(*(((F.max(k) + F.min(k)) / 2).alias(f"m{k}") for k in "xy"))
    px = (F.col("x") - F.col("mx")) * scale + width / 2
    py = height / 2 - (F.col("y") - F.col("my")) * scale
    return vertices.join(box, "mesh_id").select("mesh_id", "vid", px.alias("px"), py.alias("py"), "z")


def backface_cull(measured: DataFrame, side: str) -> DataFrame:
    """Faces that a view from the top (nz >= 0) or the bottom (nz <= 0) shows; upright faces are in both."""
    return measured.where(F.col("nz") >= 0 if side == "top" else F.col("nz") <= 0)


def zbuffer(fragments: DataFrame, *keys: str, value: str = "value", nearest: str = "depth", tie: str = "fid") -> DataFrame:
    """The value of the last fragment that painter's order draws on each pixel: the highest, then the largest id."""
    return fragments.groupBy(*keys).agg(F.max_by(value, F.struct(nearest, tie)).alias(value))


def encode_depth(pixels: DataFrame, z: str = "z") -> DataFrame:
    """Heights above each mesh's base over the larger of the corpus' and its own range."""
    own = pixels.groupBy("mesh_id").agg(F.min(z).alias("_low"), (F.max(z) - F.min(z)).alias("_range"))
    top = own.agg(F.max("_range").alias("_all"))
    joined = pixels.join(own, "mesh_id").crossJoin(F.broadcast(top))
    return joined.withColumn("value", depth(F.col(z) - F.col("_low"), F.greatest("_all", "_range", F.lit(1e-10)))).drop("_low", "_range", "_all")


def thickness(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Top less bottom depth where both are drawn."""
    t, b = (d.where(F.col("value") > PIXEL).select("mesh_id", "row", "col", F.col("value").alias(n)) for d, n in ((top, "t"), (bottom, "b")))
    return t.join(b, ["mesh_id", "row", "col"]).select("mesh_id", "row", "col", clip(F.col("t") - F.col("b"), 0.0, 1.0).alias("value"))


def opposing(pixels: DataFrame) -> DataFrame:
    """How far top and bottom normals (encoded as tx, ty, tz and bx, by, bz) oppose each other; 0 unless both are drawn."""
    decoded = pixels.select("*", *(decode_normal(F.col(f"{s}{k}")).alias(f"_{s}{k}") for s in "tb" for k in "xyz"))
    unit = {s: tuple(c / F.greatest(norm(xyz(f"_{s}")), F.lit(1e-8)) for c in xyz(f"_{s}")) for s in "tb"}
    drawn = [sum(xyz(s), F.lit(0.0)) > MASK for s in "tb"]
    value = F.when(drawn[0] & drawn[1], clip((1 - dot(unit["t"], unit["b"])) / 2, 0.0, 1.0)).otherwise(0.0)
    return decoded.withColumn("value", value).drop(*(f"_{s}{k}" for s in "tb" for k in "xyz"))


def stats(mask: DataFrame, channels: dict[str, DataFrame]) -> DataFrame:
    """Per mesh: pixels of the mask, and each channel's mean, deviation and coverage inside it. A mesh without mask has
    no row, one without a channel has nulls there."""
    out = mask.groupBy("mesh_id").agg(F.count("*").alias("n_pixels"))
    for name, pixels in channels.items():
        has = pixels.select("mesh_id").distinct().withColumn("_has", F.lit(True))
        inside = mask.select("mesh_id", "row", "col").join(pixels.select("mesh_id", "row", "col", "value"), ["mesh_id", "row", "col"], "left")
        v = F.coalesce("value", F.lit(0.0))
        s = inside.groupBy("mesh_id").agg(F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std"), F.avg((v > PIXEL).cast("double")).alias(f"{name}_coverage"))
        out = out.join(s.join(has, "mesh_id", "left_semi"), "mesh_id", "left")
    return out


def _spread(mask: DataFrame, least: int) -> DataFrame:
    m = mask.groupBy("mesh_id").agg(F.count("*").alias("n"), F.avg("col").alias("mc"), F.avg("row").alias("mr"), F.var_pop("col").alias("vc"), F.var_pop("row").alias("vr"), F.covar_pop("col", "row").alias("vcr"))
    half = F.sqrt(((F.col("vc") - F.col("vr")) / 2) ** 2 + F.col("vcr") ** 2)
    mid = (F.col("vc") + F.col("vr")) / 2
    return m.where(F.col("n") >= least).select("*", (mid + half).alias("l1"), (mid - half).alias("l2"))


def aspect_ratio(mask: DataFrame, least: int = 20) -> DataFrame:
    """Root of the ratio of the pixel covariance's eigenvalues; no row below `least` pixels."""
    return _spread(mask, least).select("mesh_id", F.sqrt(F.col("l1") / F.greatest("l2", F.lit(1e-8))).alias("aspect_ratio"))


def boundary(mask: DataFrame) -> DataFrame:
    """Pixels that 4-neighbour erosion removes: those with a neighbour outside the mask."""
    p = mask.select("mesh_id", "row", "col").distinct()
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    inner = p.select("mesh_id", F.explode(steps).alias("s"), "row", "col").select("mesh_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    inner = inner.groupBy("mesh_id", "row", "col").agg(F.count("*").alias("k")).where("k = 4")
    return p.join(inner, ["mesh_id", "row", "col"], "left_anti")


def circularity(mask: DataFrame, least: int = 20) -> DataFrame:
    """4 pi area over squared perimeter."""
    n = mask.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    p = boundary(mask).groupBy("mesh_id").agg(F.count("*").alias("p"))
    return n.join(p, "mesh_id", "left").select("mesh_id", (4 * F.pi() * F.col("n") / F.greatest(F.coalesce("p", F.lit(0)) ** 2, F.lit(1.0))).alias("circularity"))


def tip_sharpness(mask: DataFrame, least: int = 20, tip: float = 0.10) -> DataFrame:
    """The narrower tip's width over the largest width. Tips are the outer tenths of the long axis; a tip of fewer than
    three pixels makes it null."""
    angle = F.when((F.col("vcr") == 0) & (F.col("vc") >= F.col("vr")), 0.0).when(F.col("vcr") == 0, F.pi() / 2).otherwise(F.atan2(F.col("l1") - F.col("vc"), F.col("vcr")))
    s = _spread(mask, least).withColumn("t", angle)
    dx, dy = F.col("col") - F.col("mc"), F.col("row") - F.col("mr")
    turned = mask.join(s, "mesh_id").select("mesh_id", (dx * F.cos("t") + dy * F.sin("t")).alias("u"), (dy * F.cos("t") - dx * F.sin("t")).alias("w"))
    ends = turned.groupBy("mesh_id").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), (F.max("w") - F.min("w")).alias("most"))
    j = turned.join(ends, "mesh_id").withColumn("r", F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)))
    e = F.lit(1e-9)
    one, two = F.col("u") <= F.col("lo") + F.col("r") * tip + e, F.col("u") >= F.col("hi") - F.col("r") * tip - e
    width = lambda sel: F.when(F.count_if(sel) >= 3, F.max(F.when(sel, F.col("w"))) - F.min(F.when(sel, F.col("w"))))
    g = j.groupBy("mesh_id").agg(width(one).alias("w1"), width(two).alias("w2"), F.first("most").alias("most"))
    return g.select("mesh_id", F.when(F.col("w1").isNotNull() & F.col("w2").isNotNull(), F.least("w1", "w2") / F.greatest("most", F.lit(1e-8))).alias("tip_sharpness"))


def hull_area(x: np.ndarray) -> float:
    """Area of the convex hull of points, by the monotone chain."""
    p = np.unique(x, axis=0)
    if len(p) < 3:
        return 0.0
    chains = []
    for points in (p, p[::-1]):
        chain: list = []
        for q in points:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(q)
        chains += chain[:-1]
    h = np.array(chains)
    return float(abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2)


def solidity(mask: DataFrame, least: int = 20) -> DataFrame:
    """Pixels over the area of their convex hull, NaN where they lie in one line. Only the ends of each row can lie on the hull, so only they leave the JVM."""
    ends = mask.groupBy("mesh_id", "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.count("*").alias("n"))

    @F.pandas_udf("double")
    def area(points: pd.Series) -> pd.Series:
        return points.map(lambda p: hull_area(np.array([[float(q["x"]), float(q["y"])] for q in p])))

    g = ends.groupBy("mesh_id").agg(F.sum("n").alias("n"), F.flatten(F.collect_list(F.array(F.struct(F.col("lo").alias("x"), F.col("row").alias("y")), F.struct(F.col("hi").alias("x"), F.col("row").alias("y"))))).alias("points"))
    measured = g.where(F.col("n") >= least).select("mesh_id", "n", area("points").alias("a"))
    return measured.select("mesh_id", F.when(F.col("a") > 0, F.col("n") / F.greatest("a", F.lit(1.0))).otherwise(float("nan")).alias("solidity"))


def depth_mean(pixels: DataFrame) -> DataFrame:
    """Mean of each view's drawn pixels."""
    return pixels.where(F.col("value") > PIXEL).groupBy("mesh_id", "view").agg(F.avg("value").alias("depth_mean"))


TILE = 128


#: Pixels in boxes of triangles that are looked at together: some 100 MB.
PAIRS = 1_000_000


def covering(triangles: np.ndarray, height: int, width: int, top: int = 0, left: int = 0) -> np.ndarray:
    """For each pixel of a window the last triangle (n, 3, 2) of (x, y) canvas coordinates that its centre lies in, else -1."""
    out = np.full(height * width, -1)
    lo = np.maximum(np.floor(triangles.min(axis=1)).astype(int), [left, top])
    hi = np.minimum(np.ceil(triangles.max(axis=1)).astype(int), [left + width, top + height])
    wide, high = (np.maximum(hi, lo) - lo).T
    upto = np.cumsum(wide * high)
    first = 0
    while first < len(triangles):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        k = np.repeat(np.arange(first, last), (wide * high)[first:last])
        at = np.arange(len(k)) - (upto - wide * high - before)[k]
        x, y = lo[k, 0] + at % wide[k], lo[k, 1] + at // wide[k]
        gx, gy = x + 0.5, y + 0.5
        (ax, ay), (bx, by), (cx, cy) = triangles[k].transpose(1, 2, 0)
        s = [(bx - ax) * (gy - ay) - (by - ay) * (gx - ax), (cx - bx) * (gy - by) - (cy - by) * (gx - bx), (ax - cx) * (gy - cy) - (ay - cy) * (gx - cx)]
        inside = ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
        np.maximum.at(out, ((y - top) * width + x - left)[inside], k[inside])
        first = last
    return out.reshape(height, width)


def fill_triangles(triangles: np.ndarray, values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Draws triangles in order, later ones on top, with their values (n, channels); 0 where there is none."""
    at = covering(triangles, height, width)
    return np.where(at[..., None] >= 0, values[np.maximum(at, 0)], 0.0)


def render(faces_px: DataFrame, height: int, width: int, channels: list[str], view: str | None, tile: int = TILE, totals: bool = False) -> DataFrame:
    """Pixels of faces (mesh_id, fid, order, ax, ay, bx, by, cx, cy, channels), drawn by rising `order` and then fid.
    Faces go to every square of the canvas that they reach into; one square of one mesh is one group, whatever the size
    of mesh and canvas. Only drawn pixels come back. Without `view` faces name theirs in a column. totals: instead of its
    pixels each square gives their number n and, for each channel c, the number n_c and sum sum_c of its values."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "fid"])
        top, left = int(pdf["_row"].iloc[0]) * tile, int(pdf["_col"].iloc[0]) * tile
        t = pdf[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy(float).reshape(-1, 3, 2)
        at = covering(t, min(tile, height - top), min(tile, width - left), top, left)
        r, c = np.nonzero(at >= 0)
        name = pdf["view"].iloc[0] if view is None else view
        if totals:
            values = pdf[channels].to_numpy(float)[at[r, c]]
            out = {"mesh_id": [pdf["mesh_id"].iloc[0]], "view": [name], "n": [len(r)]}
            for k, channel in enumerate(channels):
                out |= {f"n_{channel}": [int((~np.isnan(values[:, k])).sum())], f"sum_{channel}": [float(np.nansum(values[:, k]))]}
            return pd.DataFrame(out)[: len(r)]
        out = pd.DataFrame({"mesh_id": pdf["mesh_id"].iloc[0], "view": name, "row": (r + top).astype(np.int32), "col": (c + left).astype(np.int32)})
        values = pdf[channels].to_numpy(float)[at[r, c]]
        for k, name in enumerate(channels):
            out[name] = values[:, k]
        return out

    def squares(k: str, size: int):
        corners = [F.col(c + k) for c in "abc"]
        last = -(-size // tile) - 1
        lo, hi = F.floor(F.least(*corners) / tile), F.floor(F.greatest(*corners) / tile)
        return F.when((hi >= 0) & (lo <= last), F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(last)).cast("int")))

    kind = faces_px.schema["mesh_id"].dataType.simpleString()
    # Two tables of squares and not one: a generator a select.
    binned = faces_px.withColumn("_row", F.explode(squares("y", height))).withColumn("_col", F.explode(squares("x", width)))
    given = "n long, " + ", ".join(f"n_{c} long, sum_{c} double" for c in channels) if totals else "row int, col int, " + ", ".join(f"{c} double" for c in channels)
    return binned.groupBy("mesh_id", *(["view"] if view is None else []), "_row", "_col").applyInPandas(draw, f"mesh_id {kind}, view string, {given}")


def encode_png(img: np.ndarray) -> bytes:
    """A picture (height, width) or (height, width, 3) of bytes as a PNG file."""
    h, w = img.shape[:2]
    kind = 2 if img.ndim == 3 else 0
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1).astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def pictures(pixels: DataFrame, height: int, width: int, channels: list[str]) -> DataFrame:
    """(mesh_id, view, png) of drawn pixels (mesh_id, view, row, col, channels in [0, 1]), one channel grey or three in
    colour, cut off to bytes, 0 where nothing is drawn. A picture is one group."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((height, width, len(channels)), np.uint8)
        img[pdf["row"], pdf["col"]] = (np.clip(pdf[channels].to_numpy(float), 0, 1) * 255).astype(np.uint8)
        return pd.DataFrame({"mesh_id": [pdf["mesh_id"].iloc[0]], "view": [pdf["view"].iloc[0]], "png": [encode_png(img if len(channels) == 3 else img[:, :, 0])]})

    kind = pixels.schema["mesh_id"].dataType.simpleString()
    return pixels.select("mesh_id", "view", "row", "col", *channels).groupBy("mesh_id", "view").applyInPandas(draw, f"mesh_id {kind}, view string, png binary")


def square_pad(img: np.ndarray) -> np.ndarray:
    """Zeros around an image until it is square."""
    h, w = img.shape[:2]
    n = max(h, w)
    out = np.zeros((n, n, *img.shape[2:]), img.dtype)
    out[(n - h) // 2 : (n - h) // 2 + h, (n - w) // 2 : (n - w) // 2 + w] = img
    return out


def resize(img: np.ndarray, n: int) -> np.ndarray:
    """Bilinear resize of a square image."""
    at = np.clip((np.arange(n) + 0.5) * img.shape[0] / n - 0.5, 0, img.shape[0] - 1)
    lo = np.floor(at).astype(int)
    hi, f = np.minimum(lo + 1, img.shape[0] - 1), at - lo
    wide = (slice(None), *[None] * (img.ndim - 1))
    rows = img[lo] * (1 - f[wide]) + img[hi] * f[wide]
    cols = (None, slice(None), *[None] * (img.ndim - 2))
    return rows[:, lo] * (1 - f[cols]) + rows[:, hi] * f[cols]


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """Bilinear rotation about the centre, same size, zeros outside."""
    t = np.deg2rad(degrees)
    h, w = img.shape[:2]
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    sx, sy = np.cos(t) * x - np.sin(t) * y + (w - 1) / 2, np.sin(t) * x + np.cos(t) * y + (h - 1) / 2
    x0, y0 = np.floor(sx + 1e-9).astype(int), np.floor(sy + 1e-9).astype(int)
    out = np.zeros(img.shape, float)
    for dx in (0, 1):
        for dy in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            weight = np.clip(1 - np.abs(sx - xi), 0, 1) * np.clip(1 - np.abs(sy - yi), 0, 1)
            ok = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            part = img[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)]
            weight = np.where(ok, weight, 0)
            out += part * (weight[:, :, None] if img.ndim == 3 else weight)
    return out


def align_angle(mask: np.ndarray, least: int = 10) -> float:
    """Degrees between an image's long axis and its vertical one, in [-90, 90]; 0 for fewer than `least` pixels."""
    r, c = np.nonzero(mask)
    if len(r) < least:
        return 0.0
    values, vectors = np.linalg.eigh(np.cov(np.stack([c, r]), bias=True))
    angle = float(np.rad2deg(np.arctan2(vectors[0, 1], vectors[1, 1])))
    return angle - 180 if angle > 90 else angle + 180 if angle < -90 else angle


def turned(img: np.ndarray, degrees: float, normals: tuple[tuple[int, int], ...] = ((0, 1), (3, 4))) -> np.ndarray:
    """A rotated image whose encoded normals (pairs of channels across and up) turn with it."""
    out = np.clip(rotate(img, degrees), 0, 1)
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    for x, y in normals:
        nx, ny = 2 * out[:, :, x] - 1, 2 * out[:, :, y] - 1
        out[:, :, x], out[:, :, y] = np.clip((c * nx - s * ny + 1) / 2, 0, 1), np.clip((s * nx + c * ny + 1) / 2, 0, 1)
    return out


def upright(img: np.ndarray) -> np.ndarray:
    """An image turned so that the long axis of what is drawn on it stands upright."""
    angle = align_angle(img[:, :, :3].sum(axis=2) > MASK)
    return turned(img, -angle) if angle else img
