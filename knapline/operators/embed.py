"""Embedders: anything with `width` and `embed(points) -> vector`. The default describes geometry; networks plug in."""

from __future__ import annotations

import importlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry


class Embedder(Protocol):
    width: int

    def embed(self, points: np.ndarray) -> np.ndarray: ...


class Descriptor:
    """Moments and radius histogram of a normalised point cloud: deterministic, without weights."""

    def __init__(self, bins: int = 16):
        self.bins, self.width = bins, bins + 9

    def embed(self, points: np.ndarray) -> np.ndarray:
        x = points[:, :3] - points[:, :3].mean(axis=0)
        size = np.linalg.norm(x.max(axis=0) - x.min(axis=0)) or 1.0
        x = x / size
        r = np.linalg.norm(x, axis=1)
        values = np.linalg.eigvalsh(x.T @ x / len(x))[::-1]
        hist = np.histogram(r, bins=self.bins, range=(0, 0.75))[0] / len(x)
        return np.concatenate([hist, values, np.abs((x**3).mean(axis=0)), (x**4).mean(axis=0)])


def build(name: str = "descriptor", **kw) -> Embedder:
    """The default, or "module:Class" of one's own; a missing library is named in the error."""
    if name == "descriptor":
        return Descriptor(**kw)
    module, _, attribute = name.partition(":")
    try:
        made = getattr(importlib.import_module(module), attribute)(**kw)
    except ImportError as e:
        raise RuntimeError(f"embedder {name!r} needs {e.name}, which is not installed") from e
    if not hasattr(made, "embed") or not hasattr(made, "width"):
        raise TypeError(f"{name!r} has no embed() and width")
    return made


def embed(points: DataFrame, embedder: Embedder | None = None, failures: bool = False) -> DataFrame:
    """(mesh_id, embedding) of points (mesh_id, pid, x, y, z): one cloud is one group. With failures, a cloud whose
    embedder raises or gives numbers that are not finite has a null vector and says why in `error`."""
    model = embedder or Descriptor()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, vector, error = pdf.sort_values("pid")[["x", "y", "z"]].to_numpy(float), None, None
        try:
            vector = np.asarray(model.embed(x), float).tolist()
            if failures and not np.isfinite(vector).all():
                vector, error = None, "not finite"
        except Exception as e:
            if not failures:
                raise
            error = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"mesh_id": [pdf["mesh_id"].iloc[0]], "embedding": [vector], "error": [error]})

    kind = points.schema["mesh_id"].dataType.simpleString()
    out = points.select("mesh_id", "pid", "x", "y", "z").groupBy("mesh_id").applyInPandas(run, f"mesh_id {kind}, embedding array<double>, error string")
    return out if failures else out.drop("error")


def describe(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, n_vertices, n_faces, area, e1, e2, e3): geometry alone, without Python."""
    n = vertices.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))
    m = faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))
    return n.join(m, "mesh_id").join(geometry.surface_area(vertices, faces), "mesh_id").join(geometry.bbox(vertices).select("mesh_id", "e1", "e2", "e3"), "mesh_id")
