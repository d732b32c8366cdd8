"""Meshes through load, clean, sample and embed; each that fails does so under its stage, and the others go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import vrml
from . import embed, geometry, sampling
from .lineage import settle

MODES = {"uniform": "uniform", "curvature": "curvature", "edge_aware": "edge"}


def _lost(before: DataFrame, after: DataFrame, stage: str, error: str) -> DataFrame:
    gone = before.select("mesh_id").distinct().join(after.select("mesh_id").distinct(), "mesh_id", "left_anti")
    return gone.select(F.col("mesh_id").alias("filename"), F.lit(stage).alias("stage"), F.lit(error).alias("error"))


def process(files: DataFrame, points: int = 4096, mode: str = "uniform", embedder: embed.Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, embeddings, failures) of mesh files (mesh_id, content). metadata as geometry.mesh_metadata; embeddings
    (mesh_id, embedding); failures (filename, stage, error). A vector that is not finite fails in the stage embed."""
    meshes = vrml.texts(files)
    v = settle(vrml.points(meshes))
    f = settle(vrml.faces(meshes, v))
    failed = [_lost(files, v, "load", "no point block"), _lost(v, f, "load", "no faces")]
    clean = geometry.clean_mesh(v.join(f.select("mesh_id").distinct(), "mesh_id", "left_semi"), f)
    failed.append(_lost(f, clean[1], "clean", "no faces after cleaning"))
    unit = geometry.normalize(clean[0])
    cloud = settle(sampling.sample_edge_aware(unit, clean[1], points) if mode == "edge_aware" else sampling.sample(unit, clean[1], points, mode=MODES[mode]))
    failed.append(_lost(clean[1], cloud, "sample", "no area to sample"))
    vectors = settle(embed.embed(cloud, embedder, failures=True))
    failed.append(vectors.where("error is not null").select(F.col("mesh_id").alias("filename"), F.lit("embed").alias("stage"), "error"))
    failures = failed[0]
    for part in failed[1:]:
        failures = failures.unionByName(part)
    return geometry.mesh_metadata((v, f), clean), vectors.where("error is null").select("mesh_id", "embedding"), failures


def report(vertices: DataFrame, faces: DataFrame, points: int = 256) -> DataFrame:
    """One row per mesh: counts and box before cleaning, counts and area after it, the normalised extent, and for each
    sampler how many points it gave and whether all of them and their normals are finite."""
    clean = geometry.clean_mesh(vertices, faces)
    unit = settle(geometry.normalize(clean[0]))
    m = settle(geometry.measured(unit, clean[1]))  # read by every sampler
    extent = unit.groupBy("mesh_id").agg(F.max(F.greatest(*(F.abs(k) for k in "xyz"))).alias("extent"))
    about = geometry.mesh_metadata((vertices, faces), clean).select("mesh_id", "num_original_vertices", "num_original_faces", "num_clean_vertices", "num_clean_faces", "surface_area")
    out = about.join(geometry.shuffled(geometry.bbox(vertices).select("mesh_id", "ex", "ey", "ez")), "mesh_id").join(geometry.shuffled(extent), "mesh_id", "left")
    for name, mode in MODES.items():
        p = sampling.sample_edge_aware(unit, clean[1], points, m=m, keep=settle) if name == "edge_aware" else sampling.sample(unit, clean[1], points, mode=mode, m=m, keep=settle)
        fine = F.bool_and(F.expr(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in p.columns if c in ("x", "y", "z", "nx", "ny", "nz"))))
        out = out.join(geometry.shuffled(p.groupBy("mesh_id").agg(F.count("*").alias(f"n_{name}"), fine.alias(f"ok_{name}"))), "mesh_id", "left")
    return out.withColumn("status", F.when(F.coalesce("num_clean_faces", F.lit(0)) == 0, "no faces after cleaning").otherwise("ok"))
