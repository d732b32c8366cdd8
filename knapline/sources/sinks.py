"""Outputs. Tables are Parquet; the text formats are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import lineage
from ..operators.ordinals import numbered

# The fields of the metadata table and of the failure table, in order.
METADATA_FIELDS = ["filename", "num_original_vertices", "num_original_faces", "num_clean_vertices", "num_clean_faces", "sampling_mode", "num_points", "centroid_x", "centroid_y", "centroid_z", "scale_factor", "bbox_x", "bbox_y", "bbox_z", "surface_area", "embedding_path", "pointcloud_path", "preview_path"]
FAILURE_FIELDS = ["filename", "stage", "error"]


def with_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with exactly these fields: missing ones are null, others are dropped."""
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields))


def append_metadata(df: DataFrame, path: str, run_id: str) -> None:
    """Appends metadata rows of a run; the three sizes of an object, which the field list lacks, are kept as well."""
    fields = METADATA_FIELDS + ["dim_length", "dim_width", "dim_depth"]
    with_fields(df, fields).withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def append_failures(df: DataFrame, path: str) -> None:
    with_fields(df, FAILURE_FIELDS).write.mode("append").parquet(path)


def consolidated(df: DataFrame, key: str = "stem") -> DataFrame:
    """Embeddings with their place `ord` in the order of stems, nulls first; rows with equal stems follow each other in
    any order. Numbered range by range, right at any size."""
    return numbered(df, [key])


def write_clouds(points: DataFrame, path: str, run_id: str) -> None:
    """Points (mesh_id, pid, x, y, z, nx, ny, nz) of a run as single precision, a folder a run. A run that is written again
    replaces its own folder."""
    single = points.select("mesh_id", F.col("pid").cast("int").alias("pid"), *(F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")))
    single.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def ply_lines(points: DataFrame) -> DataFrame:
    """(mesh_id, text): an ASCII PLY file of each mesh's points with six decimals, with normals where there are any."""
    fields = [c for c in ("x", "y", "z", "nx", "ny", "nz") if c in points.columns]
    line = F.format_string(" ".join(["%.6f"] * len(fields)), *fields)
    g = points.groupBy("mesh_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pid", line.alias("l")))).alias("ls"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n").cast("string"), F.lit("".join(f"\nproperty float {c}" for c in fields) + "\nend_header\n"))
    return g.select("mesh_id", F.concat(head, F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n")).alias("text"))


def bytes_of(value):
    """A pixel value as a byte: clipped and cut off, not rounded."""
    return (F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")


def wide_matrix(long: DataFrame, labels: list) -> DataFrame:
    """(i, j, value) of pairs i < j as a square table for export; the diagonal is 1. labels must be few."""
    both = long.select("i", "j", "value").unionAll(long.select(F.col("j"), F.col("i"), "value"))
    own = long.select(F.explode(F.array("i", "j")).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    return both.unionAll(own).groupBy("i").pivot("j", labels).agg(F.first("value")).orderBy("i")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def pca_table(scores: DataFrame, k: int, key: str = "id") -> DataFrame:
    """(filename, pc1 .. pck) of scores (key, array pc)."""
    return scores.select(F.col(key).alias("filename"), *(F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)))


def neighbour_table(found: DataFrame) -> DataFrame:
    """(query, rank, neighbor, cosine_distance), distances with five decimals."""
    return found.select("query", "rank", F.col("neighbour").alias("neighbor"), F.round("distance", 5).alias("cosine_distance"))


def archetype_lines(mix: DataFrame, n: int = 5) -> DataFrame:
    """(k, text): for each archetype the n rows with the largest share in it (id, k, w), a line each."""
    top = mix.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.desc("w"), "id"))).where(F.col("r") <= n)
    line = F.format_string("  %s  %.4f", F.col("id").cast("string"), "w")
    listed = top.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))).alias("ls"))
    return listed.select("k", F.concat(F.format_string("archetype %d\n", F.col("k").cast("int")), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("text"))


def write_pictures(pictures: DataFrame, path: str, force: bool = False) -> int:
    """Appends pictures (mesh_id, view, png) that are not at `path` yet, all of them with `force`, which replaces what is
    there. Returns how many were written."""
    spark = pictures.sparkSession
    if not force and lineage.exists(spark, path):
        pictures = pictures.join(spark.read.parquet(path).select("mesh_id", "view"), ["mesh_id", "view"], "left_anti")
    pictures = lineage.settle(pictures)
    pictures.write.mode("overwrite" if force else "append").parquet(path)
    return pictures.count()


def write_archetypes(tips: DataFrame, mix: DataFrame, path: str, n: int = 5) -> None:
    """The arrays of an archetype analysis as tables, `tips` (k, columns) and `mixture` (id, k, w), and `report`, a text file
    with the rows that stand for each archetype."""
    tips.write.mode("overwrite").parquet(f"{path}/tips")
    mix.write.mode("overwrite").parquet(f"{path}/mixture")
    archetype_lines(mix, n).orderBy("k").select("text").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
