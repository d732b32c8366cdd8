"""Mesh files as vertex and face tables.

Files are found by Spark's binary source, so any store that Spark reads will do, and parsed by SQL functions alone:
regular expressions cut out the blocks, and grouping indices into faces is a running count of end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import settle

SUFFIXES = "*.{[wW][rR][lL],[vV][rR][mM][lL]}"
NUMBER = r"([-+]?(?:[0-9]*\.[0-9]+|[0-9]+\.?)(?:[eE][-+]?[0-9]+)?)"
POINTS, INDICES = r"(?is)\bpoint\s*\[([^\]]*)\]", r"(?is)\bcoordIndex\s*\[([^\]]*)\]"


def find(spark: SparkSession, directory: str, limit: int | None = None) -> DataFrame:
    """(mesh_id, stem, path, length, content) of the mesh files below a directory; limit: the first by path, 0 or None all of them, in no order.
    mesh_id is the path below the directory, so that equal names in two folders stay apart."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIXES).load(directory)
    files = files.orderBy("path").limit(limit) if limit else files
    return files.select(below(directory).alias("mesh_id"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), "path", "length", "content")


def below(directory: str) -> Column:
    """The column `path` without its scheme and this directory."""
    root = directory.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z0-9]+:/*", ""), "^" + _quoted(root) + "/", "")


def named(spark: SparkSession, paths: list[str], directory: str | None = None, limit: int | None = None) -> DataFrame:
    """The mesh files that are named one by one, and after them those below a directory; a file that is named twice, or
    lies there too, comes twice. Columns as in `find`; a named file's mesh_id is its whole path."""
    parts = [spark.read.format("binaryFile").load(p).select(F.regexp_replace("path", r"^[a-zA-Z0-9]+:/*", "/").alias("mesh_id"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), "path", "length", "content") for p in paths]
    parts += [find(spark, directory, limit)] if directory else []
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def texts(files: DataFrame) -> DataFrame:
    """(mesh_id, text): comments are gone, invalid bytes are replacement characters."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("mesh_id", F.regexp_replace(text, r"#[^\n]*", "").alias("text"))


def points(meshes: DataFrame) -> DataFrame:
    """(mesh_id, vid, x, y, z) of the first point block; numbers beyond the last whole triple are dropped."""
    numbers = F.expr(f"transform(regexp_extract_all(regexp_extract(text, r'{POINTS}', 1), r'{NUMBER}', 1), x -> try_cast(x as double))")
    flat = meshes.select("mesh_id", numbers.alias("v")).where("size(v) >= 3")
    at = flat.select("mesh_id", "v", F.explode(F.sequence(F.lit(0), F.expr("size(v) div 3 - 1"))).alias("vid"))
    return at.select("mesh_id", F.col("vid").cast("long").alias("vid"), *(F.col("v")[(F.col("vid") * 3 + k).cast("int")].alias(n) for k, n in enumerate("xyz")))


def faces(meshes: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, fid, a, b, c) of the first index block. Triangles stay, quads are split, other polygons are dropped;
    a last face without its end mark counts if it is a triangle; faces with an index out of range are dropped."""
    numbers = F.expr(rf"transform(regexp_extract_all(regexp_extract(text, r'{INDICES}', 1), r'(-?[0-9]+)', 1), x -> try_cast(x as bigint))")
    flat = meshes.select("mesh_id", F.posexplode(numbers).alias("pos", "idx"))
    w = W.partitionBy("mesh_id").orderBy("pos")
    flat = flat.withColumn("face", F.count_if(F.col("idx") == -1).over(w) - (F.col("idx") == -1).cast("long"))
    polygon = flat.groupBy("mesh_id", "face").agg(F.array_sort(F.collect_list(F.when(F.col("idx") != -1, F.struct("pos", "idx")))).alias("p"), F.bool_or(F.col("idx") == -1).alias("ended"))
    p = F.transform("p", lambda x: x["idx"])
    n = F.size("p")
    tri = lambda i, j, k: F.struct(p[i].alias("a"), p[j].alias("b"), p[k].alias("c"))
    parts = F.when(n == 3, F.array(tri(0, 1, 2))).when((n == 4) & F.col("ended"), F.array(tri(0, 1, 2), tri(0, 2, 3)))
    found = polygon.select("mesh_id", "face", F.posexplode(parts).alias("part", "t")).select("mesh_id", "face", "part", "t.*")
    size = vertices.groupBy("mesh_id").agg(F.count("*").alias("n"))
    ok = found.join(size, "mesh_id").where("least(a, b, c) >= 0 and greatest(a, b, c) < n")
    return ok.withColumn("fid", F.row_number().over(W.partitionBy("mesh_id").orderBy("face", "part")) - 1).select("mesh_id", F.col("fid").cast("long").alias("fid"), "a", "b", "c")


def load(spark: SparkSession, directory: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, failures): a file without points or faces is a row (filename, stage, error)."""
    files = find(spark, directory, limit)
    meshes = texts(files)
    v = points(meshes)
    f = faces(meshes, v)
    missing = lambda df, what: files.join(df.select("mesh_id").distinct(), "mesh_id", "left_anti").select(F.col("mesh_id").alias("filename"), F.lit("load").alias("stage"), F.lit(what).alias("error"))
    no_points = missing(v, "no point block")
    failed = no_points.unionByName(missing(f, "no faces").join(no_points.select("filename"), "filename", "left_anti"))
    good = f.select("mesh_id").distinct()
    return v.join(good, "mesh_id", "left_semi"), f, failed


def layered(files: DataFrame, parsers: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, failures) of files (mesh_id, content) by the first parser that gives both for a file. parsers: by
    name, functions of such files that return vertices and faces. A file that all give up is one failure, with the names
    of all."""
    left, found = settle(files.select("mesh_id", "content")), []
    for parse in parsers.values():
        v, f = map(settle, parse(left))
        good = v.select("mesh_id").distinct().join(f.select("mesh_id").distinct(), "mesh_id")
        found.append((v.join(good, "mesh_id", "left_semi").select("mesh_id", "vid", "x", "y", "z"), f.join(good, "mesh_id", "left_semi").select("mesh_id", "fid", "a", "b", "c")))
        left = left.join(good, "mesh_id", "left_anti")
    vertices, faces = found[0]
    for v, f in found[1:]:
        vertices, faces = vertices.unionByName(v), faces.unionByName(f)
    error = "; ".join(f"{name}: no points or no faces" for name in parsers)
    return vertices, faces, left.select(F.col("mesh_id").alias("filename"), F.lit("load").alias("stage"), F.lit(error).alias("error"))


def native(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parser of this module for `layered`."""
    meshes = texts(files)
    v = points(meshes)
    return v, faces(meshes, v)


def blocks(meshes: DataFrame) -> DataFrame:
    """How many point and index blocks each file has; only the first of a kind is read."""
    count = lambda pattern: F.size(F.expr(f"regexp_extract_all(text, r'{pattern}', 1)"))
    return meshes.select("mesh_id", count(POINTS).alias("point_blocks"), count(INDICES).alias("index_blocks"))
