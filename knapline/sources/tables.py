"""Other inputs: numpy arrays, metadata and specimen sheets, scales, images."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import site_key, stem
from ..operators import geometry, lineage
from . import vrml


def npy(spark: SparkSession, directory: str) -> DataFrame:
    """(stem, row, v) of the .npy files below a directory: a matrix gives its rows, a vector one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(directory)

    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
                yield pd.DataFrame({"stem": path.rsplit("/", 1)[-1][:-4], "row": range(len(a)), "v": list(a)})

    return files.select("path", "content").mapInPandas(read, "stem string, row long, v array<double>")


def metadata_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A metadata table with a header. The schema is given: inferring it would read the data twice."""
    return spark.read.csv(path, header=True, schema=schema)


def sheet(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """An exported sheet without a header, as (row_idx, c0 ..): row numbers follow the file's lines."""
    raw = spark.read.csv(path, header=False, schema=", ".join(f"c{k} string" for k in range(columns)))
    return raw.withColumn("row_idx", F.monotonically_increasing_id())


def unpivot_specimens(wide: DataFrame, sites: int) -> DataFrame:
    """(stem, site, note) of a specimen sheet: column 2i+1 has a site's name and below it stems, column 2i+2 their
    notes. Blank cells are skipped; of repeated stems the one furthest to the right counts, then the lowest."""
    parts = ", ".join(f"{i}, c{2 * i + 1}, c{2 * i + 2}" for i in range(sites))
    long = wide.select("row_idx", F.expr(f"stack({sites}, {parts}) as (site_idx, cell, note)"))
    long = long.crossJoin(F.broadcast(wide.agg(F.min("row_idx").alias("_first"))))
    names = long.where("row_idx = _first").select("site_idx", site_key(F.col("cell")).alias("site"))
    cells = long.where("row_idx > _first and trim(cell) <> ''").select("site_idx", "row_idx", F.trim("cell").alias("stem"), F.nullif(F.trim("note"), F.lit("")).alias("note"))
    joined = cells.join(F.broadcast(names), "site_idx")
    last = F.struct("site_idx", "row_idx")
    return joined.groupBy("stem").agg(F.max_by("site", last).alias("site"), F.max_by("note", last).alias("note"))


def _clean(c: str) -> Column:
    t = F.trim(F.col(c))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def site_attributes(wide: DataFrame, names: list[str], until: bool = False) -> DataFrame:
    """Rows of a site sheet (row_idx, c0, c1 ..) by normalised site name, blanks as null. Rows without a name and rows
    that begin "Site Name" are skipped; with `until`, reading stops at the first such row."""
    rows = wide.where(_clean("c0").isNotNull())
    if until:
        stop = wide.where("c0 like 'Site Name%'").agg(F.min("row_idx").alias("_stop"))
        rows = rows.crossJoin(F.broadcast(stop)).where("_stop is null or row_idx < _stop")
    return rows.where("c0 not like 'Site Name%'").select(site_key(F.col("c0")).alias("site"), *(_clean(f"c{k + 1}").alias(n) for k, n in enumerate(names)))


def scale_json(spark: SparkSession, path: str) -> DataFrame:
    """The corpus scale as one row: a JSON object, or an old text file with one number, which means a square canvas."""
    if path.endswith(".txt"):
        return spark.read.text(path, wholetext=True).select(F.trim("value").cast("double").alias("scale"), F.lit(None).cast("int").alias("canvas_W"), F.lit(None).cast("int").alias("canvas_H"), F.lit(1.0).alias("max_z_range"))
    return spark.read.schema("scale double, canvas_W int, canvas_H int, max_z_range double").json(path, multiLine=True)


def dims_json(spark: SparkSession, path: str) -> DataFrame:
    """(stem, length, width, depth) of a JSON object {stem: [l, w, d]}."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("stem", "d"))
    return m.select("stem", *(F.col("d")[k].alias(n) for k, n in enumerate(("length", "width", "depth"))))


def dims(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(stem, length, width, depth): the JSON object at `path` if it is there, else the table beside it, else what follows
    from the points of the mesh files (mesh_id, content), which is then written as that table."""
    if lineage.exists(spark, path):
        return dims_json(spark, path)
    table = f"{path.removesuffix('.json')}.parquet"
    if not lineage.exists(spark, table):
        found = geometry.principal_extents(vrml.points(vrml.texts(files)))
        found.select(stem(F.col("mesh_id")).alias("stem"), "length", "width", "depth").write.parquet(table)
    return spark.read.parquet(table)


def latest(runs: DataFrame, by: str, tie: str, *keys: str) -> DataFrame:
    """Of each key the row with the last time, ties to the largest `tie`. One aggregate, no sort."""
    cols = [c for c in runs.columns if c not in keys]
    g = runs.groupBy(*keys).agg(F.max(F.struct(by, tie, *[c for c in cols if c not in (by, tie)])).alias("_r"))
    return g.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in cols))


def images(spark: SparkSession, directory: str) -> DataFrame:
    """(stem, height, width, row, col, channel, value) of images that Spark decodes, values in [0, 1]. Linear in pixels;
    a task holds one image at a time."""
    img = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(directory).select("image.*")
    kinds = [("stem", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("channel", pa.int32()), ("value", pa.float64())]

    def pixels(batches):
        for batch in batches:
            for stem, h, w, c, data in zip(*(batch.column(k).to_pylist() for k in ("stem", "height", "width", "nChannels", "data")), strict=True):
                row, col, channel = (x.ravel().astype(np.int32) for x in np.indices((h, w, c)))
                # Spark stores channels as blue, green, red.
                value = np.frombuffer(data, np.uint8)[: h * w * c] / 255
                columns = [[stem] * len(value), np.full(len(value), h, np.int32), np.full(len(value), w, np.int32), row, col, np.int32(c - 1) - channel, value]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    named = img.select(F.regexp_extract("origin", r"([^/]*)\.[^./]*$", 1).alias("stem"), "height", "width", "nChannels", "data")
    return named.mapInArrow(pixels, "stem string, height int, width int, row int, col int, channel int, value double")


def cached(wanted: DataFrame, have: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(reusable, to compute): what is there already and what is not."""
    return wanted.join(have.select(key), key, "left_semi"), wanted.join(have.select(key), key, "left_anti")
