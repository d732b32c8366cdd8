"""New files as a stream: each batch's meshes go through the chain, what they give is appended, what fails is set aside
under its stage, and tables that depend on all meshes follow from small sums that batches leave behind.

A batch's results, failures and sums are partitions named by its number. A batch that runs again, as after a failure,
overwrites its own partitions, so that nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chain, embed, similarity
from ..sources import sinks, vrml

FILES = "path string, modificationTime timestamp, length long, content binary"
EXTENT = ("bbox_x", "bbox_y", "bbox_z", "surface_area")
STATE = "n long, mean array<double>, scatter array<double>, " + ", ".join(f"{c} double" for c in EXTENT)


def sums(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: how many vectors (mesh_id, embedding) there are, their mean and scatter, and the largest extents and area
    of their meshes. Such rows of parts merge into that of the whole."""
    v = vectors.select("embedding").withColumnRenamed("embedding", "v")
    n, mean, cov = similarity.moments(v)
    most = metadata.join(vectors.select("mesh_id"), "mesh_id", "left_semi").agg(*(F.max(c).cast("double").alias(c) for c in EXTENT))
    row = (n, None, None) if not n else (n, mean.tolist(), (cov * n).ravel().tolist())
    return vectors.sparkSession.createDataFrame([row], STATE.split(", bbox", 1)[0]).crossJoin(most)


def merged(parts: DataFrame) -> DataFrame:
    """(n, mean, scatter, extents): one row of all parts, by pairs as they come in groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = (0, None, None)
        for n, m, g in zip(pdf["n"], pdf["mean"], pdf["scatter"], strict=True):
            if n:
                total = similarity.merged(*total, n, np.array(m), np.array(g).reshape(len(m), -1))
        n, mean, scatter = total
        return pd.DataFrame({"n": [n], "mean": [mean], "scatter": [None if scatter is None else scatter.ravel()], **{c: [pdf[c].max()] for c in EXTENT}})

    named = parts.select("n", "mean", "scatter", *EXTENT)
    # Some hundred parts a group first: a long stream leaves many.
    grouped = named.withColumn("g", F.pmod(F.xxhash64("n", "mean"), F.lit(64))).groupBy("g").applyInPandas(lambda pdf: run(pdf), STATE)
    return grouped.groupBy().applyInPandas(run, STATE)


def state(spark: SparkSession, out: str) -> DataFrame:
    """(n, mean, scatter, extents) of all meshes so far, from one row a batch."""
    return merged(spark.read.schema(STATE + ", batch long").parquet(f"{out}/state"))


def ingest(spark: SparkSession, directory: str, out: str, checkpoint: str, refresh: Callable[[DataFrame], None] | None = None, points: int = 1024, embedder: embed.Embedder | None = None) -> StreamingQuery:
    """Processes mesh files that have not been seen, once each, until none is left. The file source's checkpoint
    remembers them; a file's name is its path below the directory, so that equal names in two folders stay apart. Below
    `out` stand embeddings, metadata, failures (filename, stage, error) and the batches' sums; `refresh` is given the
    state after each batch."""

    def batch(files: DataFrame, number: int) -> None:
        process_batch(files.select(vrml.below(directory).alias("mesh_id"), "content"), number, out, points, embedder)
        if refresh:
            refresh(state(spark, out))

    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", vrml.SUFFIXES).load(directory)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_batch(files: DataFrame, number: int, out: str, points: int = 1024, embedder: embed.Embedder | None = None) -> None:
    """The chain over the files (mesh_id, content) of a batch, written as its partitions."""
    files = files.persist()
    metadata, vectors, failures = chain.process(files, points, embedder=embedder)
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    write(vectors, "embeddings")
    write(metadata, "metadata")
    write(sinks.with_fields(failures, sinks.FAILURE_FIELDS), "failures")
    spark = files.sparkSession
    back = lambda name, df: spark.read.schema(df.schema).parquet(f"{out}/{name}/batch={number}")
    write(sums(back("metadata", metadata), back("embeddings", vectors)), "state")
    files.unpersist()
