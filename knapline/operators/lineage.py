"""Cutting lineage by tables in the shared folder that the cluster names in spark.checkpoint.dir.

All tables of an application lie in one folder there, knapline-<application id>. `settle` leaves its table, since what
it returns is read later; a `Scratch` block deletes its tables when it ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only where Spark runs in this one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="knapline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/knapline-{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _written(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """df written and read again, so that a long chain of joins isn't planned or run once for each later use."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


class Scratch:
    """Settles tables that only the `with` block reads. What leaves the block must not depend on them any more: settle
    it with the plain function."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def settle(self, df: DataFrame) -> DataFrame:
        self.paths.append(_written(df))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        """Deletes what has been settled so far."""
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()

    def __exit__(self, *error) -> None:
        self.drop()
