"""Embedding analytics: vectors (id, embedding) as arrays of doubles.

Neighbour search compares blocks of vectors, so that a task holds two blocks and gives out k rows a query, not all pairs. Matrices of all pairs are as large as their definition; what is shuffled for them is the vectors once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, knn
from .lineage import Scratch
from .ward import ward_order  # noqa: F401


def doubles(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) with non-null vectors as doubles."""
    return df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def row_norms(v: DataFrame) -> DataFrame:
    return v.select("id", F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm"))


def unit(v: DataFrame) -> DataFrame:
    """Rows over their norms; a zero row stays zero."""
    n = F.sqrt(dot(F.col("v"), F.col("v")))
    return v.select("id", F.when(n > 0, F.transform("v", lambda x: x / n)).otherwise(F.col("v")).alias("v"))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


def _pairs(u: DataFrame, prepare, kernel, schema: str, size: int = blocks.SIZE) -> DataFrame:
    """kernel(ids, x, jds, y, same) of every two blocks of prepared vectors, those with smaller ids first, and of every block
    with itself."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                p, n, ids, x, q, m, jds, y = (batch.column(c)[k] for c in ("b", "n", "ids", "x", "q", "m", "jds", "y"))
                yield from kernel(ids.values, blocks.matrix(x, n.as_py()), jds.values, blocks.matrix(y, m.as_py()), p.as_py() == q.as_py())

    u = u.where("id is not null")
    with Scratch(u.sparkSession) as scratch:
        n = u.count()
        rows = blocks.in_order(u, n, scratch, size, prepare)
        many = max(1, -(-n // size))
        other = rows.toDF("q", "m", "jds", "y")
        return blocks.met(rows, other, (many, many), run, schema, F.col("b") <= F.col("q"))


def _like_together(value: np.ndarray) -> np.ndarray:
    """An order of values in four ranges, in each as they stand. Rounded values then recur within a page of a columnar file, so that a
    dictionary holds them, at some two bytes each instead of eight."""
    mean, spread = (value.mean(), 0.6745 * value.std()) if len(value) else (0, 0)
    return np.argsort((value > mean - spread).astype(np.uint8) + (value > mean) + (value > mean + spread), kind="stable")


def _products(u: DataFrame, size: int = blocks.SIZE, prepare=None, places: int | None = None) -> DataFrame:
    """(i, j, value) for i < j: dot products, one matrix product for each pair of blocks, rounded half away from zero to
    `places` where that is asked for."""
    kind = u.schema["id"].dataType.simpleString()
    scale = None if places is None else 10.0**places

    def kernel(ids, x, jds, y, same):
        a, b = ids.to_numpy(zero_copy_only=False), jds.to_numpy(zero_copy_only=False)
        # Blocks are in the order of ids, so that only a block with itself, or ids that stand in two, are compared.
        whole = not same and a[-1] < b[0]
        step = max(1, 500_000 // len(b))
        for lo in range(0, len(a), step):
            value = x[lo : lo + step] @ y.T
            if scale:
                value = np.copysign(np.floor(np.abs(value) * scale + 0.5) / scale, value) + 0.0
            at = _like_together(value.ravel())
            if not whole:
                at = at[(a[lo : lo + step, None] < b[None, :]).ravel()[at]]
            i, j = np.divmod(at, len(b))
            i, value = i + lo, value.ravel()[at]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), jds.take(pa.array(j)), pa.array(value)], ["i", "j", "value"])

    return _pairs(u, prepare, kernel, f"i {kind}, j {kind}, value double", size)


def largest_cosine(v: DataFrame, size: int = blocks.SIZE) -> DataFrame:
    """(value): the largest absolute cosine of two rows with different ids, one row for some pairs of blocks; the matrix
    itself is never formed."""

    def kernel(ids, x, jds, y, same):
        a, b = ids.to_numpy(zero_copy_only=False), jds.to_numpy(zero_copy_only=False)
        value = x @ y.T
        if same or not a[-1] < b[0]:
            value = value[a[:, None] < b[None, :]]
        if value.size:
            yield pa.RecordBatch.from_arrays([pa.array([max(value.max(), -value.min())])], ["value"])

    return _pairs(v, _unit_rows, kernel, "value double", size)


def cosine_matrix(v: DataFrame, places: int | None = None) -> DataFrame:
    """(i, j, value) for i < j."""
    return _products(v, prepare=_unit_rows, places=places)


def pearson_matrix(v: DataFrame, places: int | None = None) -> DataFrame:
    """(i, j, value) for i < j: the correlation of two rows is the cosine of their centred forms."""
    return _products(v, prepare=lambda x: _unit_rows(x - x.mean(axis=1, keepdims=True)), places=places)


def neighbours(v: DataFrame, k: int, block: int = 2048, queries: Column | str | None = None) -> DataFrame:
    """(query, rank, neighbour, distance): the k nearest others by cosine distance, ties to the smaller id. The row
    itself is left out by its id, so that exact copies count as neighbours. queries: as for knn.nearest."""
    return knn.nearest(unit(v), k, block=block, queries=queries)


def scaled(v: DataFrame) -> DataFrame:
    """(id, v) with columns about their mean over their population deviation, as whole vectors."""
    n, mean, cov = moments(v)
    if not n:
        return v
    s = np.sqrt(np.diag(cov))
    s = np.where(s > 0, s, 1.0)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(v=[(np.asarray(x, float) - mean) / s for x in pdf["v"]])

    return v.select("id", "v").mapInPandas(run, v.select("id", "v").schema)


def fuzzy_graph(v: DataFrame, k: int = 15) -> DataFrame:
    """(i, j, w): the weighted neighbour graph of standardized vectors, k neighbours a row with itself, fewer where there
    are fewer rows."""
    k = min(k, v.count() - 1)
    if k < 2:
        return v.sparkSession.createDataFrame([], "i long, j long, w double")
    return knn.fuzzy_graph(knn.nearest(scaled(v), k - 1, cosine=False), k)


def standardize(v: DataFrame) -> DataFrame:
    """(id, dim, z): columns about their mean over their population deviation; a constant column is 0."""
    long = v.select("id", F.posexplode("v").alias("dim", "x"))
    m = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.join(F.broadcast(m), "dim").select("id", "dim", ((F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))


def mean_pool(v: DataFrame, key: str) -> DataFrame:
    """(key, dim, mean) over the rows of a key."""
    return v.select(key, F.posexplode("v").alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("mean"))


def merged(n: int, mean, scatter, m: int, other, more) -> tuple:
    """Rows, mean and scatter of two sets together."""
    if not n:
        return m, other, more
    d, total = other - mean, n + m
    return total, mean + d * m / total, scatter + more + np.outer(d, d) * n * m / total


def moments(v: DataFrame, groups: int = 8) -> tuple[int, np.ndarray | None, np.ndarray | None]:
    """Rows, column means and the covariance (population), in one job: tasks form sums, a few groups merge those, and at
    most `groups` times d x d numbers reach the driver, however many rows there are. No rows give 0 and None."""

    def partial(batches):
        n, s, g, m0 = 0, 0.0, 0.0, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"]).astype(float)
                m0 = x.mean(axis=0) if m0 is None else m0
                y = x - m0
                n, s, g = n + len(x), s + y.sum(axis=0), g + y.T @ y
        if n:
            m = m0 + s / n
            yield pd.DataFrame({"n": [n], "m": [m], "g": [(g - np.outer(s, s) / n).ravel()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = (0, None, None)
        for n, m, g in zip(pdf["n"], pdf["m"], pdf["g"], strict=True):
            out = merged(*out, n, np.array(m), np.array(g).reshape(len(m), -1))
        return pd.DataFrame({"n": [out[0]], "m": [out[1]], "g": [out[2].ravel()]})

    schema = "n long, m array<double>, g array<double>"
    parts = v.select("v").mapInPandas(partial, schema).withColumn("k", F.spark_partition_id() % groups)
    out = (0, None, None)
    for r in sorted(parts.groupBy("k").applyInPandas(lambda pdf: merge(pdf), schema).collect(), key=lambda r: r["m"]):
        out = merged(*out, r["n"], np.array(r["m"]), np.array(r["g"]).reshape(len(r["m"]), -1))
    n, mean, scatter = out
    return n, mean, None if scatter is None else scatter / n


class Pca:
    """Principal components. scaled: of standardized columns, else of centred ones. Signs: the largest loading of each
    component is positive. Beyond min(rows, columns) components are zero."""

    def __init__(self, v: DataFrame, k: int, scaled: bool = True):
        n, mean, cov = moments(v)
        self.mean, self.scale = mean, np.ones(len(mean))
        if scaled:
            s = np.sqrt(np.diag(cov))
            self.scale = np.where(s > 0, s, 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(self.scale, self.scale))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        real = min(k, n, len(mean))
        self.components = np.zeros((k, len(mean)))
        self.components[:real] = vectors[:, :real].T
        self.ratio = np.zeros(k)
        self.ratio[:real] = values[:real] / max(values.sum(), 1e-300)

    def variance(self, v: DataFrame) -> DataFrame:
        """(pc, ratio, cumulative)."""
        rows = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(self.ratio, np.cumsum(self.ratio), strict=True))]
        return v.sparkSession.createDataFrame(rows, "pc int, ratio double, cumulative double")

    def transform(self, v: DataFrame) -> DataFrame:
        """(id, pc1 .. pck)."""
        w, mean, scale = self.components, self.mean, self.scale
        names = [f"pc{i + 1}" for i in range(len(w))]

        def project(batches):
            for pdf in batches:
                out = (np.stack(pdf["v"]) - mean) / scale @ w.T if len(pdf) else np.empty((0, len(w)))
                yield pd.concat([pdf["id"].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

        return v.mapInPandas(project, "id long, " + ", ".join(f"{n} double" for n in names))
