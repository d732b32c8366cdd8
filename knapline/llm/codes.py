"""Vector code compression: product quantisation in whole numbers, the same bit for bit on any machine and partitioning.

Components become floor(1024 x). A vector's four parts are each replaced by the number of the nearest of 256 entries of
that part's codebook. Nearest entries are screened by a float32 matrix product: every score comes with a bound of its
rounding error, and each entry whose interval reaches down to the best upper end is measured again in int64; of equals
the lowest number counts. A round of the fit is one pass over the vectors, whose tasks give out at most one row for each
entry; codebooks, which have a fixed size, are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released, rows, settle

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Whole components below this size (vectors within +-131,072) keep all sums of squares of a part within int64.
MOST = 1 << 27
STEP = 512
#: Sums for labels are broadcast up to so many labels, and joined by salted labels beyond.
LABELS = 100_000


def vectors(batch: pa.RecordBatch, name: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, whole): which rows of a batch have a vector without null or non-finite components, and their components
    as whole numbers. Raises where such a vector has another length, or components that int64 can't measure."""
    column = batch.column(name)
    size = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(-1)), -1)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), float)
    ends = np.cumsum(np.maximum(size, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = (size >= 0) & (bad[ends] == bad[ends - np.maximum(size, 0)])
    if (size[kept] != length).any():
        raise ValueError(f"vectors must have {length} components, as the first has")
    index = (ends[kept] - length)[:, None] + np.arange(length)[None, :]
    scaled = np.floor(flat[index] * SCALE)
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise ValueError(f"components must lie within +-{MOST // SCALE}")
    return kept, scaled.astype(np.int64)


class Screen:
    """The nearest entry of a codebook, exactly."""

    def __init__(self, book: np.ndarray):
        # An entry equal to an earlier one never wins.
        _, first = np.unique(book, axis=0, return_index=True)
        self.number = np.sort(first)
        self.book = book[self.number].astype(np.int64)
        self.low = np.ascontiguousarray(self.book.astype(np.float32).T)
        square = (self.book * self.book).sum(axis=1).astype(float)
        self.square, self.norm = square.astype(np.float32), np.sqrt(square)
        # Relative error of a product of k terms in float32, in any order: k roundings of sums and products, and one for
        # each factor that 24 bits don't hold; twice that covers what the bound itself is rounded by.
        k, unit = book.shape[1] + 2, 2.0**-24
        self.product = 2 * k * unit / (1 - k * unit)
        self.rest = 8 * unit

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of rows of whole numbers."""
        entry, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for lo in range(0, len(x), STEP):
            entry[lo : lo + STEP], far[lo : lo + STEP] = self._nearest(x[lo : lo + STEP])
        return entry, far

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of |c|^2 - 2 x.c for every row x and entry c."""
        product = x.astype(np.float32) @ self.low
        score = self.square[None, :] - 2 * product
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        # |x.c| <= |x| |c|: the product's error and that of the difference are shares of it and of |c|^2.
        width = np.outer(norm, self.norm * 2 * (self.product + self.rest)) + self.rest * self.norm**2
        return score - width, score + width

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = self.intervals(x)
        row, at = np.nonzero(lower <= upper.min(axis=1)[:, None])
        far = ((x[row] - self.book[at]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(far, starts) if len(starts) else far
        equal = np.flatnonzero(far == best[row])
        won = equal[np.flatnonzero(np.diff(row[equal], prepend=-1))]
        return self.number[at[won]], best


@dataclass
class Books:
    """Four codebooks, each of the same number of entries."""

    books: np.ndarray  # part, entry, position

    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def cut(self, whole: np.ndarray):
        width = self.books.shape[2]
        return [whole[:, p * width : (p + 1) * width] for p in range(len(self.books))]


def seeds(df: DataFrame, id_col: str, vector: str) -> Books | None:
    """The parts of the vectors with the smallest ids, at most 256; null ids come last, equal ids in the order of
    their vectors. None without vectors."""
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    first = [r[0] for r in df.where(ok).orderBy(F.col(id_col).asc_nulls_last(), vector).limit(ENTRIES).select(F.col(vector).cast("array<double>")).collect()]
    if not first:
        return None
    length = len(first[0])
    if length == 0 or length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} equal parts")
    column = pa.RecordBatch.from_arrays([pa.array(first, pa.list_(pa.float64()))], ["v"])
    _, whole = vectors(column, "v", length)
    return Books(whole.reshape(len(whole), PARTS, length // PARTS).transpose(1, 0, 2))


def _sums(df: DataFrame, vector: str, shared) -> DataFrame:
    """(part, entry, n, s ..): how many parts each entry is nearest to, and their sums."""
    width = shared.value.books.shape[2]
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), *((f"s{k}", pa.int64()) for k in range(width))])

    @released
    def add(batches):
        now = shared.value
        parts, entries, width = now.books.shape
        screens = [Screen(b) for b in now.books]
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            _, whole = vectors(batch, vector, parts * width)
            for p, x in enumerate(now.cut(whole)):
                entry, _ = screens[p].nearest(x)
                n[p] += np.bincount(entry, minlength=entries)
                np.add.at(s[p], entry, x)
        part, entry = np.nonzero(n)
        if len(part):
            yield rows(schema, part, entry, n[part, entry], *(s[part, entry, k] for k in range(width)))

    columns = ", ".join(["part int", "entry int", "n long", *(f"s{k} long" for k in range(width))])
    partial = df.select(vector).mapInArrow(add, columns)
    return partial.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{k}" for k in range(width))]))


def fit(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> Books | None:
    """Codebooks after some rounds: every part goes to its nearest entry, and each entry that has any becomes the floor
    of their mean."""
    books = seeds(df, id_col, vector)
    for _ in range(rounds if books else 0):
        shared = df.sparkSession.sparkContext.broadcast(books)
        found = _sums(df, vector, shared).collect()  # at most parts x entries rows
        moved = books.books.copy()
        for r in found:
            moved[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
        books = Books(moved)
        shared.unpersist()
    return books


def encode(df: DataFrame, books: Books, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label): two hex digits a part, and the squared distances summed over parts."""
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        now = shared.value
        screens = [Screen(b) for b in now.books]
        for batch in batches:
            kept, whole = vectors(batch, vector, now.books.shape[0] * now.books.shape[2])
            found = [screens[p].nearest(x) for p, x in enumerate(now.cut(whole))]
            code = np.stack([e for e, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            width = 2 * len(found)
            some = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([some.column(id_col), pa.array([code[k : k + width] for k in range(0, len(code), width)], pa.string()), pa.array(sum(d for _, d in found), pa.int64()), some.column(label)], ["id", "code", "error", "label"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(id_col, vector, label).mapInArrow(released(run), f"id {kinds[id_col]}, code string, error long, label {kinds[label]}")


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256), one row for each vector that is not null and has neither null
    nor non-finite components.

    Fewer than 256 such vectors give codebooks with an entry each. Repeated rows count as often as they stand there; an
    entry that ties with an earlier one is not used and stays. label_error sums over equal labels, null being one. An
    empty table gives no rows. Kept vectors must have the same length, a multiple of four, and components within
    +-131,072, else ValueError. Other columns are not read.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    books = fit(df, id_col, vector)
    if books is None:
        return spark.createDataFrame([], f"`{id_col}` {kinds[id_col]}, code string, error long, label_error long, codebooks_sha256 string")
    with Scratch(spark) as scratch:
        coded = scratch.settle(encode(df, books, id_col, vector, label))
        group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
        coded = coded.select("id", "code", "error", group.alias("g"))
        sums = scratch.settle(coded.groupBy("g").agg(F.sum("error").alias("label_error")))
        if sums.count() <= LABELS:
            out = coded.join(F.broadcast(sums), "g")
        else:
            salts = 64  # a label with very many vectors is met by as many tasks
            spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            out = coded.withColumn("salt", F.pmod(F.xxhash64("code", "error"), F.lit(salts)).cast("int")).join(spread, ["g", "salt"])
        return settle(out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))
