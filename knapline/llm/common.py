"""Small helpers that the operators of this subpackage share.

Texts reach Python in Arrow batches; a null text is the empty text. Operators select only the columns that
they need, so further columns of any name cannot clash.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import Scratch, settle  # noqa: F401

SPACE = b" \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most `rows` rows from now on: a batch of Spark's 10,000 long texts takes executors hundreds of
    MB outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes, without a detour over str."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces_of(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that what is derived from a batch stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def text_key(raw: bytes) -> bytes:
    """128 bits that stand for a whole text."""
    return xxhash.xxh3_128_digest(raw)


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_SPACES = np.isin(np.arange(256), list(SPACE))
_LENGTHS = mix(np.arange(1, 66, dtype=np.uint64))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 64  # bytes of a word from which it is hashed on its own


def hash_words(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: what bytes.split() gives, but without an object a word. A word is
    taken in lanes of 8 bytes, each of which is mixed in by a bijection; a long word goes by its xxh3 hash."""
    if not raw:
        return np.empty(0, np.uint64)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_SPACES[np.frombuffer(raw, np.uint8)]
    turn = np.diff(word)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    size = end - start
    lane = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))  # the 8 bytes from every place on
    out = mix(lane[start] & _MASKS[np.minimum(size, 8)]) ^ _LENGTHS[np.minimum(size, 65) - 1]
    at, left = start, size
    more = np.flatnonzero((size > 8) & (size <= LONG))
    while len(more):
        at, left = at + 8, left - 8
        out[more] = mix((out[more] + np.uint64(0x9E3779B97F4A7C15)) ^ (lane[at[more]] & _MASKS[np.minimum(left[more], 8)]))
        more = more[left[more] > 8]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return out


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k <= 64 neighbours, order included."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = h[:n] * _PLACES[0]
    for i in range(1, k):
        out += h[i : i + n] * _PLACES[i]
    return mix(out + np.uint64(k))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(run: Callable) -> Callable:
    """run, whose task gives memory back when it ends: Python workers outlive tasks, and one executor has several."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], step: int = 256) -> Callable:
    @released
    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, step):
                yield fn(part)

    return run
