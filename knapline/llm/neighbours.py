"""Approximate nearest neighbours: a forest of random-projection trees and a priority queue that all trees share.

Planes are fitted on a bounded sample (`sample` distinct vectors, those that hash lowest); every vector is indexed.
Equal vectors form one entry first, within each task and then over all, with as many of their smallest ids as a
result can need, so that a vector that a third of the rows hold is compared once. A query pops tree nodes in the
order of the summed squares of the margins on the way there until it has visited `share` of all leaves, or `probes`
of them if that is more: where vectors have no structure to speak of, recall hangs on the share of the leaves that
are seen. Where they have structure a query stops sooner: the k-th distance within `PROBE` of the sampled vectors is
a radius beyond which none of the k nearest lies, planes farther away than that are not crossed, and once all that is
left of one tree has been visited nothing nearer can be elsewhere. Each leaf shortlists its entries by one matrix
product and ranks them by exact double-precision distance, and the best of all leaves are merged. Where there are so
many vectors that leaves of the sampled planes grow large, a leaf is ranked in blocks on several tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, released, rows, settle


PROBE = 4096


class Forest:
    """Trees in flat arrays. A node below `inner` holds a plane; children are given by `child`, leaves by -1 - leaf."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.normal, self.offset, self.child, self.roots, self.leaves = [], [], [], [], 0
        x = sample.astype(np.float32)
        for _ in range(trees):
            self.roots.append(self._grow(x, np.arange(len(x)), leaf, rng))
        d = x.shape[1]
        self.normal = np.array(self.normal, np.float32).reshape(len(self.normal), d)
        self.offset = np.array(self.offset, np.float32)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: int, rng) -> int:
        if len(at) > leaf:
            for _ in range(3):
                a, b = x[rng.choice(at, 2, replace=False)]
                normal = a - b
                size = float(np.linalg.norm(normal))
                if size == 0 or not np.isfinite(size):
                    continue
                side = x[at] @ (normal / size)
                offset = float(np.median(side))
                right = side > offset
                if 0 < right.sum() < len(at):
                    node = len(self.normal)
                    self.normal.append(normal / size)
                    self.offset.append(offset)
                    self.child.append([0, 0])
                    self.child[node] = [self._grow(x, at[~right], leaf, rng), self._grow(x, at[right], leaf, rng)]
                    return node
        self.leaves += 1
        return -self.leaves

    def assign(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each vector in each tree."""
        x = x.astype(np.float32)
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while (go := np.flatnonzero(node >= 0)).size:
                n = node[go]
                side = np.einsum("ij,ij->i", x[go], self.normal[n]) > self.offset[n]
                node[go] = self.child[n, side.astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def search(self, q: np.ndarray, probes: int, share: float, radius: float = np.inf) -> list[int]:
        """The leaves that a query visits, by one queue over all trees. No plane farther away than radius is crossed."""
        probes = max(probes, int(np.ceil(share * self.leaves)))
        margin = self.normal @ q.astype(np.float32) - self.offset if len(self.normal) else np.empty(0)
        queue = [(0.0, tree, root) for tree, root in enumerate(self.roots)]
        open_ = [1] * len(queue)
        found = []
        while queue and len(found) < probes:
            far, tree, node = heapq.heappop(queue)
            while node >= 0:
                m = float(margin[node])
                near = int(m > 0)
                if abs(m) <= radius:
                    heapq.heappush(queue, (far + m * m, tree, int(self.child[node, 1 - near])))
                    open_[tree] += 1
                node = int(self.child[node, near])
            found.append(-1 - node)
            open_[tree] -= 1
            if not open_[tree] and np.isfinite(radius):
                break
        return found


def radii(probe: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """For each row of q a distance within which `most` of the probe lie, with room for rounding; else infinity."""
    if len(probe) < most:
        return np.full(len(q), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        own = (q * q).sum(axis=1)
        d = (probe * probe).sum(axis=1)[None, :] - 2 * (q @ probe.T) + own[:, None]
        r = np.sqrt(np.maximum(np.partition(d, most - 1, axis=1)[:, most - 1], 0))
        r = r + 1e-4 * (2 * np.sqrt(own) + r)
    return np.where(np.isfinite(d).all(axis=1) & np.isfinite(r), r, np.inf)


def shortlists(x: np.ndarray, q: np.ndarray, most: int):
    """For each row of q the rows of x that can be among its `most` nearest: squared distances by a matrix product,
    and all that rounding may have moved past the last of them. Numbers too large for that leave every row."""
    if len(x) <= most:
        yield from (np.arange(len(x)) for _ in q)
        return
    with np.errstate(over="ignore", invalid="ignore"):
        size = (x * x).sum(axis=1)
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            d = size[None, :] - 2 * (part @ x.T)
            last = np.partition(d, most - 1, axis=1)[:, most - 1] + 1e-9 * (size.max() + (part * part).sum(axis=1))
            for row, limit, sound in zip(d, last, np.isfinite(d).all(axis=1), strict=True):
                yield np.flatnonzero(row <= limit) if sound else np.arange(len(x))


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = points.astype(np.float64) - q.astype(np.float64)
    return np.sqrt((d * d).sum(axis=1))


def _valid(batch: pa.RecordBatch, dims: int | None):
    for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
        if key is None or not vector or None in vector or dims and len(vector) != dims:
            continue
        v = np.array(vector, np.float64)
        if np.isfinite(v).all() and v.any():
            yield key, v


def search(vectors: DataFrame, k: int = 10, trees: int = 10, leaf: int = 250, probes: int = 80, share: float = 0.08, sample: int = 20_000, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do null ids or
    vectors of another length than most have. Ties go to the smaller id; a repeated row of one id counts once, while an
    id that comes with several vectors is an entry, and if it is a query a question, for each of them.
    An empty table gives no rows; with fewer than k other vectors a query gets all of them.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    lengths = own.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = lengths[0]["d"] if lengths else 0
    most = k + 1
    pair = pa.schema([("vector", pa.binary()), ("ids", pa.list_(pa.int64()))])

    @released
    def gather(batches):
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for key, v in _valid(batch, dims):
                ids = known.setdefault(v.tobytes(), [])
                if key not in ids:
                    ids.append(key)
                    if len(ids) > 4 * most:
                        ids.sort()
                        del ids[most:]
            if len(known) > 50_000:
                yield rows(pair, list(known), [sorted(i)[:most] for i in known.values()])
                known = {}
        if known:
            yield rows(pair, list(known), [sorted(i)[:most] for i in known.values()])

    entries = settle(own.mapInArrow(gather, "vector binary, ids array<long>").groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")))
    n = entries.count()
    drawn = entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    x = np.array([np.frombuffer(r["vector"], np.float64) for r in drawn]).reshape(len(drawn), dims)
    forest = spark.sparkContext.broadcast(Forest(x, trees, max(2, leaf * len(x) // max(n, 1))))
    probe = spark.sparkContext.broadcast(x[:PROBE])

    # Whatever the table's size, a task ranks leaves or blocks of them that hold some 4 * leaf entries.
    blocks = max(1, -(-n * trees // (4 * leaf * max(1, forest.value.leaves))))
    placed = pa.schema([("leaf", pa.int64()), ("block", pa.int64()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64())), ("query", pa.binary())])

    @released
    def place(batches):
        for batch in batches:
            for part in pieces_of(batch, 1000):
                raw = part.column("vector").to_pylist()
                at = forest.value.assign(np.array([np.frombuffer(v, np.float64) for v in raw]))
                block = [xxhash.xxh3_64_intdigest(v) % blocks for v in raw]
                for t in range(at.shape[1]):
                    yield rows(placed, at[:, t], block, raw, part.column("ids"), [None] * len(raw))

    @released
    def ask(batches):
        for batch in batches:
            for part in pieces_of(batch, 256):
                leaves, block, asked = [], [], []
                raw = part.column("vector").to_pylist()
                q = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dims)
                for v, row, radius in zip(raw, q, radii(probe.value, q, most), strict=True):
                    own_leaves = forest.value.search(row, probes, share, radius)
                    leaves += own_leaves * blocks
                    block += [b for b in range(blocks) for _ in own_leaves]
                    asked += [v] * len(own_leaves) * blocks
                yield rows(placed, leaves, block, [None] * len(leaves), [None] * len(leaves), asked)

    query_rows = pa.schema([("query_id", pa.int64()), ("vector", pa.binary())])

    @released
    def queries_of(batches):
        for batch in batches:
            found = list(_valid(batch, dims))
            yield rows(query_rows, [key for key, _ in found], [v.tobytes() for _, v in found])

    queries = settle(own.where(F.col("vec_id") % every == 0).mapInArrow(queries_of, "query_id long, vector binary").distinct())
    ddl = "leaf long, block long, vector binary, ids array<long>, query binary"
    both = entries.mapInArrow(place, ddl).unionAll(queries.select("vector").distinct().mapInArrow(ask, ddl))

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        asks = group[group["query"].notna()]
        points = group[group["vector"].notna()]
        out = []
        if len(asks) and len(points):
            x, q = (np.frombuffer(b"".join(v), np.float64).reshape(len(v), dims) for v in (points["vector"], asks["query"]))
            ids = list(points["ids"])
            first = np.array([i[0] for i in ids])
            for raw, row, some in zip(asks["query"], q, shortlists(x, q, most), strict=True):
                d = distances(x[some], row)
                near = sorted((float(d[j]), int(i)) for j in np.lexsort((first[some], d))[:most] for i in ids[some[j]])[:most]
                out.append((raw, [s for s, _ in near], [i for _, i in near]))
        return pd.DataFrame(out, columns=["query", "score", "vec_id"])

    # One row for each query and leaf. A vector has the same distance in every leaf, so equal pairs are one hit; since no
    # tree holds a vector twice, the first `most` hits are among the first `most` times `trees` pairs.
    found = both.groupBy("leaf", "block").applyInPandas(rank, "query binary, score array<double>, vec_id array<long>").select("query", F.arrays_zip("score", "vec_id").alias("hits"))
    best = found.groupBy("query").agg(F.slice(F.array_distinct(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, most * trees)), 1, most).alias("best"))
    answered = queries.join(best, queries["vector"] == best["query"]).select("query_id", F.slice(F.expr("filter(best, x -> x.vec_id <> query_id)"), 1, k).alias("best"))
    return answered.select("query_id", F.posexplode("best").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
