"""Exact nearest vectors with pruning by pivots, and the calibrated neighbour graph and layout that start from them.

Each vector belongs to the nearest of some pivots. A query looks first into its own pivot's block, which bounds how far
its k-th neighbour can be; by the triangle inequality it then skips every block all of whose vectors lie farther away. Blocks meet
in a product of partitions, so that vectors are shuffled once and a task gives out k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import blocks
from .lineage import Scratch, settle
from .ordinals import numbered

PIVOTS = 1_024  # at most, whatever the size: what is broadcast


def _near(k: int, cosine: bool):
    """The k nearest points of a block for each query, ties to the smaller id, without the query itself."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        points = points.sort_values("id")
        p, ids = np.stack(points["v"]), points["id"].to_numpy()
        out = []
        step = max(1, 8_000_000 // len(p))
        for lo in range(0, len(queries), step):
            part = queries.iloc[lo : lo + step]
            q, own = np.stack(part["v"]), part["id"].to_numpy()
            if cosine:
                d = 1 - q @ p.T
            else:
                d = np.maximum((q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * q @ p.T, 0)
            d[own[:, None] == ids[None, :]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(own)), top.shape[1])
            far = d[rows, top.ravel()] if cosine else np.sqrt(d[rows, top.ravel()])
            found = pd.DataFrame({"query": own[rows], "neighbour": ids[top.ravel()], "distance": far})
            out.append(found[np.isfinite(found["distance"])])
        return pd.concat(out)

    return run


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    g = (x * x).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(g, 0))


class Pivots:
    """Pivots of vectors (id, v) drawn by a hash of their ids, and vectors dealt to them: (id, v, c, chunk)."""

    def __init__(self, v: DataFrame, n: int, block: int, cosine: bool, scratch: Scratch):
        self.kind, self.cosine = v.schema["id"].dataType.simpleString(), cosine
        drawn = v.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // block))).collect()
        self.pivots = pivots = np.array([r["v"] for r in drawn], float)

        def assign(batches):
            for pdf in batches:
                d = _far(np.stack(pdf["v"]), pivots) if len(pdf) else np.empty((0, len(pivots)))
                yield pdf.assign(c=d.argmin(axis=1).astype(np.int32), e=d.min(axis=1) if len(d) else np.empty(0))

        dealt = scratch.settle(v.mapInPandas(assign, f"id {self.kind}, v array<double>, c int, e double"))
        about = {r["c"]: r for r in dealt.groupBy("c").agg(F.count("*").alias("n"), F.max("e").alias("e")).collect()}  # a row a pivot
        self.radius = np.array([about[c]["e"] if c in about else -np.inf for c in range(len(pivots))])
        self.chunks = [-(-about[c]["n"] // block) if c in about else 0 for c in range(len(pivots))]
        chunk = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.array(*map(F.lit, self.chunks))[F.col("c")])).cast("int")
        self.dealt = scratch.settle(dealt.select("id", "v", "c", chunk.alias("chunk")))

    def visits(self, bounded: DataFrame) -> DataFrame:
        """(id, v, c, chunk) for every block that may hold one of the k nearest of a query (id, v, c, chunk, reach), but
        its own. reach: how far the k-th is at most, as Euclidean distance."""
        pivots, radius, chunks = self.pivots, self.radius, self.chunks

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["v"])
                # Rounding of the distances to pivots only ever adds a visit.
                slack = 1e-6 * (1 + np.sqrt((x * x).sum(axis=1)))
                row, c = np.nonzero(_far(x, pivots) - radius[None, :] <= (pdf["reach"].to_numpy() + slack)[:, None])
                n = np.array(chunks)[c]
                row, c, chunk = np.repeat(row, n), np.repeat(c, n), np.concatenate([np.arange(k) for k in n]) if len(n) else np.empty(0, int)
                other = (pdf["c"].to_numpy()[row] != c) | (pdf["chunk"].to_numpy()[row] != chunk)
                row, c, chunk = row[other], c[other], chunk[other]
                for lo in range(0, len(row), 20_000):
                    part = row[lo : lo + 20_000]
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[part], "v": [x[i] for i in part], "c": c[lo : lo + 20_000].astype(np.int32), "chunk": chunk[lo : lo + 20_000].astype(np.int32)})

        return bounded.mapInPandas(run, f"id {self.kind}, v array<double>, c int, chunk int")


def _screened(k: int, cosine: bool, kind: str):
    """Of rows (a block of queries, a block of points) the k nearest points that a task has met for each query. Blocks that lie
    beyond what a query has found already are skipped for it, by their centre and radius."""

    def run(batches):
        found: dict = {}  # by block of queries: squared or cosine distances and ids, at most k a query
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: B023, E731
                key, n = (get("c").as_py(), get("chunk").as_py()), get("n").as_py()
                q, own = blocks.matrix(get("x"), n), get("ids").values.to_numpy(zero_copy_only=False)
                if key not in found:
                    found[key] = own, np.full((n, k), np.inf), np.full((n, k), own[0]), np.frombuffer(get("reach").as_buffer())
                _, far, ids, reach = found[key]
                p, others = blocks.matrix(get("px"), get("pn").as_py()), get("pids").values.to_numpy(zero_copy_only=False)
                centre = p.mean(axis=0)
                radius = np.sqrt(((p - centre) ** 2).sum(axis=1).max())
                slack = 1e-6 * (1 + np.sqrt((q * q).sum(axis=1)))
                kth = np.sqrt(2 * np.maximum(far[:, -1], 0)) if cosine else np.sqrt(far[:, -1])
                if cosine:  # a zero vector is at distance 1 of all, whatever its length tells
                    kth = np.where((far[:, -1] >= 1 - 1e-9) | ((q * q).sum(axis=1) == 0), np.inf, kth)
                near = np.flatnonzero(_far(q, centre[None, :])[:, 0] - radius <= np.minimum(kth, reach) + slack)
                step = max(1, 2_000_000 // len(p))
                for lo in range(0, len(near), step):
                    at = near[lo : lo + step]
                    d = 1 - q[at] @ p.T if cosine else np.maximum((q[at] * q[at]).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * q[at] @ p.T, 0)
                    if get("pc").as_py() == key[0]:
                        d[own[at][:, None] == others[None, :]] = np.inf
                    bound = np.minimum(far[at, -1], (reach[at] + slack[at]) ** 2 / (2 if cosine else 1))
                    i, j = np.nonzero(d <= bound[:, None])
                    i, j = i[keep := np.isfinite(d[i, j])], j[keep]
                    if not len(i):
                        continue
                    hit = np.unique(i)
                    old = at[hit]
                    rows = np.concatenate([np.repeat(old, k), at[i]])
                    dist, names = np.concatenate([far[old].ravel(), d[i, j]]), np.concatenate([ids[old].ravel(), others[j]])
                    order = np.lexsort((names, dist, rows))
                    rows, dist, names = rows[order], dist[order], names[order]
                    first = np.flatnonzero(np.diff(rows, prepend=-1))
                    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
                    few = place < k
                    far[rows[few], place[few]], ids[rows[few], place[few]] = dist[few], names[few]
        for own, far, ids, _ in found.values():
            i, j = np.nonzero(np.isfinite(far))
            if len(i):
                d = far[i, j] if cosine else np.sqrt(far[i, j])
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query": own[i], "neighbour": ids[i, j], "distance": d}), preserve_index=False)

    return run


def nearest(v: DataFrame, k: int, cosine: bool = True, block: int = 2_048, queries: Column | str | None = None) -> DataFrame:
    """(query, rank, neighbour, distance): the k nearest others of every vector (id, v), ties to the smaller id. A row is
    left out of its own neighbours by its id, so that copies count.

    cosine: vectors are unit vectors or zero and distances 1 - product; else Euclidean ones. Of equal vectors no more than
    k + 1 with the smallest ids can be anybody's neighbours; no more are compared. queries: a condition on id that names
    the rows whose neighbours are wanted, among all rows; without it every row's are.
    """
    kind = v.schema["id"].dataType.simpleString()
    ddl = f"query {kind}, neighbour {kind}, distance double"
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour"))
    ranked = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "neighbour", "distance")
    run = _near(k, cosine)
    n = v.count()
    if n <= block:
        whole = v.select(F.lit(0).alias("b"), "id", "v")
        asked = whole if queries is None else whole.where(queries)
        return ranked(asked.groupBy("b").cogroup(whole.groupBy("b")).applyInPandas(run, ddl))
    with Scratch(v.sparkSession) as scratch:
        p = Pivots(v.select("id", "v"), n, block, cosine, scratch)
        copy = F.row_number().over(W.partitionBy("v").orderBy("id"))
        points = scratch.settle(p.dealt.withColumn("_copy", copy).where(F.col("_copy") <= k + 1).drop("_copy"))
        meet = lambda q: q.groupBy("c", "chunk").cogroup(points.groupBy("c", "chunk")).applyInPandas(run, ddl)
        first = scratch.settle(meet(p.dealt if queries is None else p.dealt.where(queries)))
        # For unit vectors the squared Euclidean distance is twice the cosine distance; a zero vector, as near to all, bounds nothing.
        bound = first.groupBy(F.col("query").alias("id")).agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        reach = F.when(F.col("n") >= k, F.sqrt(2 * F.greatest("far", F.lit(0.0))) if cosine else F.col("far")).otherwise(float("inf"))
        if cosine:
            reach = F.when((F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) == 0) | (F.col("far") >= 1 - 1e-9), float("inf")).otherwise(reach)
        bounded = p.dealt.join(bound, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("id", "v", "c", "chunk", F.coalesce(reach, F.lit(float("inf"))).alias("reach"))
        if queries is not None:
            bounded = bounded.where(queries)
        asked = blocks.packed(bounded, ["c", "chunk"], scratch.settle, extra={"reach": float})
        held = blocks.packed(points, ["c", "chunk"], scratch.settle).toDF("pc", "pchunk", "pn", "pids", "px")
        return settle(ranked(blocks.met(asked, held, (sum(p.chunks), sum(p.chunks)), _screened(k, cosine, kind), ddl)))


def fuzzy_graph(found: DataFrame, k: int) -> DataFrame:
    """(i, j, w) for i < j: weights of the union of both rows' fuzzy sets. found: (query, rank, neighbour, distance), k
    counting the row itself, so that k - 1 neighbours stand in found.

    In a row the nearest that is not at distance 0 has weight 1, and the others fall off with a bandwidth at which the
    row's weights sum to log2(k); each row finds it by halving an interval.
    """
    w = directed(found, k)
    back = w.select(F.col("neighbour").alias("query"), F.col("query").alias("neighbour"), F.col("w").alias("back"))
    both = w.join(back, ["query", "neighbour"], "full").na.fill(0.0, ["w", "back"])
    pair = both.select(F.least("query", "neighbour").alias("i"), F.greatest("query", "neighbour").alias("j"), (F.col("w") + F.col("back") - F.col("w") * F.col("back")).alias("w"))
    return pair.groupBy("i", "j").agg(F.max("w").alias("w")).where("w > 0")


def directed(found: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, w) of each row alone."""
    kind = found.schema["query"].dataType.simpleString()
    rows = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "distance"))).alias("l"))
    wide = rows.select("query", F.transform("l", lambda x: x["neighbour"]).alias("to"), F.transform("l", lambda x: x["distance"]).alias("d"))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            n = max(map(len, pdf["d"]))
            d = np.full((len(pdf), n), np.inf)
            for row, x in zip(d, pdf["d"], strict=True):
                row[: len(x)] = x
            weight = weights_of(d, math.log2(k))
            yield pd.DataFrame({"query": np.repeat(pdf["query"].to_numpy(), [len(x) for x in pdf["d"]]), "neighbour": np.concatenate(list(pdf["to"])), "w": np.concatenate([w[: len(x)] for w, x in zip(weight, pdf["d"], strict=True)])})

    return wide.mapInPandas(run, f"query {kind}, neighbour {kind}, w double")


def weights_of(d: np.ndarray, goal: float, rounds: int = 64) -> np.ndarray:
    """exp(-(d - nearest) / bandwidth), at most 1, of rows of rising distances (infinite where there is none), all rows
    being halved together."""
    there = np.isfinite(d)
    rho = np.where(there & (d > 0), d, np.inf).min(axis=1)
    over = np.where(there, np.maximum(d - np.where(np.isfinite(rho), rho, 0)[:, None], 0), np.inf)
    lo, hi, at = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(rounds):
        more = np.exp(-over / at[:, None]).sum(axis=1) > goal
        hi, lo = np.where(more, at, hi), np.where(more, lo, at)
        at = np.where(np.isfinite(hi), (lo + hi) / 2, at * 2)
        at = np.maximum(at, 1e-300)
    mean = np.where(there, d, 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
    return np.exp(-over / np.maximum(at, 1e-3 * mean + 1e-300)[:, None])


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b with which 1 / (1 + a x^2b) comes nearest to 1 up to min_dist and an exponential fall beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(100):
        z = x ** (2 * p[1])
        f = 1 / (1 + p[0] * z)
        j = np.column_stack([-z * f * f, -2 * p[0] * z * np.log(x) * f * f])
        step = np.linalg.lstsq(j, y - f, rcond=None)[0]
        p = np.maximum(p + step, 1e-3)
        if np.abs(step).max() < 1e-10:
            break
    return float(p[0]), float(p[1])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers that depend on x as if at random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(i: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(_mixed(i.astype(np.uint64) + np.uint64(seed) * STRIDE) + j.astype(np.uint64) * STRIDE)


def _drawn(keys: np.ndarray, p: np.ndarray, n: int, negatives: int, epoch: int) -> tuple[np.ndarray, np.ndarray]:
    """Which edges an epoch draws, and the random rows of n beside each, by the edges' keys and the epoch alone."""
    unit = lambda x: (x >> np.uint64(11)) * 2.0**-53
    now = _mixed(keys + np.uint64(epoch + 1) * STRIDE)
    some = np.flatnonzero(unit(now) < p)
    rows = unit(_mixed(now[some, None] + np.arange(1, negatives + 1, dtype=np.uint64) * STRIDE)) * n
    return some, np.minimum(rows.astype(np.int64), n - 1)


def _sums(rows: int, i: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, other: np.ndarray, a: float, b: float) -> np.ndarray:
    """(rows, 3): the forces of each row's drawn edges, added up, and their number. Edge by edge: whose it is, where that row lies,
    where its other end does, where random rows do and whether they are other rows."""
    force = np.empty((len(i), 2))
    for lo in range(0, len(i), 50_000):
        part = slice(lo, lo + 50_000)
        d = x[part] - y[part]
        square = (d * d).sum(axis=1)
        power = square**b
        near = np.where(square > 0, -2 * a * b * power / np.where(square > 0, square, 1) / (1 + a * power), 0)
        e = x[part, None] - z[part]
        square = (e * e).sum(axis=2)
        away = np.where(other[part], 2 * b / ((0.001 + square) * (1 + a * square**b)), 0)
        force[part] = np.clip(near[:, None] * d, -4, 4) + np.clip(away[:, :, None] * e, -4, 4).sum(axis=1)
    return np.column_stack([*(np.bincount(i, f, rows) for f in force.T), np.bincount(i, minlength=rows)])


def _moved(x: np.ndarray, sums: np.ndarray, rate: float) -> np.ndarray:
    return x + rate * sums[:, :2] / np.maximum(sums[:, 2:], 1)


STRIDE = np.uint64(0x9E3779B97F4A7C15)
#: Rows a block of positions and directed edges a chunk of the graph, at most; rows and edges that one task lays out.
ROWS, EDGES, ONE_TASK = 16_384, 500_000, 600_000


def _in_one_task(pos: DataFrame, edges: DataFrame, epochs: int, negatives: int, seed: int, a: float, b: float) -> DataFrame:
    def run(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        rows, pairs = rows.sort_values("at"), pairs.sort_values(["i", "j"])
        x, n = rows[["u1", "u2"]].to_numpy(float), len(rows)
        i, j, p = (pairs[c].to_numpy() for c in "ijp")
        keys = _keys(i, j, seed)
        for epoch in range(epochs):
            some, o = _drawn(keys, p, n, negatives, epoch)
            own = i[some]
            x = _moved(x, _sums(n, own, x[own], x[j[some]], x[o], o != own[:, None], a, b), 1 - epoch / epochs)
        return rows[["id"]].assign(u1=x[:, 0], u2=x[:, 1])

    one = lambda df: df.withColumn("all", F.lit(0)).groupBy("all")
    return one(pos).cogroup(one(edges)).applyInPandas(run, pos.select("id", "u1", "u2").schema)


class _Chunk:
    """Some edges of the rows of a block in one epoch, to which the blocks of positions come one after another."""

    def __init__(self, block: int, i: np.ndarray, j: np.ndarray, p: np.ndarray, n: int, rows: int, negatives: int, seed: int, epoch: int):
        some, o = _drawn(_keys(i, j, seed), p, n, negatives, epoch)
        self.block, self.rows, self.left = block, rows, -(-n // rows)
        self.i, self.o, self.x = i[some], o, None
        self.asked = np.concatenate([j[some], o.ravel()])
        of = (self.asked // rows).astype(np.int32)
        self.order = np.argsort(of, kind="stable")
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=self.left))])
        self.there = np.empty((len(self.asked), 2))

    def meet(self, block: int, x: np.ndarray) -> bool:
        """Whether that was the last block."""
        at = self.order[self.bounds[block] : self.bounds[block + 1]]
        self.there[at] = x[self.asked[at] - block * self.rows]
        if block == self.block:
            self.x = x
        self.left -= 1
        return not self.left

    def sums(self, a: float, b: float) -> np.ndarray:
        own, m = self.i - self.block * self.rows, len(self.i)
        return _sums(len(self.x), own, self.x[own], self.there[:m], self.there[m:].reshape(*self.o.shape, 2), self.o != self.i[:, None], a, b)


def _in_blocks(pos: DataFrame, edges: DataFrame, n: int, epochs: int, negatives: int, seed: int, a: float, b: float, scratch: Scratch, steps: list[Scratch]) -> DataFrame:
    """One job an epoch. Chunks of edges stay with the executors; a task draws a chunk's edges, takes from the blocks of positions as they come by what
    these need, and gives out sums for the rows of one block."""
    spark = pos.sparkSession
    rows = max(1, min(ROWS, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    last = -(-n // rows) - 1

    def pack_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0]], **{c: [pdf[c].to_numpy().tobytes()] for c in "ijp"}})

    def pack_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"other": [pdf["other"].iloc[0]], "x": [pdf.sort_values("at")[["u1", "u2"]].to_numpy(float).tobytes()]})

    dealt = edges.withColumn("block", F.expr(f"i div {rows}"))
    # Blocks without edges have a chunk too, so that they go on to the next epoch.
    many = dealt.groupBy("block").agg(F.ceil(F.count("*") / EDGES).alias("parts"))
    numbers = spark.range(last + 1).withColumnRenamed("id", "block")
    packed = dealt.join(many, "block").withColumn("part", F.pmod(F.xxhash64("j"), F.col("parts"))).select("block", "part", "i", "j", "p").groupBy("block", "part").applyInPandas(pack_edges, "block long, part long, i binary, j binary, p binary")
    none = F.lit(b"")
    packed = scratch.settle(packed.unionByName(numbers.join(many, "block", "left_anti").select("block", F.lit(0).cast("long").alias("part"), *(none.alias(c) for c in "ijp"))))
    # A chunk's edges come once, beside the first block, and then all blocks without them.
    light = F.explode(F.array(F.lit(False), F.lit(True))).alias("light")
    held = packed.repartitionByRange(packed.count(), "block", "part").select("block", "part", light, "i", "j", "p")
    held = held.select("block", "part", "light", *(F.when(~F.col("light"), F.col(c)).alias(c) for c in "ijp")).persist(StorageLevel.MEMORY_AND_DISK)
    now = scratch.settle(pos.withColumn("other", F.expr(f"at div {rows}")).groupBy("other").applyInPandas(pack_rows, "other long, x binary"))

    def met(epoch: int):
        def run(batches):
            chunk = None
            for batch in batches:
                for row in range(batch.num_rows):
                    get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
                    block = batch.column("block")[row].as_py()
                    if not batch.column("light")[row].as_py():
                        chunk = _Chunk(block, get("i", np.int64), get("j", np.int64), get("p", float), n, rows, negatives, seed, epoch)
                    elif chunk.meet(batch.column("other")[row].as_py(), get("x", float).reshape(-1, 2)):
                        one = {"other": [block], "part": [batch.column("part")[row].as_py()], "x": [chunk.x.tobytes()], "sums": [chunk.sums(a, b).tobytes()]}
                        yield pa.RecordBatch.from_pydict(one, pa.schema([("other", pa.int64()), ("part", pa.int64()), ("x", pa.binary()), ("sums", pa.binary())]))

        return run

    def merged(rate: float):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            sums = sum(np.frombuffer(f).reshape(-1, 3) for f in pdf.sort_values("part")["sums"])
            return pd.DataFrame({"other": [pdf["other"].iloc[0]], "x": [_moved(np.frombuffer(pdf["x"].iloc[0]).reshape(-1, 2), sums, rate).tobytes()]})

        return run

    try:
        for epoch in range(epochs):
            every = now.coalesce(1).hint("shuffle_replicate_nl")
            pairs = held.join(every, F.col("light") | (F.col("other") == 0)).withColumn("x", F.when(F.col("light"), F.col("x")))
            found = pairs.mapInArrow(met(epoch), "other long, part long, x binary, sums binary")
            steps[epoch % 2].drop()  # positions before the last ones
            now = steps[epoch % 2].settle(found.groupBy("other").applyInPandas(merged(1 - epoch / epochs), "other long, x binary"))
    finally:
        held.unpersist()

    def unpacked(batches):
        for pdf in batches:
            for block, x in zip(pdf["other"], pdf["x"], strict=True):
                x = np.frombuffer(x).reshape(-1, 2)
                yield pd.DataFrame({"at": block * rows + np.arange(len(x)), "u1": x[:, 0], "u2": x[:, 1]})

    return pos.select("id", "at").join(now.mapInPandas(unpacked, "at long, u1 double, u2 double"), "at").select("id", "u1", "u2")


def layout(graph: DataFrame, start: DataFrame, epochs: int | None = None, min_dist: float = 0.1, negatives: int = 5, seed: int = 42, one_task: int = ONE_TASK) -> DataFrame:
    """(id, u1, u2): a layout of a weighted graph (i, j, w), beginning at start (id, u1, u2).

    In an epoch an edge is drawn as often as its weight tells; drawn edges pull their ends together and push each from
    some random rows. A row moves by its forces of an epoch over the number of its drawn edges; all that is random hangs on
    places in the order of ids and the epoch alone. epochs: unless given, 500 up to 10,000 rows and 200 beyond, as umap-learn
    has them. Up to `one_task` rows and directed edges are laid out by one task, more in blocks, with the same result.
    """
    a, b = curve(min_dist)
    with Scratch(start.sparkSession) as scratch, Scratch(start.sparkSession) as even, Scratch(start.sparkSession) as odd:
        pos = scratch.settle(numbered(start, ["id"], name="at", scratch=scratch).select("id", "at", "u1", "u2"))
        n = pos.count()
        place = lambda c: pos.select(F.col("id").alias(c), F.col("at").alias(f"{c}_at"))
        pairs = scratch.settle(graph.select("i", "j", "w").join(place("i"), "i").join(place("j"), "j").select("i_at", "j_at", "w"))
        top, m = pairs.agg(F.max("w"), F.count("*")).first()
        if top is None or n < 2:
            return settle(pos.select("id", "u1", "u2"))
        p = (F.col("w") / top).alias("p")
        one, two = F.col("i_at"), F.col("j_at")
        edges = pairs.select(one.alias("i"), two.alias("j"), p).unionAll(pairs.select(two.alias("i"), one.alias("j"), p))
        epochs = epochs if epochs is not None else 500 if n <= 10_000 else 200
        if n + 2 * m <= one_task:
            return settle(_in_one_task(pos, edges, epochs, negatives, seed, a, b))
        return settle(_in_blocks(pos, edges, n, epochs, negatives, seed, a, b, scratch, [even, odd]))
