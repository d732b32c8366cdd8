"""Archetypal analysis of points in the space of a few components, and measures against the archetypes."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import both, pearson_p
from .lineage import Scratch, settle
from .ordinals import numbered
from .similarity import moments


def analyse(x: np.ndarray, k: int = 4, steps: int = 500, restarts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(archetypes, mixture) of rows of x by Frank-Wolfe steps on both simplices, the best of some restarts. Columns
    are scaled, not centred; archetypes come back in the original scale."""
    s = x.std(axis=0)
    s = np.where(s > 0, s, 1.0)
    z, n = x / s, len(x)
    best = None
    for seed in range(restarts):
        rng = np.random.default_rng(seed)
        chosen = [int(rng.integers(n))]
        while len(chosen) < k:
            d = np.min([((z - z[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
            chosen.append(int(rng.choice(n, p=d / d.sum())) if d.sum() > 0 else int(rng.integers(n)))
        c = np.zeros((k, n))
        c[np.arange(k), chosen] = 1.0
        m = np.full((n, k), 1.0 / k)
        for t in range(steps):
            a = c @ z
            g = (m @ a - z) @ a.T
            step = 2 / (t + 2)
            m *= 1 - step
            m[np.arange(n), g.argmin(axis=1)] += step
            g = m.T @ (m @ (c @ z) - z) @ z.T
            c *= 1 - step
            c[np.arange(k), g.argmin(axis=1)] += step
        error = float(((z - m @ (c @ z)) ** 2).mean())
        if best is None or error < best[0]:
            best = (error, c @ x, m.copy())
    return best[1], best[2]


BLOCK = 8_192
#: Rows that one task analyses on its own, as numbers of a few components: some MB.
ONE_TASK = 50_000
#: Blocks that one task of a pass holds where they are many: some 60 MB.
HELD = 64
#: Steps after which mixtures are kept, so that a pass replays no more than these.
EVERY = 8
#: Steps after which they are written, so that what an executor has lost is computed again from there.
WRITTEN = 100
PACKED = "block long, z binary, m binary, ids binary"


def _replayed(z: np.ndarray, m: np.ndarray, tips: list[np.ndarray], t: int) -> np.ndarray:
    """Mixtures (restart, row, k) after the steps that begin at t, towards each of `tips` (restart, k, column) in turn."""
    rows = np.arange(len(z))
    for a in tips:
        for r in range(len(m)):
            g = (m[r] @ a[r] - z) @ a[r].T
            m[r] *= 1 - 2 / (t + 2)
            m[r][rows, g.argmin(axis=1)] += 2 / (t + 2)
        t += 1
    return m


class Blocks:
    """Rows of a table as packed blocks (block, z, m, ids): scaled coordinates, and mixtures as they were at step `at`. They stay
    with the executors, on disk where memory is short, dealt evenly over tasks."""

    def __init__(self, table: DataFrame, columns: int, restarts: int, k: int, tasks: int):
        self.columns, self.restarts, self.k, self.tasks, self.at, self.written = columns, restarts, k, tasks, 0, 0
        self.spark, self.held = table.sparkSession, []
        self.packed = self._dealt(table)

    def _dealt(self, table: DataFrame) -> RDD:
        rows = table.rdd.map(lambda r: (r["block"], (r["block"], r["z"], r["m"], r["ids"])))
        return self._kept(rows.partitionBy(self.tasks, lambda block: block).values())

    def _kept(self, packed: RDD) -> RDD:
        """Kept from the next pass on; the one before it stays until then."""
        self.held.append(packed.persist(StorageLevel.MEMORY_AND_DISK))
        while len(self.held) > 2:
            self.held.pop(0).unpersist()
        return packed

    def drop(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def each(self, fn, packed: RDD | None = None) -> RDD:
        """fn(block, z, m, ids) of every block."""
        columns, restarts, k = self.columns, self.restarts, self.k

        def run(found):
            block, z, m, ids = found
            z = np.frombuffer(z).reshape(-1, columns)
            m = np.full((restarts, len(z), k), 1 / k) if m is None else np.frombuffer(m).reshape(restarts, len(z), k).copy()
            return fn(block, z, m, ids)

        return (self.packed if packed is None else packed).map(run)

    def gradients(self, tips: list[np.ndarray], last: np.ndarray | None) -> tuple[np.ndarray, list]:
        """After the steps towards `tips` from `at` on: the sum over rows of m' (m a - z), a being the last of tips; and of
        each restart and archetype the row with the least product with `last`, as (product, ord, row)."""
        at, every = self.at, self.restarts * self.k

        def fn(block, z, m, ids):
            m = _replayed(z, m, tips, at)
            g = np.stack([w.T @ (w @ a - z) for w, a in zip(m, tips[-1], strict=True)])
            if last is None:
                return g, None
            v = z @ last.reshape(every, -1).T
            i = v.argmin(axis=0)
            return g, (v[i, np.arange(every)], block * BLOCK + i, z[i])

        # A task's blocks are merged before anything leaves it.
        def merged(found):
            g, best = 0.0, None
            for more, row in found:
                g = g + more
                best = row if best is None else _least(best, row)
            if best is not None or not np.isscalar(g):
                yield g, best

        g, best = np.zeros((self.restarts, self.k, self.columns)), None
        for more, row in self.each(fn).mapPartitions(merged).collect():  # one row a task
            g = g + more
            best = row if best is None else _least(best, row)
        return g, best

    def advanced(self, tips: list[np.ndarray], keep) -> None:
        """Keeps the mixtures after the steps towards `tips`; `keep` writes a table of them now and then."""
        at = self.at
        self.packed = self._kept(self.each(lambda block, z, m, ids: (block, z.tobytes(), _replayed(z, m, tips, at).tobytes(), ids)))
        self.at = at + len(tips)
        if self.at - self.written >= WRITTEN:
            self.packed, self.written = self._dealt(keep(self.spark.createDataFrame(self.packed, PACKED))), self.at


def _least(one: tuple, two: tuple) -> tuple:
    """The rows (product, ord, row) with the smaller products, of equals those that come first."""
    less = (two[0] < one[0]) | ((two[0] == one[0]) & (two[1] < one[1]))
    return np.where(less, two[0], one[0]), np.where(less, two[1], one[1]), np.where(less[:, None], two[2], one[2])


def _chosen(blocks: Blocks, n: int, seeds: list[np.random.Generator]) -> np.ndarray:
    """Rows (restart, k, column) to begin with: the first at random, each other by its squared distance to those chosen.
    Two passes for each: sums of distances by block, of which a block and a place in it follow, and the row there."""
    first = [int(g.integers(n)) for g in seeds]
    got = _rows_at(blocks, {(r, i // BLOCK): i % BLOCK for r, i in enumerate(first)})
    chosen = [[got[r]] for r in range(len(seeds))]
    for _ in range(blocks.k - 1):
        now = np.array(chosen)

        def sums(block, z, m, ids, now=now):
            return block, [float(_distances(z, c).sum()) for c in now]

        by_block = sorted(blocks.each(sums).collect())  # one row a block of 8,192
        places, at_random = {}, {}
        for r, g in enumerate(seeds):
            parts = np.array([s[r] for _, s in by_block])
            if parts.sum() > 0:
                upto = np.cumsum(parts)
                goal = g.random() * upto[-1]
                k = min(int(np.searchsorted(upto, goal, side="right")), len(parts) - 1)
                places[r, by_block[k][0]] = goal - (upto[k] - parts[k])
            else:
                i = int(g.integers(n))
                at_random[r, i // BLOCK] = i % BLOCK
        got = _rows_at(blocks, at_random) | _rows_at(blocks, places, now)
        for r in range(len(seeds)):
            chosen[r].append(got[r])
    return np.array(chosen)


def _distances(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return np.min([((z - c) ** 2).sum(axis=1) for c in chosen], axis=0)


def _rows_at(blocks: Blocks, places: dict, chosen: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Rows by restart: places (restart, block) give an index, or, with `chosen`, how much of the block's distances to
    them lies before the row."""
    if not places:
        return {}

    def fn(block, z, m, ids):
        found = []
        for (r, b), place in places.items():
            if b == block:
                i = int(place) if chosen is None else min(int(np.searchsorted(np.cumsum(_distances(z, chosen[r])), place, side="right")), len(z) - 1)
                found.append((r, z[i]))
        return found

    wanted = {b for _, b in places}
    return dict(blocks.each(fn, blocks.packed.filter(lambda found: found[0] in wanted)).flatMap(lambda found: found).collect())


def _packed(coords: DataFrame, columns: list[str], scale: np.ndarray, scratch: Scratch) -> DataFrame:
    """Blocks of rows in the order of their ids."""
    dealt = numbered(coords, ["id"], scratch=scratch)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        return pd.DataFrame({"block": [int(pdf["ord"].iloc[0]) // BLOCK], "z": [(pdf[columns].to_numpy(float) / scale).tobytes()], "m": [None], "ids": [pickle.dumps(pdf["id"].to_numpy())]})

    return scratch.settle(dealt.groupBy(F.expr(f"ord div {BLOCK}")).applyInPandas(pack, PACKED))


def fit(blocks: Blocks, n: int, scratch: Scratch, steps: int, restarts: int) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """(best restart, its archetypes, the steps since the blocks' mixtures were written), by one pass a step.

    A step moves mixtures towards their best archetype, which each row does alone, and each archetype towards the row with the
    least product with its gradient. Which row that is needs a pass of its own after the gradient's, but is nearly
    always one that has won before; so the next step is taken with the best of those, the pass that it needs anyway tells
    whether any row is better, and only then it is taken again. Results are the same as without guessing.
    """
    tips = _chosen(blocks, n, [np.random.default_rng(seed) for seed in range(restarts)])
    every, columns = restarts * blocks.k, blocks.columns
    pool = {}
    since: list[np.ndarray] = []
    pending = None  # gradients whose best rows are still guessed, and the archetypes before that step
    t = 0
    while True:
        g, best = blocks.gradients([*since, tips], pending[0] if pending else None)
        if pending:
            right = {int(o): x for o, x in zip(best[1], best[2].reshape(every, columns), strict=True)}
            true = _moved(pending[1], best[2].reshape(pending[1].shape), t - 1)
            pool |= right
            if not np.array_equal(true, tips):
                tips, pending = true, None
                g, _ = blocks.gradients([*since, tips], None)
        if t == steps - 1:
            break
        since.append(tips)
        if len(since) == EVERY:
            blocks.advanced(since, scratch.settle)
            since = []
        if not pool:
            for a in tips.reshape(every, columns):
                pool[-1 - len(pool)] = a
        rows = np.array(list(pool.values()))
        orders = np.array(list(pool))
        v = g.reshape(every, columns) @ rows.T
        picked = [min(np.flatnonzero(w == w.min()), key=lambda i: orders[i]) for w in v]
        pending = (g, tips)
        tips = _moved(tips, rows[picked].reshape(tips.shape), t)
        t += 1
    # The last gradient's rows, and the errors with the archetypes that they give.
    _, best = blocks.gradients([*since, tips], g)
    final = _moved(tips, best[2].reshape(tips.shape), t)
    since.append(tips)
    at = blocks.at

    def errors(block, z, m, ids):
        m = _replayed(z, m, since, at)
        return np.array([((z - w @ a) ** 2).sum() for w, a in zip(m, final, strict=True)])

    total = np.sum(blocks.each(errors).collect(), axis=0)  # one row a block
    return int(total.argmin()), final, since


def _moved(tips: np.ndarray, rows: np.ndarray, t: int) -> np.ndarray:
    step = 2 / (t + 2)
    return (1 - step) * tips + step * rows


def archetypes(coords: DataFrame, columns: list[str], k: int = 4, steps: int = 500, restarts: int = 3, one_task: int = ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """(k, columns) and (id, k, w), as `analyse` gives them for the rows in the order of their ids.

    Up to `one_task` rows are analysed by one task. More stay in blocks that tasks work on, `steps` passes in all:
    mixtures never leave them, and what reaches the driver are k x columns numbers a task, or a few a block. No rows give none; rows with a
    null coordinate take no part.
    """
    spark = coords.sparkSession
    kind = coords.schema["id"].dataType.simpleString()
    schema, mixed = "k int, " + ", ".join(f"`{c}` double" for c in columns), f"id {kind}, k int, w double"
    rows = coords.select("id", *(F.col(c).cast("double").alias(c) for c in columns)).where(" and ".join(f"`{c}` is not null" for c in columns))
    with Scratch(spark) as scratch:
        rows = scratch.settle(rows)
        n, _, cov = moments(rows.select(F.array(*columns).alias("v")))
        if n <= one_task:
            return _in_one_task(rows, columns, k, steps, restarts, schema, mixed)
        s = np.sqrt(np.diag(cov))
        s = np.where(s > 0, s, 1.0)
        count = -(-n // BLOCK)
        tasks = min(count, max(spark.sparkContext.defaultParallelism, -(-count // HELD)))
        blocks = Blocks(_packed(rows, columns, s, scratch), len(columns), restarts, k, tasks)
        try:
            best, tips, since = fit(blocks, n, scratch, steps, restarts)
            at = blocks.at
            ended = blocks.each(lambda block, z, m, ids: (block, b"", _replayed(z, m, since, at)[best].tobytes(), ids))

            def mixture(batches):
                for pdf in batches:
                    for m, ids in zip(pdf["m"], pdf["ids"], strict=True):
                        ids = pickle.loads(ids)
                        yield pd.DataFrame({"id": np.repeat(ids, k), "k": np.tile(np.arange(k), len(ids)), "w": np.frombuffer(m)})

            out = spark.createDataFrame([(i, *map(float, a * s)) for i, a in enumerate(tips[best])], schema)
            return out, settle(spark.createDataFrame(ended, PACKED).mapInPandas(mixture, mixed))
        finally:
            blocks.drop()


def _in_one_task(rows: DataFrame, columns: list[str], k: int, steps: int, restarts: int, schema: str, mixed: str) -> tuple[DataFrame, DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        z, m = analyse(pdf[columns].to_numpy(float), k, steps, restarts)
        tips = pd.DataFrame(z, columns=columns).assign(id=pdf["id"].iloc[0], k=range(k), w=-1.0)
        shares = pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), k), "k": np.tile(np.arange(k), len(pdf)), "w": m.ravel(), **{c: 0.0 for c in columns}})
        return pd.concat([tips, shares])[["id", "k", "w", *columns]]

    both = settle(rows.groupBy().applyInPandas(run, mixed + ", " + schema.split(", ", 1)[1]))
    return both.where("w < 0").select("k", *columns), both.where("w >= 0").select("id", "k", "w")


def contract(tips: DataFrame, columns: list[str], by: float = -0.15) -> DataFrame:
    """Archetypes moved from their centroid by 1 + by; mixture weights belong to the original ones."""
    mean = tips.agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    return tips.crossJoin(F.broadcast(mean)).select("k", *((F.col(f"_{c}") + (1 + by) * (F.col(c) - F.col(f"_{c}"))).alias(c) for c in columns))


def inside_tetrahedron(point: list[Column], corners: list[list[Column]], slack: float = 1e-9) -> Column:
    """Whether a point lies in a tetrahedron, by Cramer's rule; a flat one holds nothing."""

    def det(a, b, c):
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1]) + c[0] * (a[1] * b[2] - a[2] * b[1])

    sub = lambda p, q: [i - j for i, j in zip(p, q, strict=True)]
    a, b, c, p = (sub(v, corners[0]) for v in (*corners[1:], point))
    d = det(a, b, c)
    w = [det(p, b, c) / d, det(a, p, c) / d, det(a, b, p) / d]
    return F.coalesce(F.when(d != 0, (w[0] >= -slack) & (w[1] >= -slack) & (w[2] >= -slack) & (1 - w[0] - w[1] - w[2] >= -slack)), F.lit(False))


def edge_walk(coords: DataFrame, tips: DataFrame, columns: list[str]) -> DataFrame:
    """(id, i, j, t): where each point falls along each edge between archetypes; edges of no length give none."""
    one = tips.select(F.col("k").alias("i"), *(F.col(c).alias(f"a_{c}") for c in columns))
    two = tips.select(F.col("k").alias("j"), *(F.col(c).alias(f"b_{c}") for c in columns))
    along = F.broadcast(one.join(two, F.col("i") < F.col("j")))
    d = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in columns]
    size = sum((x * x for x in d), F.lit(0.0))
    t = sum(((F.col(c) - F.col(f"a_{c}")) * x for c, x in zip(columns, d, strict=True)), F.lit(0.0)) / size
    return coords.crossJoin(along).where(size > 1e-12).select("id", "i", "j", t.alias("t"))


def correlate(pairs: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, r, p) over pairs that are neither null nor NaN; fewer than three, or a constant, give no r."""
    ok = pairs.where(both(F.col(x), F.col(y)))
    g = (ok.groupBy(*keys) if keys else ok.groupBy()).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    g = g.withColumn("r", F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r")))
    return g.withColumn("p", F.when(F.col("r").isNotNull(), pearson_p("r", F.col("n").cast("double"))))
