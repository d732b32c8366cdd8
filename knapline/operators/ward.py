"""Ward clustering by rounds: all clusters that are each other's nearest merge at once.

Merging two clusters brings neither nearer to a third than the nearer of them was, so that such pairs are merges of the
usual one-at-a-time clustering too, and a cluster has to look for its nearest again only if that has been merged.
Clusters are rows with their centroid; a search compares blocks of them, which meet in a product of partitions. The tree is a table of merges, and the place
of each leaf follows from it by pointer jumping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .geometry import shuffled
from .lineage import Scratch, settle

#: Clusters that one task merges on its own: a matrix of their distances takes some 200 MB.
FINISH = 5_000
BLOCK = 2_048
FIRST = 32  # others of a block that are compared before the next ones, and those before the rest
CHECKED = 50_000  # pairs measured at a time
TILE = 128  # rows of a product that stay in a processor's cache until they are screened


def cost(si, sj, square):
    """What joining two clusters adds to the sum of squares, twice."""
    return 2 * si * sj / (si + sj) * square


def merges_of(slots: list, sizes: np.ndarray, x: np.ndarray) -> list[tuple]:
    """(slot, size, other, other_size) of all merges in their order, of clusters in the order of their slots. Of equal
    pairs the first merges; a union has the smaller slot."""
    n = len(slots)
    g = (x * x).sum(axis=1)
    size = sizes.astype(float)
    d = x @ x.T
    for lo in range(0, n, 256):
        part = slice(lo, lo + 256)
        d[part] = cost(size[part, None], size[None, :], np.maximum(g[part, None] + g[None, :] - 2 * d[part], 0))
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1)
    least = d[np.arange(n), near]
    out = []
    for _ in range(n - 1):
        i = int(least.argmin())
        i, j = sorted((i, int(near[i])))
        si, sj = size[i], size[j]
        live = np.isfinite(d[i]) | np.isfinite(d[j])
        new = ((si + size) * d[i] + (sj + size) * d[j] - size * d[i, j]) / (si + sj + size)
        new[~live | (np.arange(n) == i) | (np.arange(n) == j)] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] = si + sj
        less = (new < least) | ((new == least) & (i < near))
        near[less], least[less] = i, new[less]
        least[j] = np.inf
        lost = np.flatnonzero(np.isfinite(least) & ~less & ((near == i) | (near == j)))
        for k in {i, *lost.tolist()}:
            near[k] = d[k].argmin()
            least[k] = d[k, near[k]]
        out.append((slots[i], int(si), slots[j], int(sj)))
    return out


def _nearest(a, si, q, b, sj, p) -> tuple:
    """(row, near, d): of each seeking cluster (slots a, sizes si, centroids q) the one among others (b in rising order, sj, p)
    that costs least, ties to the smaller slot. Products screen, what their rounding leaves open is measured by differences."""
    gq, gp = (q * q).sum(axis=1), (p * p).sum(axis=1)
    factor = cost(si[:, None], sj[None, :], 1.0)
    d = factor * (gq[:, None] + gp[None, :] - 2 * q @ p.T)
    slack = factor * (1e-15 * (q.shape[1] + 8) * (gq[:, None] + gp[None, :]))
    own = a[:, None] == b[None, :]
    d[own] = np.inf
    row, col = np.nonzero((d - slack <= (d + slack).min(axis=1)[:, None]) & ~own)
    exact = factor[row, col] * ((q[row] - p[col]) ** 2).sum(axis=1)
    order = np.lexsort((b[col], exact, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return row[first], b[col[first]], exact[first]


def _true(mask: np.ndarray) -> np.ndarray:
    """Where a contiguous mask is true, nearly nowhere: eight places are looked at together."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    one, place = np.nonzero(flat.reshape(-1, 8)[some])
    return some[one] * 8 + place


def _closer(a, si, q, d, b, sj, p) -> tuple:
    """(row, near, d): as _nearest, of the clusters that may have one among the others that costs no more than d, a finite number, does.

    2 si sj / (si + sj) |q - p|^2 <= d says that |q - p|^2 - d / 2 si - d / 2 sj <= 0, whose left side is a product of rows that
    are known before. Products in single precision screen, as far as their rounding can tell; what they leave is measured by differences."""
    gq, gp = (q * q).sum(axis=1), (p * p).sum(axis=1)
    own, other = gq + d / (2 * si), gp.max() + d / (2 * sj.min())
    single = np.float32 if max(own.max(), other.max()) < 1e30 else np.float64
    slack = 1.2e-7 * (q.shape[1] + 12) * (own + other) + 1e-36
    left = np.column_stack([-2 * q, gq - d / (2 * si) - slack, np.ones(len(q)), -d]).astype(single)
    right = np.column_stack([p, np.ones(len(p)), gp, 1 / (2 * sj)]).astype(single)
    found = [_true(left[lo : lo + TILE] @ right.T <= 0) + lo * len(p) for lo in range(0, len(q), TILE)]
    row, col = np.divmod(np.concatenate(found), len(p))
    some = a[row] != b[col]
    row, col = row[some], col[some]
    square = np.empty(len(row))
    for lo in range(0, len(row), CHECKED):
        part = slice(lo, lo + CHECKED)
        square[part] = ((q[row[part]] - p[col[part]]) ** 2).sum(axis=1)
    exact = cost(si[row], sj[col], 1.0) * square
    order = np.lexsort((b[col], exact, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return row[first], b[col[first]], exact[first]


def _least(batches):
    """Of rows (a block of seeking clusters, a block of others), as _meetings gives them, the best that a task has met for each
    seeking cluster."""
    best: dict = {}
    others: dict = {}
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row]  # noqa: B023, E731
            side = lambda n, ids, x, size: (get(ids).values.to_numpy(zero_copy_only=False), np.frombuffer(get(size).as_buffer()), blocks.matrix(get(x), get(n).as_py()))
            if not get("again").as_py():
                a, si, q = side("n", "ids", "x", "size")
                continue
            other = get("ob").as_py()
            if get("ox").is_valid:
                others[other] = side("on", "oids", "ox", "osize")
            b, sj, p = others[other]
            _, slots, far = best.setdefault(get("b").as_py(), (a, np.full(len(a), a[0]), np.full(len(a), np.inf)))

            def better(rows, at, near, d, slots=slots, far=far):
                at = rows[at]
                less = (d < far[at]) | ((d == far[at]) & np.isfinite(d) & (near < slots[at]))
                slots[at[less]], far[at[less]] = near[less], d[less]

            # A bound from few others leaves few of the next ones to be measured.
            for lo, hi in ((0, FIRST), (FIRST, 16 * FIRST), (16 * FIRST, len(b))):
                if lo >= len(b):
                    break
                if len(new := np.flatnonzero(np.isinf(far))):
                    better(new, *_nearest(a[new], si[new], q[new], b[lo:hi], sj[lo:hi], p[lo:hi]))
                if len(bound := np.flatnonzero(np.isfinite(far))):
                    better(bound, *_closer(a[bound], si[bound], q[bound], far[bound], b[lo:hi], sj[lo:hi], p[lo:hi]))
    for a, slots, far in best.values():
        found = np.isfinite(far)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"slot": a[found], "near": slots[found], "d": far[found]}), preserve_index=False)


def _packed(clusters: DataFrame, kind: str) -> DataFrame:
    """(b, n, ids, x, size): rows packed into blocks where they lie; b only tells blocks apart."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.sort_values(["size", "slot"])
            for lo in range(0, len(pdf), BLOCK):
                part = pdf.iloc[lo : lo + BLOCK]
                first = str(part["slot"].iloc[0])
                yield pd.DataFrame({"b": [first], "n": [len(part)], "ids": [part["slot"].tolist()], "x": [np.stack(part["c"]).astype(float).tobytes()], "size": [part["size"].to_numpy(float).tobytes()]})

    return clusters.select("slot", "size", "c").mapInPandas(run, f"b string, n int, ids array<{kind}>, x binary, size binary")


def _meetings(left: DataFrame, right: DataFrame, n: tuple[int, int]) -> DataFrame:
    """Every block of left beside every block of right, which meet in a product of partitions. A task gets each block's contents
    once: those of a left one in a row of their own (not again) before its meetings, those of right ones with the first left one."""
    first = F.expr("monotonically_increasing_id() & 8589934591 = 0")  # of what a task reads
    mine, theirs = ["n", "ids", "x", "size"], ["on", "oids", "ox", "osize"]
    spread = right.toDF("ob", *theirs).repartition(blocks.parts(n[1])).withColumn("lead", first)
    dealt = left.repartition(blocks.parts(n[0])).withColumn("ahead", first).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("again"))
    pairs = dealt.join(spread.hint("shuffle_replicate_nl"), F.col("again") | F.col("lead"))
    return pairs.select("b", "again", "ob", *(F.when(~F.col("again"), F.col(c)).alias(c) for c in mine), *(F.when(F.col("again") & F.col("ahead"), F.col(c)).alias(c) for c in theirs))


def _search(seeking: DataFrame, clusters: DataFrame, n: tuple[int, int], kind: str, keep) -> DataFrame:
    """(slot, near, d) of the seeking clusters among all."""
    many = tuple(max(1, -(-k // BLOCK)) for k in n)
    found = _meetings(_packed(seeking, kind), _packed(clusters, kind), many).mapInArrow(_least, f"slot {kind}, near {kind}, d double")
    best = found.groupBy("slot").agg(F.min(F.struct("d", "near")).alias("m"))
    return keep(best.select("slot", F.col("m.near").alias("near"), F.col("m.d").alias("d")))


def _finished(clusters: DataFrame, kind: str) -> DataFrame:
    """Merges of the clusters that are left, at most FINISH, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        rows = merges_of(pdf["slot"].tolist(), pdf["size"].to_numpy(), np.stack(pdf["c"]))
        return pd.DataFrame(rows, columns=["slot", "size", "other", "other_size"])

    return clusters.select("slot", "size", "c").groupBy().applyInPandas(run, f"slot {kind}, size long, other {kind}, other_size long")


def merges(v: DataFrame, finish: int = FINISH) -> DataFrame:
    """(slot, size, other, other_size): the merges of Ward clustering of vectors (id, v), a cluster going by its smallest id
    and its size. n rows give n - 1 merges."""
    kind = v.schema["id"].dataType.simpleString()
    with Scratch(v.sparkSession) as scratch:
        now = scratch.settle(v.select(F.col("id").alias("slot"), F.lit(1).cast("long").alias("size"), F.col("v").alias("c"), F.lit(None).cast(kind).alias("near"), F.lit(None).cast("double").alias("d")))
        done, n = [], now.count()
        looking = n
        while n > finish:
            found = _search(now.where("near is null"), now, (looking, n), kind, scratch.settle)
            new = found.select("slot", F.col("near").alias("new_near"), F.col("d").alias("new_d"))
            # Vectors stay behind until it is known which clusters merge.
            links = now.select("slot", "size", "near", "d").join(shuffled(new), "slot", "left").select("slot", "size", F.coalesce("near", "new_near").alias("near"), F.coalesce("d", "new_d").alias("d"))
            back = links.select(F.col("near").alias("slot"), F.col("slot").alias("near"), F.col("size").alias("other_size"))
            pairs = scratch.settle(links.join(shuffled(back), ["slot", "near"]).where("slot < near").select("slot", "size", F.col("near").alias("other"), "other_size"))
            some = pairs.count()
            if not some:  # rounding has made a circle of equal distances: the least of all goes on
                one = links.orderBy("d", "slot", "near").limit(1).select(F.least("slot", "near").alias("slot"), F.greatest("slot", "near").alias("other"))
                side = lambda a, b: now.select(F.col("slot").alias(a), F.col("size").alias(b))
                pairs = scratch.settle(one.join(side("slot", "size"), "slot").join(side("other", "other_size"), "other").select("slot", "size", "other", "other_size"))
                some = 1
            done.append(pairs)
            gone = pairs.select(F.col("slot").alias("into"), F.explode(F.array("slot", "other")).alias("slot"))
            left = links.join(shuffled(gone.select("slot")), "slot", "left_anti").join(shuffled(gone.select(F.col("slot").alias("near"), F.lit(True).alias("lost"))), "near", "left")
            left = left.select("slot", F.when(F.col("lost").isNull(), F.col("near")).alias("near"), F.when(F.col("lost").isNull(), F.col("d")).alias("d"))
            kept = now.select("slot", "size", "c").join(shuffled(left), "slot")
            merged = now.select("slot", "size", "c").join(shuffled(gone), "slot")
            low = merged.where("slot = into").select("slot", "size", "c")
            high = merged.where("slot <> into").select(F.col("into").alias("slot"), F.col("size").alias("other_size"), F.col("c").alias("other_c"))
            total = F.col("size") + F.col("other_size")
            mean = F.zip_with("c", "other_c", lambda x, y: (x * F.col("size") + y * F.col("other_size")) / total)
            # Named apart: in a lambda `size` would be the column of that name in the same select.
            grown = low.join(shuffled(high), "slot").select("slot", total.alias("grown"), mean.alias("c")).select("slot", F.col("grown").alias("size"), "c", F.lit(None).cast(kind).alias("near"), F.lit(None).cast("double").alias("d"))
            now, n = scratch.settle(kept.unionByName(grown)), n - some
            looking = now.where("near is null").count()
        out = _finished(now, kind)
        for part in done:
            out = out.unionByName(part)
        return settle(out)


def ward_order(v: DataFrame, finish: int = FINISH) -> DataFrame:
    """(pos, id): the leaves of Ward clustering of vectors (id, v) in the order of its tree; of two branches the one with the
    smaller least id stands first. Distances between equally near clusters go to smaller ids. One row is its own order,
    no rows give none. At most `finish` clusters meet in one task; nothing reaches the driver."""
    kind = v.schema["id"].dataType.simpleString()
    with Scratch(v.sparkSession) as scratch:
        tree = scratch.settle(merges(v, finish))
        total = F.col("size") + F.col("other_size")
        left = tree.select(F.col("slot").alias("s"), F.col("size").alias("n"), F.col("slot").alias("ps"), total.alias("pn"), F.lit(0).cast("long").alias("off"))
        right = tree.select(F.col("other").alias("s"), F.col("other_size").alias("n"), F.col("slot").alias("ps"), total.alias("pn"), F.col("size").alias("off"))
        nodes = scratch.settle(left.unionByName(right))
        while nodes.where("ps is not null").limit(1).count():
            up = nodes.select(F.col("s").alias("ps"), F.col("n").alias("pn"), F.col("ps").alias("qs"), F.col("pn").alias("qn"), F.col("off").alias("more"))
            jumped = nodes.join(shuffled(up), ["ps", "pn"], "left").select("s", "n", F.col("qs").alias("ps"), F.col("qn").alias("pn"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"))
            nodes = scratch.settle(jumped)
        leaves = v.select(F.col("id").cast(kind).alias("s")).join(shuffled(nodes.where("n = 1")), "s", "left")
        return settle(leaves.select(F.coalesce("off", F.lit(0)).cast("int").alias("pos"), F.col("s").alias("id")))
