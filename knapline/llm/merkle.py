"""Merkle dataset manifest: a tree of digests over all rows of a table, with a proof for each row.

Rows are leaves. Those of one key, in their order, are folded eight by eight until one digest, the key's subroot, is
left; the subroots in the order of their keys are folded likewise into the root. Blocks of 4,096 neighbouring nodes lie
at multiples of 4,096, so that each is a whole subtree: a task walks it in postorder, and the blocks' roots are the nodes of
the next pass, over 4,096 times fewer rows. Proofs come on the way back: a block meets the path of its own root and, while
the recursion unwinds, every node in it is given its siblings. Neither the leaves nor the digests of a level meet in one
task, and nothing but the largest number of nodes of a key reaches the driver.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import numbered
from .common import Scratch, settle

FAN = 8
LEVELS = 4
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record(columns: list[Column]) -> Column:
    """The digest of a row: each value as its number of bytes, a colon and its bytes, `-` if null."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown)), 256)


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def walk(nodes: list[str], lo: int, level: int, paths: list[list[str]] | None = None) -> str:
    """The digest of the subtree of `level` levels that begins at nodes[lo]. Each node in it has what stands before and
    after it appended to its path, level by level from below."""
    if level == 0:
        return nodes[lo]
    width = FAN ** (level - 1)
    starts = range(lo, min(lo + FAN * width, len(nodes)), width)
    children = nodes[lo : lo + FAN] if level == 1 else [walk(nodes, s, level - 1, paths) for s in starts]
    if paths is not None:
        for i, s in enumerate(starts):
            beside = ("".join(children[:i]), "".join(children[i + 1 :]))
            for leaf in range(s, min(s + width, len(nodes))):
                paths[leaf] += beside
    return digest_of(children)


def follow(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for k in range(0, len(path), 2):
        leaf = digest_of((path[k], leaf, path[k + 1]))
    return leaf


def _in_order(block: pa.Table) -> tuple[pa.Table, int]:
    """A block's nodes by place, and the levels that are folded in it."""
    return block.sort_by("pos"), min(LEVELS, height(block.column("n")[0].as_py()))


def _roots(nodes: DataFrame) -> DataFrame:
    """One node for each block of nodes (key, pos, n, digest)."""

    def fold(block: pa.Table) -> pa.Table:
        block, levels = _in_order(block)
        root = walk(block.column("digest").to_pylist(), 0, levels)
        n = -(-block.column("n")[0].as_py() // BLOCK)
        return pa.table({"key": [block.column("key")[0].as_py()], "pos": [block.column("pos")[0].as_py() // BLOCK], "n": pa.array([n], pa.int64()), "digest": [root]})

    thin = nodes.select("key", "pos", "n", "digest", F.expr(f"pos div {BLOCK}").alias("block"))
    return thin.groupBy("key", "block").applyInArrow(fold, "key string, pos long, n long, digest string")


def _passes(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The nodes of each pass, down to one a key."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(scratch.settle(_roots(out[-1])))
    return out


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(key, pos, path, subroot, root) of nodes, from the same of their blocks' roots."""

    def unwind(block: pa.Table, top: pa.Table) -> pa.Table:
        block, levels = _in_order(block)
        paths = [[] for _ in range(block.num_rows)]
        walk(block.column("digest").to_pylist(), 0, levels, paths)
        (path, subroot, root), n = (top.column(c)[0].as_py() for c in ("path", "subroot", "root")), block.num_rows
        return pa.table({"key": block.column("key"), "pos": block.column("pos"), "path": pa.array([p + path for p in paths], pa.list_(pa.string())), "subroot": pa.array([subroot] * n, pa.string()), "root": [root] * n})

    thin = nodes.select("key", "pos", "n", "digest", F.expr(f"pos div {BLOCK}").alias("block"))
    return thin.groupBy("key", "block").cogroup(above.groupBy("key", "pos")).applyInArrow(unwind, "key string, pos long, path array<string>, subroot string, root string")


def _proofs(leaves: DataFrame, above: DataFrame, named: str) -> DataFrame:
    """The manifest's rows."""

    def unwind(block: pa.Table, top: pa.Table) -> pa.Table:
        block, levels = _in_order(block)
        nodes = block.column("digest").to_pylist()
        paths = [[] for _ in nodes]
        walk(nodes, 0, levels, paths)
        path, subroot, root = (top.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        paths = [p + path for p in paths]
        folded = [follow(c, p) for c, p in zip(block.column("claimed").to_pylist(), paths, strict=True)]
        n = len(nodes)
        return pa.table({named: block.column("id"), "leaf": block.column("digest"), "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": [digest_of(p) for p in paths], "folded_root": folded, "verified": [f == root for f in folded]})

    kind = leaves.schema["id"].dataType.simpleString()
    cut = leaves.withColumn("block", F.expr(f"pos div {BLOCK}"))
    schema = f"`{named}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return cut.groupBy("key", "block").cogroup(above.groupBy("key", "pos")).applyInArrow(unwind, schema)


def manifest(docs: DataFrame, claims: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, key: str = "lang", order: str = "doc_id") -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of docs.

    `claims` gives fields as somebody claims them to be; folded_root is what the row so claimed leads to by the siblings of
    the true one, and verified whether that is the root. Without claims each row verifies. Rows of a key ascend by `order`,
    nulls first, rows with equal `order` by their digests; a null key comes before all others and is one key. Equal rows
    are leaves of their own side by side. An empty table gives no rows; a single row is its own subroot, a single subroot
    is the root. Other columns are not read.
    """
    spark = docs.sparkSession
    told = [(claims or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(F.concat(F.lit("="), F.col(key).cast("string")).alias("key"), F.col(order).alias("id"), record([F.col(f) for f in fields]).alias("digest"), record(told).alias("claimed"))
    with Scratch(spark) as scratch:
        leaves = scratch.settle(leaves.withColumn("key", F.coalesce("key", F.lit(""))))
        leaves = scratch.settle(numbered(leaves, ["id", "digest"], ["key"], name="pos", total="n", scratch=scratch))
        passes = _passes(leaves, scratch)
        tops = scratch.settle(numbered(passes[-1].select(F.col("key").alias("name"), "digest"), ["name"], name="pos", total="n", scratch=scratch).withColumn("key", F.lit("")))
        over = _passes(tops, scratch)
        above = over[-1].select("key", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
        for nodes in reversed(over[:-1]):
            above = scratch.settle(_paths(nodes, above))
        above = above.join(tops.select("pos", "name", "digest"), "pos").select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
        for nodes in reversed(passes[1:-1]):
            above = scratch.settle(_paths(nodes, above))
        if len(passes) == 1:  # every key has one row: its leaf is the subroot
            above = scratch.settle(above)
        return settle(_proofs(leaves, above, order))
