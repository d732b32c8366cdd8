"""The driver's tables as this library's inputs, and the same as SQL fragments.

Meshes are height fields made of `part`: a block of 100 keys is a 10 x 10 grid, p_size its height, with two triangles
a cell. A face stands only where all its corners do. Embeddings are those given; labels stand for sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey div 100 as mesh_id", "p_partkey % 100 as vid", "cast(p_partkey % 100 % 10 as double) as x", "cast(p_partkey % 100 div 10 as double) as y", "0.1D * p_size as z")


ROWS = 20_000  # vertices a task makes faces of


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vertices a mesh has are bits of two numbers, from which its faces follow. A row here becomes many, so that the
    tasks are as many as the vertices ask for; left to the size of these rows they would be one."""
    v = vertices(spark, sf_dir).where("mesh_id is not null").select("mesh_id", F.col("vid").cast("int").alias("vid"))
    dealt = v.repartition(max(1, -(-v.count() // ROWS)), "mesh_id")
    there = dealt.groupBy("mesh_id").agg(*(F.bit_or(F.expr(f"if(vid div 50 = {k}, shiftleft(1L, vid % 50), 0L)")).alias(f"h{k}") for k in range(2)))
    cells = there.select("*", F.explode(F.sequence(F.lit(0), F.lit(161))).alias("fid"))
    f = cells.selectExpr("*", "fid div 2 div 9 * 10 + fid div 2 % 9 as o", "fid % 2 as k")
    f = f.selectExpr("mesh_id", "h0", "h1", "cast(fid as bigint) as fid", "if(k = 0, o, o + 1) as a", "if(k = 0, o + 1, o + 11) as b", "o + 10 as c")
    f = f.where(" and ".join(f"shiftright(if({k} < 50, h0, h1), cast({k} % 50 as int)) & 1 = 1" for k in "abc"))
    return f.select("mesh_id", "fid", *(F.col(k).cast("bigint").alias(k) for k in "abc"))


def mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vertices(spark, sf_dir), faces(spark, sf_dir)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, c1, c2, c3, label): the sums of the thirds of every embedding, as three components that take in all of it."""
    third = lambda k: F.aggregate(F.expr(f"filter(v, (x, i) -> i * 3 div size(v) = {k})"), F.lit(0.0), lambda s, x: s + x)
    return embeddings(spark, sf_dir).select("id", *(third(k).alias(f"c{k + 1}") for k in range(3)), "label")


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, pid, x, y, z): one cloud a label."""
    return coords(spark, sf_dir).select(F.col("label").cast("long").alias("mesh_id"), F.col("id").alias("pid"), F.col("c1").alias("x"), F.col("c2").alias("y"), F.col("c3").alias("z"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn on pixels: mesh = supplier % 20, row = line number, column = quantity."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 20 as mesh_id", "cast(l_linenumber as int) as row", "cast(l_quantity as int) as col", "least(floor(l_extendedprice) / 100000, 1D) as value", "l_extendedprice as depth", "struct(l_orderkey, l_partkey, l_suppkey) as fid", "l_returnflag as flag")


MESH = """v as (select p_partkey // 100 as mesh_id, p_partkey % 100 as vid, (p_partkey % 100 % 10)::double as x, (p_partkey % 100 // 10)::double as y, 0.1::double * p_size as z from part),
cells as (select mesh_id, fid, fid // 2 // 9 * 10 + fid // 2 % 9 as o, fid % 2 as k from (select distinct mesh_id from v), range(162) r(fid)),
f as (select mesh_id, fid, a, b, c from (select mesh_id, fid, if(k = 0, o, o + 1) as a, if(k = 0, o + 1, o + 11) as b, o + 10 as c from cells) t
  where exists (select 1 from v where v.mesh_id = t.mesh_id and vid = a) and exists (select 1 from v where v.mesh_id = t.mesh_id and vid = b) and exists (select 1 from v where v.mesh_id = t.mesh_id and vid = c))"""
MEASURED = """m0 as (select f.*, p.x ax, p.y ay, p.z az, q.x bx, q.y by_, q.z bz, r.x cx, r.y cy, r.z cz from f join v p on p.mesh_id = f.mesh_id and p.vid = a join v q on q.mesh_id = f.mesh_id and q.vid = b join v r on r.mesh_id = f.mesh_id and r.vid = c),
m1 as (select *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) as gx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as gy, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as gz from m0),
m as (select *, sqrt(gx * gx + gy * gy + gz * gz) as twice, gx / sqrt(gx * gx + gy * gy + gz * gz) as nx, gy / sqrt(gx * gx + gy * gy + gz * gz) as ny, gz / sqrt(gx * gx + gy * gy + gz * gz) as nz, sqrt(gx * gx + gy * gy + gz * gz) / 2 as area from m1)"""
CORNERS = "k3 as (select mesh_id, fid, unnest([a, b, c]) as vid, nx, ny, nz, area from m)"
NORMALS = "vn as (select mesh_id, vid, sx / sqrt(sx * sx + sy * sy + sz * sz) as vx, sy / sqrt(sx * sx + sy * sy + sz * sz) as vy, sz / sqrt(sx * sx + sy * sy + sz * sz) as vz from (select mesh_id, vid, sum(nx * area) sx, sum(ny * area) sy, sum(nz * area) sz from k3 group by all))"
CURVATURE = "cv as (select v.mesh_id, v.vid, coalesce(avg(acos(greatest(least(vx * nx + vy * ny + vz * nz, 1), -1))), 0) as curvature from v left join k3 on k3.mesh_id = v.mesh_id and k3.vid = v.vid left join vn on vn.mesh_id = v.mesh_id and vn.vid = v.vid group by all)"
EDGES = "e as (select mesh_id, fid, least(s.p, s.q) as u, greatest(s.p, s.q) as w from (select mesh_id, fid, unnest([{'p': a, 'q': b}, {'p': b, 'q': c}, {'p': c, 'q': a}]) as s from f))"
ADJACENT = "adj as (select mesh_id, u, w, min(fid) f1, max(fid) f2 from e group by all having count(*) = 2)"
DIHEDRAL = """pairs as (select adj.mesh_id, unnest([f1, f2]) as fid, acos(greatest(least(-(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz), 1), -1)) as angle from adj join m p on p.mesh_id = adj.mesh_id and p.fid = f1 join m q on q.mesh_id = adj.mesh_id and q.fid = f2),
dih as (select m.mesh_id, m.fid, greatest(coalesce(max(angle), 0), 0) as dihedral from m left join pairs on pairs.mesh_id = m.mesh_id and pairs.fid = m.fid group by all)"""
EMBEDDED = "emb as (select vec_id as id, embedding::double[] as v, label from embeddings)"
THIRDS = ", ".join(f"list_sum(embedding[({k} * len(embedding) + 2) // 3 + 1 : ({k + 1} * len(embedding) + 2) // 3]::double[]) as c{k + 1}" for k in range(3))
COORDS = f"co as (select vec_id as id, {THIRDS}, label from embeddings)"
FRAGMENTS = "fr as (select l_suppkey % 20 as mesh_id, l_linenumber as row_, l_quantity::int as col_, least(floor(l_extendedprice) / 100000, 1) as value, l_extendedprice as depth, row(l_orderkey, l_partkey, l_suppkey) as fid, l_returnflag as flag from lineitem)"


def tidy(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0"


def sql(*parts: str) -> str:
    """A query of common tables and, last, what is selected from them."""
    *ctes, body = parts
    return (f"with {', '.join(ctes)} " if ctes else "") + body
