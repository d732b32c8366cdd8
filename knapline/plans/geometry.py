"""Queries on meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import barycentric as weights_of
from ..functions.scalars import shade, tidy as r
from ..operators import chain, decimate, geometry as op, sampling
from .inputs import ADJACENT, CORNERS, CURVATURE, DIHEDRAL, EDGES, MEASURED, MESH, NORMALS, mesh, sql, table, tidy


def _rounded(df, keys, *values, places=6):
    return df.select(*keys, *(r(v, places).alias(v) for v in values))


def face_area(s, d):
    return _rounded(op.measured(*mesh(s, d)), ["mesh_id", "fid"], "area")


def surface_area(s, d):
    return _rounded(op.surface_area(*mesh(s, d)), ["mesh_id"], "area", places=5)


def face_normals(s, d):
    return _rounded(op.measured(*mesh(s, d)), ["mesh_id", "fid"], "nx", "ny", "nz")


def vertex_normals(s, d):
    return _rounded(op.vertex_normals(*mesh(s, d)), ["mesh_id", "vid"], "nx", "ny", "nz")


def orient_outward(s, d):
    return op.orient_outward(*mesh(s, d)).select("mesh_id", "fid", "a", "b", "c")


def bbox_extents(s, d):
    return _rounded(op.bbox(mesh(s, d)[0]), ["mesh_id"], "ex", "ey", "ez", "e1", "e2", "e3")


def global_extents(s, d):
    return _rounded(op.global_extents(mesh(s, d)[0]), [], "max_long", "max_mid", "max_short")


def normalize_mesh(s, d):
    return _rounded(op.normalize(mesh(s, d)[0]), ["mesh_id", "vid"], "x", "y", "z")


def canvas_params(s, d):
    e = op.bbox(mesh(s, d)[0]).agg(F.max("e1").alias("max_x"), F.max("e2").alias("max_y"))
    return op.canvas(e).select(r("scale").alias("scale"), "canvas_w", "canvas_h")


def _doubled(s, d):
    """Heights cut to whole numbers and positions to a coarse grid, so that vertices coincide."""
    v, f = mesh(s, d)
    return v.select("mesh_id", "vid", F.floor(F.col("x") / 2).cast("double").alias("x"), "y", F.floor("z").cast("double").alias("z")), f


def merge_vertices(s, d):
    v, _ = op.merge_vertices(*_doubled(s, d))
    return _rounded(v, ["mesh_id", "vid"], "x", "y", "z")


def drop_degenerate(s, d):
    v, f = op.merge_vertices(*_doubled(s, d))
    return op.drop_degenerate(v, f)


def _gentle(v, f):
    return op.measured(v, f).where("nz >= 0.5").select("mesh_id", "fid", "a", "b", "c")


def reindex(s, d):
    """What is left of the vertices when only gently sloping faces stay."""
    v, f = mesh(s, d)
    v, f = op.reindex(v, _gentle(v, f))
    return f.join(v.select("mesh_id", F.col("vid").alias("a"), F.col("x").alias("ax")), ["mesh_id", "a"]).select("mesh_id", "fid", "a", "b", "c", r("ax").alias("ax"))


def edge_count(s, d):
    return op.edge_count(mesh(s, d)[1])


def edge_adjacency(s, d):
    return op.adjacency(mesh(s, d)[1])


def quadrics(s, d):
    q = op.quadrics(*mesh(s, d))
    return _rounded(q, ["mesh_id", "vid"], *[c for c in q.columns if c.startswith("q")], places=5)


def cluster_decimate(s, d):
    v, f = decimate.cluster(*mesh(s, d), 60)
    x = v.select("mesh_id", F.col("vid").alias("a"), F.col("x").alias("ax"), F.col("z").alias("az"))
    return f.join(x, ["mesh_id", "a"]).groupBy("mesh_id").agg(F.count("*").alias("n_faces"), r(F.sum("ax"), 4).alias("sx"), r(F.sum("az"), 4).alias("sz"))


def lod_targets(s, d):
    """Targets of each mesh from its face count alone, as expressions."""
    n = mesh(s, d)[1].groupBy("mesh_id").agg(F.count("*").alias("n")).where("n > 20")
    steps = F.array(*(F.floor(F.col("n") * F.pow(F.lit(20.0) / F.col("n"), F.lit(k / 4)) + 1e-9) for k in range(1, 5)))
    return n.select("mesh_id", F.explode(F.array_distinct(steps)).alias("target"))


def components(s, d):
    """Patches of gently sloping faces."""
    v, f = mesh(s, d)
    return op.components(v, _gentle(v, f)).select("mesh_id", "vid", "component")


def clean_mesh(s, d):
    v, f = op.clean_mesh(*_doubled(s, d), largest=False)
    n = v.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))
    return n.join(f.groupBy("mesh_id").agg(F.count("*").alias("n_faces")), "mesh_id").join(op.surface_area(v, f), "mesh_id").select("mesh_id", "n_vertices", "n_faces", r("area", 5).alias("area"))


def dedupe_faces(s, d):
    v, f = op.merge_vertices(*_doubled(s, d))
    return decimate.dedupe_faces(f)


def barycentric(s, d):
    u, v, w = weights_of(F.lit(0.36), F.lit(0.25))
    m = op.corners(*mesh(s, d))
    return m.select("mesh_id", "fid", *(r(u * F.col(f"a{k}") + v * F.col(f"b{k}") + w * F.col(f"c{k}")).alias(k) for k in "xyz"))


def _weights(mode):
    def query(s, d):
        return _rounded(sampling.weights(*mesh(s, d), mode), ["mesh_id", "fid"], "w", places=7 if mode == "uniform" else 5)

    return query


def curvature(s, d):
    return _rounded(op.curvature(*mesh(s, d)), ["mesh_id", "vid"], "curvature", places=4)


def dihedral_max(s, d):
    return _rounded(op.max_dihedral(*mesh(s, d)), ["mesh_id", "fid"], "dihedral", places=4)


def diffuse_shade(s, d):
    light = tuple(F.lit(x) for x in (0.4, 0.3, 0.85))
    m = op.measured(*mesh(s, d))
    return m.select("mesh_id", "fid", r(shade((F.col("nx"), F.col("ny"), F.col("nz")), light)).alias("shade"))


def mesh_report(s, d):
    raw = mesh(s, d)
    return _rounded(op.mesh_metadata(raw, op.clean_mesh(*raw)), ["mesh_id", "num_original_vertices", "num_original_faces", "num_clean_vertices", "num_clean_faces"], "centroid_x", "centroid_y", "centroid_z", "scale_factor", "surface_area", places=5)


def mesh_diagnostic(s, d):
    found = chain.report(*mesh(s, d))
    return _rounded(found, [c for c in found.columns if c not in ("surface_area", "extent")], "surface_area", "extent", places=5)


def sample_union(s, d):
    """Bags of faces, united with repeats kept."""
    f = mesh(s, d)[1].select("mesh_id", "fid")
    return f.unionByName(f)


def sample_uniform(s, d):
    return _rounded(sampling.sample(*mesh(s, d), 256), ["mesh_id", "pid"], "x", "y", "z")


def sample_edge_aware(s, d):
    return _rounded(sampling.sample_edge_aware(*mesh(s, d), 256), ["mesh_id", "pid"], "x", "y", "z")


def resize_sample(s, d):
    return sampling.resize(sampling.sample(*mesh(s, d), 100), 128).select("mesh_id", "pid")


def principal_extents(s, d):
    return _rounded(op.principal_extents(mesh(s, d)[0]), ["mesh_id"], "length", "width", "depth")


def lod_levels(s, d):
    return decimate.levels_of_detail(*mesh(s, d), levels=3, least=40)


def qem_decimate(s, d):
    v, f = decimate.decimate(*mesh(s, d), target=80)
    return f.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))


def embed_points(s, d):
    from ..operators.embed import embed

    v = mesh(s, d)[0].withColumnRenamed("vid", "pid")
    return embed(v)


M = (MESH, MEASURED)
DOUBLED = "dv as (select mesh_id, vid, floor(x / 2) as x, y, floor(z) as z from v), gr as (select *, round_even(x / 1e-8, 0)::bigint gx, round_even(y / 1e-8, 0)::bigint gy, round_even(z / 1e-8, 0)::bigint gz from dv), mg as (select mesh_id, gx, gy, gz, avg(x) x, avg(y) y, avg(z) z, row_number() over (partition by mesh_id order by gx, gy, gz) - 1 as nid from gr group by mesh_id, gx, gy, gz), mp as (select gr.mesh_id, vid, nid from gr join mg on mg.mesh_id = gr.mesh_id and mg.gx = gr.gx and mg.gy = gr.gy and mg.gz = gr.gz), rf as (select f.mesh_id, fid, p.nid a, q.nid b, o.nid c from f join mp p on p.mesh_id = f.mesh_id and p.vid = a join mp q on q.mesh_id = f.mesh_id and q.vid = b join mp o on o.mesh_id = f.mesh_id and o.vid = c)"
CROSS = "t0 as (select rf.*, (q.y - p.y) * (o.z - p.z) - (q.z - p.z) * (o.y - p.y) gx, (q.z - p.z) * (o.x - p.x) - (q.x - p.x) * (o.z - p.z) gy, (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) gz from rf join mg p on p.mesh_id = rf.mesh_id and p.nid = a join mg q on q.mesh_id = rf.mesh_id and q.nid = b join mg o on o.mesh_id = rf.mesh_id and o.nid = c where a <> b and b <> c and a <> c), tt as (select * from t0 where sqrt(gx * gx + gy * gy + gz * gz) > 1e-15)"
W = lambda raw, places: f"select mesh_id, fid, {tidy(f'({raw}) / sum({raw}) over (partition by mesh_id)', places)} as w"
Q = {"xx": "nx * nx", "xy": "nx * ny", "xz": "nx * nz", "xd": "nx * nd", "yy": "ny * ny", "yz": "ny * nz", "yd": "ny * nd", "zz": "nz * nz", "zd": "nz * nd", "dd": "nd * nd"}
BOX = "b as (select mesh_id, max(x) - min(x) ex, max(y) - min(y) ey, max(z) - min(z) ez from v group by 1), sb as (select *, list_reverse_sort([ex, ey, ez]) l from b)"
CLUSTER = """nf as (select mesh_id, count(*) n from f group by 1), g0 as (select v.*, n, greatest(4, floor(cbrt(count(*) over (partition by v.mesh_id) * (60.0 / n)) * 1.5)) as g, min(x) over w lx, max(x) over w - min(x) over w sx, min(y) over w ly, max(y) over w - min(y) over w sy, min(z) over w lz, max(z) over w - min(z) over w sz from v join nf on nf.mesh_id = v.mesh_id where n > 60 window w as (partition by v.mesh_id)),
g1 as (select mesh_id, vid, x, y, z, floor((x - lx) / if(sx > 0, sx, 1) * (g - 1)) gx, floor((y - ly) / if(sy > 0, sy, 1) * (g - 1)) gy, floor((z - lz) / if(sz > 0, sz, 1) * (g - 1)) gz from g0),
gm as (select mesh_id, gx, gy, gz, avg(x) x, avg(z) z, row_number() over (partition by mesh_id order by gx, gy, gz) - 1 as nid from g1 group by mesh_id, gx, gy, gz),
mp as (select g1.mesh_id, vid, nid from g1 join gm on gm.mesh_id = g1.mesh_id and gm.gx = g1.gx and gm.gy = g1.gy and gm.gz = g1.gz),
rf as (select f.mesh_id, fid, p.nid a, q.nid b, o.nid c from f join mp p on p.mesh_id = f.mesh_id and p.vid = a join mp q on q.mesh_id = f.mesh_id and q.vid = b join mp o on o.mesh_id = f.mesh_id and o.vid = c),
df as (select * from (select *, row_number() over (partition by mesh_id, list_sort([a, b, c]) order by fid) r from rf where a <> b and b <> c and a <> c) where r = 1),
al as (select df.mesh_id, gm.x ax, gm.z az from df join gm on gm.mesh_id = df.mesh_id and gm.nid = df.a union all select f.mesh_id, v.x, v.z from f join v on v.mesh_id = f.mesh_id and v.vid = f.a join nf on nf.mesh_id = f.mesh_id where n <= 60)"""

QUERIES = {
    "face_area": (face_area, sql(*M, f"select mesh_id, fid, {tidy('area')} as area from m")),
    "surface_area": (surface_area, sql(*M, f"select mesh_id, {tidy('sum(area)', 5)} as area from m group by 1")),
    "face_normals": (face_normals, sql(*M, f"select mesh_id, fid, {tidy('nx')} as nx, {tidy('ny')} as ny, {tidy('nz')} as nz from m")),
    "vertex_normals": (vertex_normals, sql(*M, CORNERS, NORMALS, f"select mesh_id, vid, {tidy('vx')} as nx, {tidy('vy')} as ny, {tidy('vz')} as nz from vn")),
    "orient_outward": (orient_outward, sql(*M, "fc as (select *, (ax + bx + cx) / 3 fx, (ay + by_ + cy) / 3 fy, (az + bz + cz) / 3 fz from m), mc as (select *, avg(fx) over w mx, avg(fy) over w my, avg(fz) over w mz from fc window w as (partition by mesh_id))", "select mesh_id, fid, a, case when nx * (fx - mx) + ny * (fy - my) + nz * (fz - mz) < -1e-9 then c else b end as b, case when nx * (fx - mx) + ny * (fy - my) + nz * (fz - mz) < -1e-9 then b else c end as c from mc")),
    "bbox_extents": (bbox_extents, sql(MESH, BOX, f"select mesh_id, {tidy('ex')} ex, {tidy('ey')} ey, {tidy('ez')} ez, {tidy('l[1]')} e1, {tidy('l[2]')} e2, {tidy('l[3]')} e3 from sb")),
    "global_extents": (global_extents, sql(MESH, BOX, f"select {tidy('greatest(max(l[1]), 1e-10)')} max_long, {tidy('greatest(max(l[2]), 1e-10)')} max_mid, {tidy('greatest(max(l[3]), 1e-10)')} max_short from sb")),
    "normalize_mesh": (normalize_mesh, sql(MESH, "c as (select mesh_id, vid, x - avg(x) over w x, y - avg(y) over w y, z - avg(z) over w z from v window w as (partition by mesh_id)), k as (select *, sqrt((max(x) over w - min(x) over w) ** 2 + (max(y) over w - min(y) over w) ** 2 + (max(z) over w - min(z) over w) ** 2) as s from c window w as (partition by mesh_id))", "select mesh_id, vid, " + ", ".join(f"{tidy(f'{k} / case when s > 0 then s else 1 end')} as {k}" for k in "xyz") + " from k")),
    "canvas_params": (canvas_params, sql(MESH, BOX, "g as (select max(l[1]) mx, max(l[2]) my from sb), sc as (select *, 224 * (1 - 2 * 0.08::double) / greatest(mx, my) as scale from g)", f"select {tidy('scale')} as scale, greatest(1, round_even(mx * scale + 2 * 224 * 0.08::double, 0)::int) as canvas_w, greatest(1, round_even(my * scale + 2 * 224 * 0.08::double, 0)::int) as canvas_h from sc")),
    "merge_vertices": (merge_vertices, sql(MESH, DOUBLED, f"select mesh_id, nid as vid, {tidy('x')} x, {tidy('y')} y, {tidy('z')} z from mg")),
    "drop_degenerate": (drop_degenerate, sql(MESH, DOUBLED, CROSS, "select mesh_id, fid, a, b, c from tt")),
    "reindex": (reindex, sql(*M, "s as (select mesh_id, fid, a, b, c from m where nz >= 0.5), u as (select distinct mesh_id, unnest([a, b, c]) as vid from s), n as (select mesh_id, vid, row_number() over (partition by mesh_id order by vid) - 1 as nid from u)", f"select s.mesh_id, fid, p.nid a, q.nid b, o.nid c, {tidy('v.x')} as ax from s join n p on p.mesh_id = s.mesh_id and p.vid = a join n q on q.mesh_id = s.mesh_id and q.vid = b join n o on o.mesh_id = s.mesh_id and o.vid = c join v on v.mesh_id = s.mesh_id and v.vid = s.a")),
    "edge_count": (edge_count, sql(MESH, EDGES, "select mesh_id, count(*) as n_edges from (select distinct mesh_id, u, w from e) group by 1")),
    "edge_adjacency": (edge_adjacency, sql(MESH, EDGES, ADJACENT, "select mesh_id, u, w as v, f1, f2 from adj")),
    "quadrics": (quadrics, sql(*M, "pl as (select mesh_id, unnest([a, b, c]) as vid, nx, ny, nz, -(nx * ax + ny * ay + nz * az) as nd, area from m)", "select mesh_id, vid, " + ", ".join(f"{tidy(f'sum({e} * area)', 5)} as q{n}" for n, e in Q.items()) + " from pl group by 1, 2")),
    "cluster_decimate": (cluster_decimate, sql(MESH, CLUSTER, f"select mesh_id, count(*) as n_faces, {tidy('sum(ax)', 4)} as sx, {tidy('sum(az)', 4)} as sz from al group by 1")),
    "lod_targets": (lod_targets, sql(MESH, "n as (select mesh_id, count(*) n from f group by 1)", "select distinct mesh_id, floor(n * pow(20::double / n, k / 4) + 1e-9)::bigint as target from n, range(1, 5) r(k) where n > 20")),
    "components": (components, "with recursive " + sql(MESH.replace("v as (", "v as materialized (").replace("f as (", "f as materialized ("), MEASURED, "l as (select mesh_id, unnest([a, b, c]) as u, unnest([b, c, a]) as w from m where nz >= 0.5), bi as materialized (select mesh_id, u, w from l union select mesh_id, w, u from l), r(mesh_id, vid, root) as (select mesh_id, vid, vid from v union select r.mesh_id, bi.w, r.root from r join bi on bi.mesh_id = r.mesh_id and bi.u = r.vid and bi.w > r.root)", "select mesh_id, vid, min(root) as component from r group by 1, 2")[5:]),
    "clean_mesh": (clean_mesh, sql(MESH, DOUBLED, CROSS, f"select tt.mesh_id, any_value(u.n) as n_vertices, count(*) as n_faces, {tidy('sum(sqrt(gx * gx + gy * gy + gz * gz) / 2)', 5)} as area from tt join (select mesh_id, count(distinct i) n from (select mesh_id, unnest([a, b, c]) i from tt) group by 1) u on u.mesh_id = tt.mesh_id group by tt.mesh_id")),
    "dedupe_faces": (dedupe_faces, sql(MESH, DOUBLED, "select mesh_id, fid, a, b, c from (select *, row_number() over (partition by mesh_id, list_sort([a, b, c]) order by fid) r from rf) where r = 1")),
    "barycentric": (barycentric, sql(*M, "select mesh_id, fid, " + ", ".join(f"{tidy(f'0.4::double * a{k} + 0.6::double * 0.75::double * b{k}{chr(95) if k == chr(121) else str()} + 0.6::double * 0.25::double * c{k}')} as {k}" for k in "xyz") + " from m")),
    "w_uniform": (_weights("uniform"), sql(*M, W("area", 7) + " from m")),
    "w_curvature": (_weights("curvature"), sql(*M, CORNERS, NORMALS, CURVATURE, "fw as (select k3.mesh_id, k3.fid, any_value(area) * (1 + 3 * avg(curvature)) as raw from k3 join cv on cv.mesh_id = k3.mesh_id and cv.vid = k3.vid group by 1, 2)", W("raw", 5) + " from fw")),
    "w_edge": (_weights("edge"), sql(*M, EDGES, ADJACENT, DIHEDRAL, "fw as (select m.mesh_id, m.fid, area * (1 + 5 * dihedral / pi()) as raw from m join dih on dih.mesh_id = m.mesh_id and dih.fid = m.fid)", W("raw", 5) + " from fw")),
    "curvature": (curvature, sql(*M, CORNERS, NORMALS, CURVATURE, f"select mesh_id, vid, {tidy('curvature', 4)} as curvature from cv")),
    "dihedral_max": (dihedral_max, sql(*M, EDGES, ADJACENT, DIHEDRAL, f"select mesh_id, fid, {tidy('dihedral', 4)} as dihedral from dih")),
    "diffuse_shade": (diffuse_shade, sql(*M, f"select mesh_id, fid, {tidy('0.30::double + 0.65::double * greatest(nx * 0.4::double + ny * 0.3::double + nz * 0.85::double, 0)')} as shade from m")),
    "mesh_report": (mesh_report, sql(*M, "a as (select mesh_id, sum(area) area, count(*) nf from m group by 1), n0 as (select mesh_id, count(*) nv from v group by 1), u as (select v.* from v where exists (select 1 from f where f.mesh_id = v.mesh_id and v.vid in (f.a, f.b, f.c))), c as (select mesh_id, count(*) cv, avg(x) gx, avg(y) gy, avg(z) gz, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) size from u group by 1)", f"select n0.mesh_id, nv as num_original_vertices, coalesce(nf, 0) as num_original_faces, coalesce(cv, 0) as num_clean_vertices, coalesce(nf, 0) as num_clean_faces, {tidy('gx', 5)} centroid_x, {tidy('gy', 5)} centroid_y, {tidy('gz', 5)} centroid_z, round(case when size > 0 then size when size is not null then 1 end, 5) + 0.0 as scale_factor, {tidy('area', 5)} as surface_area from n0 left join a on a.mesh_id = n0.mesh_id left join c on c.mesh_id = n0.mesh_id")),
    "mesh_diagnostic": (mesh_diagnostic, None),
    "sample_union": (sample_union, sql(MESH, "select mesh_id, fid from f union all select mesh_id, fid from f")),
    "sample_uniform": (sample_uniform, None),
    "sample_edge_aware": (sample_edge_aware, None),
    "resize_sample": (resize_sample, None),
    "principal_extents": (principal_extents, None),
    "lod_levels": (lod_levels, None),
    "qem_decimate": (qem_decimate, None),
    "embed_points": (embed_points, None),
}
