"""Queries on correlations, archetypes, patches and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import tidy as r
from ..operators import archetypes, sampling
from .inputs import COORDS, EMBEDDED, clouds, coords, embeddings, sql, table, tidy

AXES = ["c1", "c2", "c3"]
TIPS = [(0, -0.3, -0.2, 0.1), (1, 0.4, -0.1, -0.2), (2, 0.0, 0.5, 0.2), (3, 0.1, 0.0, -0.6)]


def _tips(s):
    return s.createDataFrame(TIPS, "k int, c1 double, c2 double, c3 double")


def pearson_r(s, d):
    long = coords(s, d).select("label", "c1", F.expr("stack(2, 'c2', c2, 'c3', c3) as (name, x)"))
    return archetypes.correlate(long, "c1", "x", "label", "name").select("label", "name", "n", r("r", 5).alias("r"))


def linear_fit(s, d):
    return coords(s, d).groupBy("label").agg(r(F.regr_slope("c2", "c1"), 5).alias("slope"), r(F.regr_intercept("c2", "c1"), 5).alias("intercept"))


def patch_corr(s, d):
    """Each of 63 patches' values against the first component; 0 where a patch is constant."""
    long = embeddings(s, d).select(F.col("v")[0].alias("pc"), F.posexplode("v").alias("patch", "x")).where("patch > 0")
    flat = (F.stddev_pop("x") <= 1e-8) | (F.stddev_pop("pc") <= 1e-8)
    return long.groupBy("patch").agg(r(F.when(flat, 0.0).otherwise(F.corr("x", "pc")), 5).alias("r"))


def edge_walk(s, d):
    return archetypes.edge_walk(coords(s, d), _tips(s), AXES).select("id", "i", "j", r("t", 5).alias("t"))


def archetype_report(s, d):
    walk = archetypes.edge_walk(coords(s, d), _tips(s), AXES).join(embeddings(s, d).select("id", F.col("v")[9].alias("x")), "id")
    return archetypes.correlate(walk, "t", "x", "i", "j").select("i", "j", "n", r("r", 5).alias("r"))


def inside_tetra(s, d):
    corners = [[F.lit(float(x)) for x in t[1:]] for t in TIPS]
    c = coords(s, d)
    return c.groupBy("label").agg(F.count_if(archetypes.inside_tetrahedron([F.col(a) for a in AXES], corners)).alias("n_inside"), F.count("*").alias("n"))


def contract_simplex(s, d):
    """The means of four groups of labels as archetypes."""
    tips = coords(s, d).groupBy((F.col("label") % 4).alias("k")).agg(*(F.avg(a).alias(a) for a in AXES))
    return archetypes.contract(tips, AXES).select("k", *(r(a).alias(a) for a in AXES))


def patch_knn(s, d):
    p = clouds(s, d)
    centres = p.select("mesh_id", F.col("pid").alias("g"), "pid")
    return sampling.patches(p, centres, 8).select("mesh_id", "g", "k_rank", "pid", r("lx", 5).alias("lx"))


def chamfer(s, d):
    """Each label's cloud against its mirror image."""
    p = clouds(s, d)
    return sampling.chamfer(p, p.withColumn("x", -F.col("x"))).select("mesh_id", r("chamfer").alias("chamfer"))


def fps(s, d):
    return sampling.farthest(clouds(s, d), 16)


def split(s, d):
    return sampling.split(embeddings(s, d).select("id"), "id")


def batches(s, d):
    return sampling.batches(embeddings(s, d).select("id"), "id")


def mask_groups(s, d):
    return sampling.mask_groups(sampling.farthest(clouds(s, d), 32), "mesh_id")


def events_windows(s, d):
    """Hourly counts of the event table, as a stream of it gives them."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


T = "ti as (select unnest([0, 1, 2, 3])::int k, unnest([-0.3, 0.4, 0.0, 0.1])::double c1, unnest([-0.2, -0.1, 0.5, 0.0])::double c2, unnest([0.1, -0.2, 0.2, -0.6])::double c3)"
WALK = "wk as (select co.id, label, a.k i, b.k j, ((co.c1 - a.c1) * (b.c1 - a.c1) + (co.c2 - a.c2) * (b.c2 - a.c2) + (co.c3 - a.c3) * (b.c3 - a.c3)) / ((b.c1 - a.c1) ** 2 + (b.c2 - a.c2) ** 2 + (b.c3 - a.c3) ** 2) as t from co, ti a, ti b where a.k < b.k)"


def _det(a, b, c):
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]}) + {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"


def _inside() -> str:
    sub = [[f"({x}::double - {y}::double)" for x, y in zip(t[1:], TIPS[0][1:], strict=True)] for t in TIPS[1:]]
    p = [f"({a} - {y}::double)" for a, y in zip(AXES, TIPS[0][1:], strict=True)]
    a, b, c = sub
    d = _det(a, b, c)
    w = [f"{_det(p, b, c)} / {d}", f"{_det(a, p, c)} / {d}", f"{_det(a, b, p)} / {d}"]
    return " and ".join(f"{x} >= -1e-9" for x in [*w, f"1 - {w[0]} - {w[1]} - {w[2]}"])


POINTS = "p as (select label::bigint as mesh_id, id as pid, c1 x, c2 y, c3 z from co)"

QUERIES = {
    "pearson_r": (pearson_r, sql(COORDS, "l as (select label, c1, unnest(['c2', 'c3']) as name, unnest([c2, c3]) as x from co)", f"select label, name, count(*) as n, {tidy('corr(c1, x)', 5)} as r from l group by 1, 2")),
    "linear_fit": (linear_fit, sql(COORDS, f"select label, {tidy('regr_slope(c2, c1)', 5)} as slope, {tidy('regr_intercept(c2, c1)', 5)} as intercept from co group by 1")),
    "patch_corr": (patch_corr, sql(EMBEDDED, "l as (select v[1] as pc, generate_subscripts(v, 1)::int - 1 as patch, unnest(v) as x from emb)", f"select patch, {tidy('case when stddev_pop(x) <= 1e-8 or stddev_pop(pc) <= 1e-8 then 0 else corr(x, pc) end', 5)} as r from l where patch > 0 group by 1")),
    "edge_walk": (edge_walk, sql(COORDS, T, WALK, f"select id, i, j, {tidy('t', 5)} as t from wk")),
    "archetype_report": (archetype_report, sql(COORDS, T, WALK, f"select i, j, count(*) as n, {tidy('corr(t, embedding[10]::double)', 5)} as r from wk join embeddings on vec_id = id group by 1, 2")),
    "inside_tetra": (inside_tetra, sql(COORDS, f"select label, count(*) filter (where {_inside()}) as n_inside, count(*) as n from co group by 1")),
    "contract_simplex": (contract_simplex, sql(COORDS, "ti as (select label % 4 as k, avg(c1) c1, avg(c2) c2, avg(c3) c3 from co group by 1)", "select k, " + ", ".join(f"{tidy(f'm{a} + 0.85::double * ({a} - m{a})')} as {a}" for a in AXES) + " from ti, (select avg(c1) mc1, avg(c2) mc2, avg(c3) mc3 from ti)")),
    "patch_knn": (patch_knn, sql(COORDS, POINTS, "r as (select a.mesh_id, a.pid as g, b.pid, b.x - a.x as lx, row_number() over (partition by a.mesh_id, a.pid order by (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2, b.pid) as k from p a join p b on a.mesh_id = b.mesh_id)", f"select mesh_id, g, k::int as k_rank, pid, {tidy('lx', 5)} as lx from r where k <= 8")),
    "chamfer": (chamfer, sql(COORDS, POINTS, "pr as (select a.mesh_id, a.pid i, b.pid j, (a.x + b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 d from p a join p b on a.mesh_id = b.mesh_id), t as (select mesh_id, avg(d) t from (select mesh_id, i, min(d) d from pr group by 1, 2) group by 1), k as (select mesh_id, avg(d) k from (select mesh_id, j, min(d) d from pr group by 1, 2) group by 1)", f"select mesh_id, {tidy('t + k')} as chamfer from t join k using (mesh_id)")),
    "event_windows": (events_windows, "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2"),
    "fps": (fps, None),
    "split": (split, None),
    "batches": (batches, None),
    "mask_groups": (mask_groups, None),
}
