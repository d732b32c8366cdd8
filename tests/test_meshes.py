"""Closed-form fixtures for meshes, files and kernels."""

import math

import numpy as np
import pytest

from knapline.functions import stats, text
from knapline.operators import archetypes, chain, decimate, embed, geometry, images, metadata, sampling, similarity, views
from knapline.operators.lineage import settle
from knapline.sources import sinks, tables, vrml
from knapline.streaming import refresh
from pyspark.sql import functions as F

CORNERS = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
QUADS = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
TRIANGLES = [t for a, b, c, d in QUADS for t in ((a, b, c), (a, c, d))]


def mesh(spark, corners, triangles, name="m"):
    v = spark.createDataFrame([(name, i, *map(float, p)) for i, p in enumerate(corners)], "mesh_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame([(name, i, *t) for i, t in enumerate(triangles)], "mesh_id string, fid long, a long, b long, c long")
    return v, f


@pytest.fixture(scope="module")
def cube(spark):
    return mesh(spark, CORNERS, TRIANGLES)


def test_cube(spark, cube):
    v, f = cube
    assert geometry.surface_area(v, f).first()["area"] == pytest.approx(6)
    assert geometry.edge_count(f).first()["n_edges"] == 18
    box = geometry.bbox(v).first()
    assert (box["ex"], box["ey"], box["ez"]) == (1, 1, 1)
    out = geometry.measured(v, geometry.orient_outward(v, f)).collect()
    for r in out:
        centre = [(r[f"a{k}"] + r[f"b{k}"] + r[f"c{k}"]) / 3 - 0.5 for k in "xyz"]
        assert sum(c * r[f"n{k}"] for c, k in zip(centre, "xyz")) > 0
    span = geometry.normalize(v).agg(*(F.max(k) - F.min(k) for k in "xyz")).first()
    assert sum(x * x for x in span) == pytest.approx(1)


def test_outward_ignores_windings(spark, cube):
    v, f = cube
    flipped = f.withColumn("t", F.when(F.col("fid") % 3 == 0, F.col("b")).otherwise(F.col("c"))).withColumn("b", F.when(F.col("fid") % 3 == 0, F.col("c")).otherwise(F.col("b"))).withColumn("c", F.col("t")).drop("t")
    rows = lambda g: sorted(map(tuple, g.collect()))
    normals = lambda g: sorted((r["fid"], round(r["nx"], 6), round(r["ny"], 6), round(r["nz"], 6)) for r in geometry.measured(v, g).collect())
    assert normals(geometry.orient_outward(v, flipped)) == normals(geometry.orient_outward(v, f))
    assert rows(geometry.orient_outward(v, geometry.orient_outward(v, f))) == rows(geometry.orient_outward(v, f))


def test_clean(spark):
    loose = [CORNERS[i] for t in TRIANGLES for i in t]
    far = [(9, 9, 9), (10, 9, 9), (9, 10, 9), (9, 9, 10)]
    n = len(loose)
    faces = [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(12)] + [(n, n + 1, n + 2), (n, n + 1, n + 3), (n, n + 2, n + 3), (n + 1, n + 2, n + 3), (0, 0, 1)]
    v, f = mesh(spark, loose + far + [(5, 5, 5)], faces)
    v, f = geometry.clean_mesh(v, f)
    assert (v.count(), f.count()) == (8, 12)
    assert geometry.surface_area(v, f).first()["area"] == pytest.approx(6)
    assert {r["vid"] for r in v.collect()} == set(range(8))


def test_flat_edges_weigh_most(spark):
    v, f = mesh(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)])
    assert {round(r["dihedral"], 3) for r in geometry.max_dihedral(v, f).collect()} == {round(math.pi, 3)}
    assert {round(r["dihedral"], 3) for r in geometry.max_dihedral(v, f, "edge_sharp").collect()} == {0}
    for mode in ("uniform", "curvature", "edge"):
        assert sum(r["w"] for r in sampling.weights(v, f, mode).collect()) == pytest.approx(1)


def test_sampling(spark, cube):
    p = sampling.sample(*cube, 500).toPandas()
    assert sorted(p["pid"]) == list(range(500))
    on = (np.isclose(p[["x", "y", "z"]], 0) | np.isclose(p[["x", "y", "z"]], 1)).any(axis=1)
    assert on.all()
    assert sampling.sample_edge_aware(*cube, 100).count() == 100
    pts = spark.createDataFrame([("m", i, float(i), 0.0, 0.0) for i in range(20)], "mesh_id string, pid long, x double, y double, z double")
    assert [r["pid"] for r in sampling.farthest(pts, 4).orderBy("g").collect()][:2] == [0, 19]
    assert sampling.resize(pts, 7).count() == 7
    assert sampling.resize(pts, 47).count() == 47
    empty = mesh(spark, [(0, 0, 0)] * 3, [(0, 1, 2)])
    assert sampling.sample(*empty, 5).count() == 0


def test_files(spark, tmp_path):
    body = "#VRML\nShape {{ coord Coordinate {{ point [ {} ] }} coordIndex [ {} ] }}"
    (tmp_path / "sub").mkdir()
    (tmp_path / "A.WRL").write_text(body.format("0 0 0, 1 0 0, 1 1 0, 0 1 0", "0 1 2 -1 0 1 2 3 -1 0 1 2 3 0 -1 0 1 9 -1 1 2 3"))
    (tmp_path / "sub" / "b.vrml").write_bytes(b"# \xff\xfe bad\n" + body.format("0 0 0 1 0 0 0 1 0 4", "0 1 2").encode())
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "d.wrl").write_text("nothing here")
    assert sorted(r["mesh_id"] for r in vrml.find(spark, str(tmp_path)).collect()) == ["A.WRL", "d.wrl", "sub/b.vrml"]
    assert vrml.find(spark, str(tmp_path), 2).count() == 2
    v, f, failed = vrml.load(spark, str(tmp_path))
    assert f.where("mesh_id = 'A.WRL'").count() == 4
    assert [tuple(r)[1:] for r in f.where("mesh_id = 'sub/b.vrml'").collect()] == [(0, 0, 1, 2)]
    assert [tuple(r) for r in failed.collect()] == [("d.wrl", "load", "no point block")]
    np.save(tmp_path / "e.npy", np.arange(6.0).reshape(2, 3))
    assert [list(r["v"]) for r in tables.npy(spark, str(tmp_path)).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]


CUBE = "point [0 0 0, 1 0 0, 1 1 0, 0 1 0, 0 0 {h}, 1 0 {h}, 1 1 {h}, 0 1 {h}] coordIndex [0 3 2 -1 0 2 1 -1 4 5 6 -1 4 6 7 -1 0 1 5 -1 0 5 4 -1 2 3 7 -1 2 7 6 -1 1 2 6 -1 1 6 5 -1 0 4 7 -1 0 7 3 -1]"


def picky():
    class Picky:
        """Refuses tall shapes. Defined here, since workers don't import this module."""

        width = 3

        def embed(self, points):
            if np.ptp(points, axis=0).max() > 0.9:
                raise ValueError("too tall")
            return np.ptp(points, axis=0)

    return Picky()


def test_stream(spark, tmp_path):
    """Three batches: meshes that pass, and one file for each stage that can fail. The state is that of one full pass, and
    a batch that runs again changes nothing."""
    src, out, states = tmp_path / "in", tmp_path / "out", []
    (src / "sub").mkdir(parents=True)

    def run(**files):
        for name, text in files.items():
            (src / (name.replace("__", "/") + ".wrl")).write_text(text)
        refresh.ingest(spark, str(src), str(out), str(tmp_path / "ck"), refresh=lambda s: states.append(s.first()), points=64, embedder=picky()).awaitTermination(300)

    run(a=CUBE.format(h=1), sub__a=CUBE.format(h=2))
    run(empty="empty", flat="point [0 0 0, 1 0 0, 2 0 0] coordIndex [0 1 2 -1]", tall=CUBE.format(h=90))
    run(b=CUBE.format(h=0.5))
    vectors = {r["mesh_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{out}/embeddings").collect()}
    assert set(vectors) == {"a.wrl", "sub/a.wrl", "b.wrl"}
    failed = {r["filename"]: (r["stage"], r["error"]) for r in spark.read.parquet(f"{out}/failures").collect()}
    assert failed == {"empty.wrl": ("load", "no point block"), "flat.wrl": ("clean", "no faces after cleaning"), "tall.wrl": ("embed", "ValueError: too tall")}
    x = np.array(list(vectors.values()))
    last = states[-1]
    assert [s["n"] for s in states] == [2, 2, 3] and np.allclose(last["mean"], x.mean(axis=0))
    assert np.allclose(np.array(last["scatter"]).reshape(3, 3), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
    assert last["bbox_z"] == 2 and last["surface_area"] == pytest.approx(10)
    again = spark.createDataFrame([("b.wrl", bytearray(CUBE.format(h=0.5).encode()))], "mesh_id string, content binary")
    refresh.process_batch(again, 2, str(out), 64, picky())
    now = refresh.state(spark, str(out)).first()
    assert now["n"] == 3 and np.allclose(now["mean"], last["mean"]) and spark.read.parquet(f"{out}/embeddings").count() == 3


def test_three_views_of_a_box(spark):
    """Normals stay as the windings give them; the bottom of a box is seen from below, heights run from 0 to 1."""
    v = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 2), (1, 0, 2), (1, 1, 2), (0, 1, 2)]
    up, inwards, down = [(4, 5, 6), (4, 6, 7)], [(0, 1, 2)], [(0, 3, 2)]
    px = views.three_views(*mesh(spark, v, up + inwards + down), 10.0, 20, 20).toPandas()
    top, bottom = px[px["tz"] > 0], px[px["bz"] + px["bx"] > 0]
    assert len(top) == 100 and set(top["tz"].round(6)) == {1.0} and set(top["depth"].round(6)) == {1.0}
    assert 0 < len(bottom) < 100 and set(bottom["bz"].round(6)) == {0.0}
    flat = views.three_views(*mesh(spark, v, up), 10.0, 20, 20).toPandas()
    assert set(flat["depth"]) == {0.5}


def test_pictures_and_reports_are_written(spark, tmp_path):
    rows = [(1, "top", i, j, (i + j) / 10, 0.5, 2.0) for i in range(4) for j in range(6)] + [(2, "top", 0, 0, 1.0, 0.0, -1.0)]
    px = spark.createDataFrame(rows, "mesh_id long, view string, row int, col int, r double, g double, b double")
    out = str(tmp_path / "pictures")
    assert sinks.write_pictures(images.pictures(px.where("mesh_id = 1"), 5, 6, ["r", "g", "b"]), out) == 1
    assert sinks.write_pictures(images.pictures(px, 5, 6, ["r", "g", "b"]), out) == 1
    assert sinks.write_pictures(images.pictures(px, 5, 6, ["r"]), out, force=True) == 2 and spark.read.parquet(out).count() == 2
    (tmp_path / "png").mkdir()
    (tmp_path / "png" / "one.png").write_bytes(bytes(images.pictures(px.where("mesh_id = 1"), 5, 6, ["r", "g", "b"]).first()["png"]))
    back = {(r["row"], r["col"], r["channel"]): round(r["value"] * 255) for r in tables.images(spark, str(tmp_path / "png")).collect()}
    assert back == {(i, j, k): int(min(1, c) * 255) if i < 4 else 0 for i in range(5) for j in range(6) for k, c in enumerate(((i + j) / 10, 0.5, 2.0))}
    tips = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "k int, a double, b double")
    mix = spark.createDataFrame([(7, 0, 0.25), (7, 1, 0.75), (8, 0, 1.0), (8, 1, 0.0)], "id long, k int, w double")
    sinks.write_archetypes(tips, mix, str(tmp_path / "archetypes"), 1)
    assert spark.read.parquet(str(tmp_path / "archetypes" / "tips")).count() == 2 and spark.read.parquet(str(tmp_path / "archetypes" / "mixture")).count() == 4
    assert [r["value"] for r in spark.read.text(str(tmp_path / "archetypes" / "report")).collect()] == ["archetype 0", "  8  1.0000", "archetype 1", "  7  0.7500"]


def test_dims_are_read_or_computed(spark, tmp_path):
    files = spark.createDataFrame([("sub/box.wrl", bytearray(b"point [0 0 0, 4 0 0, 4 2 0, 0 2 0, 0 0 1, 4 0 1, 4 2 1, 0 2 1]"))], "mesh_id string, content binary")
    path = tmp_path / "dims.json"
    for _ in range(2):
        (row,) = tables.dims(spark, str(path), files).collect()
        assert row["stem"] == "box" and [round(x, 6) for x in row[1:]] == [4, 2, 1] and (tmp_path / "dims.parquet").exists()
        files = files.limit(0)
    path.write_text('{"other": [3, 2, 1]}')
    assert [tuple(r) for r in tables.dims(spark, str(path), files).collect()] == [("other", 3.0, 2.0, 1.0)]


def test_layered_parsers(spark):
    """A file goes to the first parser that gives points and faces for it; what all give up is one failure."""
    ours = "point [0 0 0, 1 0 0, 0 1 0] coordIndex [0 1 2 -1]"
    files = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in (("a", ours), ("b", "tri"), ("c", "none"), ("d", "point [0 0 0, 1 0 0, 0 1 0]"))], "mesh_id string, content binary")

    def other(files):
        hit = files.where("cast(content as string) = 'tri'").select("mesh_id")
        return hit.selectExpr("mesh_id", "explode(sequence(0L, 2L)) as vid", "0D as x", "1D as y", "2D as z"), hit.selectExpr("mesh_id", "0L as fid", "0L as a", "1L as b", "2L as c")

    v, f, failed = vrml.layered(files, {"vrml": vrml.native, "other": other})
    assert {(r["mesh_id"], r["count"]) for r in v.groupBy("mesh_id").count().collect()} == {("a", 3), ("b", 3)} and sorted(r["mesh_id"] for r in f.collect()) == ["a", "b"]
    assert sorted(map(tuple, failed.collect())) == [(n, "load", "vrml: no points or no faces; other: no points or no faces") for n in ("c", "d")]


def test_decimate(spark):
    n = 12
    grid = [(x, y, math.sin(x / 3) * math.cos(y / 4)) for y in range(n) for x in range(n)]
    tri = [t for y in range(n - 1) for x in range(n - 1) for t in ((y * n + x, y * n + x + 1, y * n + x + n), (y * n + x + 1, y * n + x + n + 1, y * n + x + n))]
    x, f = decimate.collapse(np.array(grid), np.array(tri), 60)
    assert 0 < len(f) <= 60 and f.max() < len(x) and all(len(set(t)) == 3 for t in f.tolist())
    v, g = decimate.decimate(*mesh(spark, grid, tri), target=80, method="cluster")
    assert 0 < g.count() < len(tri)
    assert geometry.lod_targets(10_000, 500, 4) == sorted(geometry.lod_targets(10_000, 500, 4), reverse=True) and geometry.lod_targets(400) == []
    with pytest.raises(ValueError):
        decimate.decimate(v, g, 5, method="no")


def test_images():
    img = images.fill_triangles(np.array([[[0, 0], [8, 0], [0, 8]]], float), np.ones((1, 1)), 8, 8)
    assert 28 <= img.sum() <= 36
    assert images.hull_area(np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1]], float)) == 12
    assert images.square_pad(np.ones((2, 6))).shape == (6, 6)
    assert images.resize(np.ones((5, 5, 3)), 9) == pytest.approx(np.ones((9, 9, 3)))
    bar = np.zeros((21, 21))
    bar[10, 3:18] = 1
    assert abs(images.align_angle(bar)) == pytest.approx(90, abs=1e-6)
    assert images.align_angle(images.rotate(bar, 90) > 0.5) == pytest.approx(0, abs=1e-6)
    image = np.dstack([bar * c for c in (1.0, 0.5, 0.5, 1.0, 0.5, 0.5, 0.3)])
    up = images.upright(image)
    assert images.align_angle(up[:, :, :3].sum(axis=2) > 0.1) == pytest.approx(0, abs=1e-6)
    # The normal pointed along the bar; it still does, upwards or downwards.
    assert up[10, 10, 0] == pytest.approx(0.5, abs=1e-6) and abs(up[10, 10, 1] - 0.5) == pytest.approx(0.5, abs=1e-6) and up[10, 10, 6] == pytest.approx(0.3)
    assert images.align_angle(np.zeros((4, 4))) == 0


def test_statistics(spark):
    assert stats.p_value(0.5, 20) == pytest.approx(0.024769, abs=1e-5)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert math.isnan(stats.p_value(0.5, 2)) and stats.p_value(1.0, 5) == 0
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(4), 300) @ np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9.0]])
    z, m = archetypes.analyse(x, 4, steps=300)
    assert m.sum(axis=1) == pytest.approx(np.ones(300)) and (m >= 0).all()
    assert ((x - m @ z) ** 2).mean() < 0.3


def test_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 0]) + 7
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    p = similarity.Pca(v, 3, scaled=False)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert p.ratio == pytest.approx(values[:3] / values.sum())
    scores = np.array([[r["pc1"], r["pc2"]] for r in p.transform(v).collect()])
    assert scores.mean(axis=0) == pytest.approx([0, 0], abs=1e-9)
    z = similarity.standardize(v).where("dim = 4").collect()
    assert {r["z"] for r in z} == {0.0}


def test_copies_are_neighbours(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    assert [tuple(r) for r in similarity.neighbours(v, 1).select("query", "neighbour").orderBy("query").collect()][:2] == [(0, 1), (1, 0)]
    assert sorted(r["id"] for r in similarity.ward_order(v).collect()) == [0, 1, 2, 3]


def test_texts(spark):
    row = spark.range(1)
    notes = {"Handaxe": "h", "cleaver/ discoid?": "c/d", "on a flake": "f", "broken": "-", "": None}
    for raw, want in notes.items():
        assert row.select(text.parse_note(F.lit(raw))).first()[0] == want
    for raw, want in {"1.4 Mya": 1400, "400-250 Kya": 250, "": None}.items():
        assert row.select(text.parse_age(F.lit(raw))).first()[0] == (want if want is None else pytest.approx(want))
    assert row.select(text.parse_altitude(F.lit("see ."))).first()[0] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 3, 1.5, "extra")], "filename string, num_points int, surface_area double, more string")
    sinks.append_metadata(df, str(tmp_path / "m"), "r1")
    sinks.append_metadata(df, str(tmp_path / "m"), "r2")
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 2 and "more" not in back.columns and back.first()["centroid_x"] is None
    p = spark.createDataFrame([("m", 0, 0.0, 1.0, 2.5)], "mesh_id string, pid long, x double, y double, z double")
    assert sinks.ply_lines(p).first()["text"].endswith("0.000000 1.000000 2.500000\n")
    n = p.withColumns({c: F.lit(v) for c, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))})
    assert sinks.ply_lines(n).first()["text"] == "ply\nformat ascii 1.0\nelement vertex 1\n" + "".join(f"property float {c}\n" for c in ("x", "y", "z", "nx", "ny", "nz")) + "end_header\n0.000000 1.000000 2.500000 0.000000 0.000000 1.000000\n"
    scores = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "id string, pc array<double>")
    assert sinks.pca_table(scores, 2).columns == ["filename", "pc1", "pc2"] and tuple(sinks.pca_table(scores, 2).first()) == ("a", 1.0, 2.0)
    near = spark.createDataFrame([("a", 1, "b", 0.1234567)], "query string, rank int, neighbour string, distance double")
    assert tuple(sinks.neighbour_table(near).first()) == ("a", 1, "b", 0.12346) and sinks.neighbour_table(near).columns == ["query", "rank", "neighbor", "cosine_distance"]
    mix = spark.createDataFrame([("a", 0, 0.25), ("b", 0, 0.75), ("c", 0, 0.75), ("a", 1, 1.0)], "id string, k int, w double")
    assert {r["k"]: r["text"] for r in sinks.archetype_lines(mix, 2).collect()} == {0: "archetype 0\n  b  0.7500\n  c  0.7500", 1: "archetype 1\n  a  1.0000"}
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["more"] == "extra"
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["num_points"] == "3"
    m = spark.createDataFrame([(1, 2, 0.5)], "i long, j long, value double")
    assert [tuple(r) for r in sinks.wide_matrix(m, [1, 2]).collect()] == [(1, 1.0, 0.5), (2, 0.5, 1.0)]
    assert spark.range(1).select(sinks.bytes_of(F.lit(0.999))).first()[0] == 254


def test_embedders(spark, cube):
    pts = cube[0].withColumnRenamed("vid", "pid")
    got = embed.embed(pts).first()["embedding"]
    assert len(got) == embed.Descriptor().width
    with pytest.raises(RuntimeError, match="not installed"):
        embed.build("no_such_module_here:Model")


def test_archetypes_query_takes_the_defaults(spark):
    from knapline.plans import catalog, inputs

    data = "/root/testdata/sf0.001"
    rows = inputs.coords(spark, data).orderBy("id").collect()
    _, m = archetypes.analyse(np.array([[r["c1"], r["c2"], r["c3"]] for r in rows], float), 4, steps=500, restarts=3)
    got = {(r["id"], r["k"]): r["w"] for r in catalog.queries()["archetypes"](spark, data).collect()}
    assert len(got) == m.size and all(abs(got[r["id"], k] - m[i, k]) < 1e-4 for i, r in enumerate(rows) for k in range(4))


def box(spark, sizes, name="m"):
    return mesh(spark, [tuple(c * s for c, s in zip(p, sizes)) for p in CORNERS], TRIANGLES, name)


def test_six_views_of_a_box(spark):
    """The principal axes of a box are its sides: every view is a full rectangle at the nearest possible depth."""
    v, f = box(spark, (8, 4, 2))
    got = {r["view"]: r for r in views.six_views(v, f, canvas=101).groupBy("view").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("col") - F.min("col") + 1).alias("w"), (F.max("row") - F.min("row") + 1).alias("h")).collect()}
    assert got.keys() == {name for name, *_ in views.SIX}
    for name, ratio in (("pZ", 2), ("nZ", 2), ("pX", 2), ("nX", 2), ("pY", 4), ("nY", 4)):
        r = got[name]
        assert r["lo"] == r["hi"] == pytest.approx(1.0) and r["n"] == r["w"] * r["h"]
        assert abs(r["w"] - 85) <= 1 and abs(r["h"] - 85 / ratio) <= 1


def test_channels_of_a_box(spark):
    v, f = box(spark, (8, 4, 2))
    p = views.eight_channels(v, f, 10.0, 100, 60).toPandas()
    inside = p[(p["col"] > 12) & (p["col"] < 87) & (p["row"] > 12) & (p["row"] < 47)]
    assert len(p) == pytest.approx(80 * 40, abs=240) and inside["tz"].round(6).eq(1).all() and inside["bz"].round(6).eq(0).all()
    assert inside["opposing"].round(6).eq(1).all() and inside["thickness"].round(3).eq(round(1 - 1 / 255, 3)).all()
    q = views.seven_channels(v, f, 10.0, 100, 60)
    assert q.columns == ["mesh_id", "row", "col", "tx", "ty", "tz", "bx", "by", "bz", "depth"] and q.where("tz > 0.99").agg(F.min("depth"), F.max("depth")).first() == (1.0, 1.0)
    out = views.exported(q)
    assert out.where("depth = 255").count() > 0 and views.exported(q, q.select("mesh_id")).count() == 0


def test_chain_sets_failures_aside(spark):
    good = "point [0 0 0, 4 0 0, 0 3 0, 0 0 2] coordIndex [0 2 1 -1, 0 1 3 -1, 0 3 2 -1, 1 2 3 -1]"
    files = spark.createDataFrame([("good.wrl", good.encode()), ("sub/good.wrl", good.encode()), ("empty.wrl", b"nothing"), ("nofaces.wrl", b"point [0 0 0, 1 0 0, 0 1 0]"), ("flat.wrl", b"point [0 0 0, 1 0 0, 2 0 0] coordIndex [0 1 2 -1]")], "mesh_id string, content binary")
    about, vectors, failed = chain.process(files, points=64, mode="edge_aware")
    assert {r["mesh_id"] for r in vectors.collect()} == {"good.wrl", "sub/good.wrl"}
    assert {(r["filename"], r["stage"]) for r in failed.collect()} == {("empty.wrl", "load"), ("nofaces.wrl", "load"), ("flat.wrl", "clean")}
    rows = {r["mesh_id"]: r for r in about.collect()}
    assert rows["good.wrl"]["num_clean_faces"] == 4 and rows["flat.wrl"]["num_clean_faces"] == 0

    class Broken:
        width = 2

        def embed(self, points):
            return [float("nan"), 1.0] if points[:, 0].size == 64 else [0.0, 1.0]

    _, vectors, failed = chain.process(files, points=64, embedder=Broken())
    assert vectors.count() == 0 and {r["error"] for r in failed.where("stage = 'embed'").collect()} == {"not finite"}


def test_report_of_a_mesh(spark):
    v, f = box(spark, (8, 4, 2))
    stray = spark.createDataFrame([("m", 99, 50.0, 0.0, 0.0)], v.schema)
    r = chain.report(v.unionByName(stray), f, points=50).first()
    assert (r["num_original_vertices"], r["num_clean_vertices"], r["num_clean_faces"], r["ex"]) == (9, 8, 12, 50.0) and r["surface_area"] == pytest.approx(112)
    assert all(r[f"n_{m}"] == 50 and r[f"ok_{m}"] for m in chain.MODES) and r["status"] == "ok" and r["extent"] == pytest.approx(4 / math.sqrt(84))


def test_decimation_targets_are_of_each_mesh(spark):
    n = 40
    grid = [(x, y, math.sin(x / 3)) for y in range(n) for x in range(n)]
    tri = [t for y in range(n - 1) for x in range(n - 1) for t in ((y * n + x, y * n + x + 1, y * n + x + n), (y * n + x + 1, y * n + x + n + 1, y * n + x + n))]
    v, f = mesh(spark, grid, tri, "large")
    w, g = box(spark, (1, 1, 1), "small")
    faces = decimate.decimate(v.unionByName(w), f.unionByName(g), ratio=0.25)[1].groupBy("mesh_id").count().collect()
    got = {r["mesh_id"]: r["count"] for r in faces}
    assert got["small"] == 12 and 600 <= got["large"] <= len(tri) // 4


def test_named_files_and_a_folder(spark, tmp_path):
    for name in ("a.wrl", "sub/a.wrl", "sub/b.WRL"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("point [0 0 0]")
    one = str(tmp_path / "a.wrl")
    assert vrml.named(spark, [one, one], str(tmp_path)).count() == 5 and vrml.named(spark, [one]).first()["stem"] == "a"


def test_sites_are_ranked_without_one_task(spark):
    sites = spark.createDataFrame([(s,) for s in ("b", "a", "c", "a")], "site string")
    assert {r["site"]: r["rank"] for r in metadata.colours(sites).collect()} == {"a": 0, "b": 1, "c": 2}
    items = spark.createDataFrame([(1, "y"), (2, "x"), (3, None)], "id long, v string")
    assert {r["id"]: r["code"] for r in metadata.codes(items, "id", "v").collect()} == {1: 1.0, 2: 0.0, 3: None}


def test_faces_of_given_vertices(spark, tmp_path):
    """Faces stand where all corners do, each once, also where a row comes twice, and are dealt over as many tasks as the
    vertices ask for."""
    from knapline.plans import inputs

    keys = [k for m in range(3) for k in range(100 * m, 100 * m + 100) if (m, k % 100) not in ((0, 0), (1, 55))] + [142]
    spark.createDataFrame([(k, k % 7) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in inputs.faces(spark, str(tmp_path)).collect())
    want, have = [], set(keys)
    for m in range(3):
        for fid in range(162):
            o = fid // 2 // 9 * 10 + fid // 2 % 9
            abc = (o, o + 1, o + 10) if fid % 2 == 0 else (o + 1, o + 11, o + 10)
            if all(100 * m + k in have for k in abc):
                want.append((m, fid, *abc))
    assert got == want
    before, inputs.ROWS = inputs.ROWS, 20
    try:
        assert inputs.faces(spark, str(tmp_path)).rdd.getNumPartitions() == 15
    finally:
        inputs.ROWS = before


def test_orientation_within_rounding(spark):
    """A face in one plane with the mean of all, but for rounding, stays as it is."""
    z = 1e-12
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0), (1, 3, 5.0, 5.0, z), (1, 4, 6.0, 5.0, z), (1, 5, 5.0, 6.0, z)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 3, 4, 5)], "mesh_id long, fid long, a long, b long, c long")
    assert sorted(tuple(r)[1:] for r in geometry.orient_outward(v, f).collect()) == [(0, 0, 1, 2), (1, 3, 4, 5)]


@pytest.mark.parametrize("rows", ["7", "10000"])
def test_components_of_many_meshes_in_a_batch(spark, rows):
    """Meshes that batches part, of any kind of id, null included; no group of a task for each mesh."""
    rng = np.random.default_rng(3)
    v, f, want = [], [], set()
    for m in [None, *(f"m{k}" for k in range(12))]:
        n = int(rng.integers(3, 30))
        tri = [tuple(int(x) for x in rng.choice(n, 3, replace=False) - 5) for _ in range(n // 4)]
        v += [(m, k - 5, 0.0, 0.0, 0.0) for k in range(n)]
        f += [(m, i, *t) for i, t in enumerate(tri)]
        root = {k - 5: k - 5 for k in range(n)}
        for _ in range(n):
            for t in tri:
                root |= dict.fromkeys(t, min(root[x] for x in t))
        want |= {(m, k, root[k]) for k in root}
    v += [("m3", None, 0.0, 0.0, 0.0), ("none", None, 0.0, 0.0, 0.0)]
    want |= {("m3", None, None), ("none", None, None)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = geometry.components(spark.createDataFrame(v, "mesh_id string, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id string, fid long, a long, b long, c long"))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cleaning_sends_no_meshes_to_the_driver(spark, cube):
    """The ids of meshes with faces grow with the corpus: joined by a shuffle; orienting leaves numbers and vertices alone."""
    v, f = cube
    v = v.unionByName(spark.createDataFrame([("m", 99, 50.0, 0.0, 0.0), ("bare", 3, 0.0, 0.0, 0.0)], v.schema))
    for df in geometry.reindex(v, f):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    for largest in (True, False):
        w, g = geometry.clean_mesh(v, f, largest=largest)
        assert sorted(map(tuple, w.select("mesh_id", "vid").collect())) == [("bare", 0), *(("m", k) for k in range(8))]
        assert g.count() == 12 and {x for r in g.collect() for x in r[2:]} == set(range(8))


def test_report_measures_faces_once(spark, monkeypatch):
    """Samplers read one table of measured faces, and nothing that grows with the corpus is broadcast."""
    v, f = box(spark, (8, 4, 2))
    measured, calls = geometry.measured, []
    monkeypatch.setattr(geometry, "measured", lambda *a: calls.append(a) or measured(*a))
    out = chain.report(v, f, points=40)
    assert len(calls) == 4  # degenerate faces, orientation, samplers, area
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()
    assert all(r[f"n_{m}"] == 40 and r[f"ok_{m}"] for m in chain.MODES)
    monkeypatch.undo()
    for mode in ("uniform", "curvature", "edge"):
        rows = lambda p: sorted(tuple(x if isinstance(x, str) else round(x, 9) for x in r) for r in p.collect())
        assert rows(sampling.sample(v, f, 30, mode, m=settle(measured(v, f)), keep=settle)) == rows(sampling.sample(v, f, 30, mode))
