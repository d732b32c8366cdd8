"""Values of what has no SQL, against plain loops and known figures."""

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from knapline.operators import archetypes, contrast, decimate, geometry, images, knn, metadata, sampling, similarity, space
from knapline.operators.lineage import Scratch
from knapline.operators.ordinals import numbered
from knapline.operators.ward import merges_of
from knapline.sources import sinks, tables


@pytest.fixture(scope="module")
def box(spark):
    """A 4 x 2 x 1 box as points, turned about z by 30 degrees."""
    t = np.pi / 6
    corners = [(x, y, z) for x in (0, 4) for y in (0, 2) for z in (0, 1)]
    rows = [(1, i, float(x * np.cos(t) - y * np.sin(t)), float(x * np.sin(t) + y * np.cos(t)), float(z)) for i, (x, y, z) in enumerate(corners)]
    return spark.createDataFrame(rows, "mesh_id long, vid long, x double, y double, z double")


def grid(spark, n):
    v = [(1, i * n + j, float(i), float(j), float((i * j) % 3) / 10) for i in range(n) for j in range(n)]
    f = [(1, k, *t) for k, t in enumerate(t for i in range(n - 1) for j in range(n - 1) for t in ((i * n + j, i * n + j + 1, i * n + j + n), (i * n + j + 1, i * n + j + n + 1, i * n + j + n)))]
    return spark.createDataFrame(v, "mesh_id long, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, fid long, a long, b long, c long")


def test_extents_of_a_turned_box(box):
    (row,) = geometry.principal_extents(box).collect()
    assert [round(row[c], 9) for c in ("length", "width", "depth")] == [4.0, 2.0, 1.0]


def test_levels_of_detail(spark):
    v, f = grid(spark, 12)
    n = f.count()
    got = [(r["level"], r["n_vertices"], r["n_faces"]) for r in decimate.levels_of_detail(v, f, levels=3, least=40).orderBy("level").collect()]
    x, t = np.array([list(r) for r in v.orderBy("vid").select("x", "y", "z").collect()]), np.array([list(r) for r in f.orderBy("fid").select("a", "b", "c").collect()])
    want = []
    for target in geometry.lod_targets(n, 40, 3):
        x, t = decimate.collapse(x, t, target)
        want.append((len(want), len(x), len(t)))
    assert got == want and len(got) == 3
    assert all(c <= goal for (_, _, c), goal in zip(got, geometry.lod_targets(n, 40, 3), strict=True))
    assert decimate.levels_of_detail(v, f, levels=3, least=500).collect()[0]["n_faces"] == n


def test_collapse_in_cells_leaves_no_seams(spark):
    """A grid in cells: the goal is met, every edge belongs to one face or two, and the surface is still one disc."""
    v, f = grid(spark, 20)
    n = f.count()
    parts = spark.createDataFrame([(1, 250)], "mesh_id long, goal int")
    cv, cf = decimate.in_cells(v, f, parts, cell=200)
    assert cf.count() < n / 2
    dv, df = decimate.decimate(v, f, target=200, cell=200)
    for vs, fs, most in ((cv, cf, n), (dv, df, 200)):
        faces = [tuple(r) for r in fs.select("a", "b", "c").collect()]
        ids = {r["vid"] for r in vs.collect()}
        edges = {}
        for t in faces:
            assert len(set(t)) == 3 and set(t) <= ids
            for i in range(3):
                e = tuple(sorted((t[i], t[i - 1])))
                edges[e] = edges.get(e, 0) + 1
        assert len(faces) <= most and set(edges.values()) <= {1, 2}
        assert len(ids) - len(edges) + len(faces) == 1
        assert len({r["component"] for r in geometry.components(vs, fs).collect()}) == 1


def ward(x):
    """Leaf order by merging, at each step, the two clusters whose union adds least to the sum of squares."""
    live = [[i] for i in range(len(x))]
    scatter = lambda c: float(((x[c] - x[c].mean(axis=0)) ** 2).sum())
    while len(live) > 1:
        _, i, j = min((round(scatter(a + b) - scatter(a) - scatter(b), 9), i, j) for i, a in enumerate(live) for j, b in enumerate(live) if i < j)
        live[i] = live[i] + live.pop(j)
    return live[0]


def test_ward_order(spark):
    x = np.random.default_rng(3).normal(size=(25, 3))
    df = spark.createDataFrame([(100 + i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = [r["id"] - 100 for r in similarity.ward_order(df).orderBy("pos").collect()]
    assert got == ward(x)
    assert similarity.ward_order(df.limit(0)).count() == 0
    assert [tuple(r) for r in similarity.ward_order(df.where("id = 107")).collect()] == [(0, 107)]


def test_ward_order_by_rounds(spark):
    """Rounds of reciprocal neighbours give the tree of merging one pair at a time, copies of rows included."""
    x = np.random.default_rng(4).normal(size=(24, 3))
    x[16:20] = x[:4]
    df = spark.createDataFrame([(100 + i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    got = [r["id"] - 100 for r in similarity.ward_order(df, finish=5).orderBy("pos").collect()]
    assert got == ward(x)


def test_ward_order_of_many_rows(spark):
    """More rows than one task merges: the same order as one pair at a time."""
    x = np.random.default_rng(5).normal(size=(1_200, 8))
    df = spark.createDataFrame(pd.DataFrame({"id": range(1_200), "v": x.tolist()})).select("id", "v")
    leaves = {i: [i] for i in range(1_200)}
    for a, _, b, _ in merges_of(list(range(1_200)), np.ones(1_200), x):
        leaves[a] += leaves.pop(b)
    assert [r["id"] for r in similarity.ward_order(df, finish=800).orderBy("pos").collect()] == leaves[0]


@pytest.mark.parametrize("block", [7, 512])
def test_matrices_by_blocks(spark, block):
    x = np.random.default_rng(6).normal(size=(40, 5))
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(np.random.default_rng(7).permutation(40), x, strict=True)], "id long, v array<double>")
    rows = {r["id"]: np.array(r["v"]) for r in df.collect()}
    got = {(r["i"], r["j"]): r["value"] for r in similarity._products(df, block).collect()}
    assert got.keys() == {(i, j) for i in rows for j in rows if i < j}
    assert all(v == pytest.approx(float(rows[i] @ rows[j])) for (i, j), v in got.items())
    assert similarity._products(df, block).count() == len(got)
    r = {(p["i"], p["j"]): p["value"] for p in similarity.pearson_matrix(df).collect()}
    assert all(v == pytest.approx(np.corrcoef(rows[i], rows[j])[0, 1]) for (i, j), v in r.items())
    assert similarity.cosine_matrix(df.limit(0)).count() == 0


def test_split_batches_masks(spark):
    items = spark.range(103).select(F.col("id").alias("k"))
    parts = {r["part"]: r["count"] for r in sampling.split(items, "k").groupBy("part").count().collect()}
    assert parts == {"val": 15, "train": 88}
    again = sampling.split(items.repartition(3), "k").where("part = 'val'")
    assert {r["k"] for r in again.collect()} == {r["k"] for r in sampling.split(items, "k").where("part = 'val'").collect()}
    assert sampling.split(items.limit(3), "k").where("part = 'val'").count() == 1
    dealt = sampling.batches(items, "k").collect()
    assert np.bincount([r["batch"] for r in dealt]).tolist() == [16] * 6 + [7] and {r["k"] for r in dealt} == set(range(103))
    assert np.bincount([r["batch"] for r in sampling.batches(items.limit(97), "k").collect()]).tolist() == [16] * 6
    twice = sampling.split(items.unionAll(items), "k")
    assert twice.count() == 206 and twice.groupBy("k").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    groups = spark.range(5).crossJoin(spark.range(13).select(F.col("id").alias("g"))).select(F.col("id").alias("mesh_id"), "g")
    masked = sampling.mask_groups(groups, "mesh_id").groupBy("mesh_id").agg(F.count_if("masked").alias("n"), F.count("*").alias("all")).collect()
    assert {(r["n"], r["all"]) for r in masked} == {(7, 13)}
    drawn = [{r["g"] for r in sampling.mask_groups(groups, "mesh_id").where(f"masked and mesh_id = {m}").collect()} for m in (0, 1)]
    assert drawn[0] != drawn[1]


def test_patches_against_loops(spark):
    x = np.random.default_rng(8).normal(size=(30, 3))
    p = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(x)], "mesh_id long, pid long, x double, y double, z double")
    c = sampling.farthest(p, 5)
    picked, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < 5:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    assert [r["pid"] for r in c.orderBy("g").collect()] == picked
    for r in sampling.patches(p, c, 4).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k_rank", "pid"))).alias("l")).collect():
        d = ((x - x[picked[r["g"]]]) ** 2).sum(axis=1)
        assert [n["pid"] for n in r["l"]] == np.argsort(d, kind="stable")[:4].tolist()


def test_nearest_against_loops(spark):
    """Clusters, copies of places, a flat key, keys without points or with fewer than k; one cell a key and many."""
    r = np.random.default_rng(1)
    points = []
    for key, n in (("a", 300), ("b", 3), ("c", 200)):
        x = np.repeat(r.normal(size=(20, 3)), 10, axis=0) * [1, 1, 0] if key == "c" else r.normal(size=(n, 3))
        if key == "a":
            x[:150] *= 0.001
        points += [(key, i, *map(float, v)) for i, v in enumerate(x)]
    queries = [(k, i, *(np.array(v) + r.normal(size=3) * 0.5).tolist()) for k, i, *v in points[::3]] + [("none", 1, 0.0, 0.0, 0.0)]
    want = [(k, q, n + 1, p) for k, q, *v in queries for n, (_, p) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), p) for key, p, *w in points if key == k)[:4])]
    p, q = (spark.createDataFrame(t, f"key string, {n} long, x double, y double, z double") for t, n in ((points, "p"), (queries, "q")))
    for cell in (16, 1024):
        assert sorted(map(tuple, space.nearest(q, p, 4, cell).select("key", "q", "rank", "p").collect())) == sorted(want)
    odd = spark.createDataFrame([("a", None, 1.0, 1.0, 1.0), ("a", 1, None, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0), ("a", 2, float("nan"), 1.0, 1.0)], "key string, q long, x double, y double, z double")
    assert space.nearest(odd, p, 2).count() == 0 and space.nearest(q, p.limit(0), 2).count() == 0


def unit_rows(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0)


def test_pruned_neighbours_are_exact(spark):
    """Clustered vectors, copies and zero rows: the rows of comparing all with all, by a share of the blocks."""
    r = np.random.default_rng(12)
    x = np.repeat(r.normal(size=(12, 6)) * 3, 30, axis=0) + r.normal(size=(360, 6)) * 0.05
    x[5], x[6], x[200:240] = 0, 0, x[100]
    ids = r.permutation(360)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>").repartition(3)
    x = x[np.argsort(ids)]
    for cosine in (True, False):
        y = unit_rows(x) if cosine else x
        d = 1 - y @ y.T if cosine else np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        d = np.round(d, 7)
        want = {(q, n + 1): d[q, i] for q in range(360) for n, i in enumerate(np.argsort(d[q], kind="stable")[:4])}
        v = similarity.unit(df) if cosine else df
        got = {(t["query"], t["rank"]): t for t in knn.nearest(v, 4, cosine, block=30).collect()}
        assert got.keys() == want.keys() and all(abs(t["distance"] - want[k]) < 1e-6 for k, t in got.items())
        assert all(abs(d[t["query"], t["neighbour"]] - t["distance"]) < 1e-6 for t in got.values())
        one = {(t["query"], t["rank"]): round(t["distance"], 6) for t in knn.nearest(v, 4, cosine).collect()}
        assert one == {k: round(t["distance"], 6) for k, t in got.items()}
    assert knn.nearest(df.limit(0), 3).count() == 0


def test_pivots_skip_blocks(spark):
    r = np.random.default_rng(13)
    x = np.repeat(r.normal(size=(20, 8)) * 5, 50, axis=0) + r.normal(size=(1000, 8)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    with Scratch(spark) as scratch:
        p = knn.Pivots(df, 1000, 50, False, scratch)
        visited = p.visits(p.dealt.withColumn("reach", F.lit(0.5))).count()
    assert len(p.pivots) == 20 and visited < 0.3 * 1000 * (sum(p.chunks) - 1)


def test_fuzzy_graph(spark):
    r = np.random.default_rng(14)
    x = r.normal(size=(80, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    rows = knn.directed(knn.nearest(similarity.scaled(df), 14, cosine=False), 15).collect()
    sums = np.bincount([t["query"] for t in rows], [t["w"] for t in rows])
    assert np.allclose(sums, np.log2(15), atol=1e-4)
    want = np.zeros((80, 80))
    for i in range(80):
        near = np.argsort(d[i], kind="stable")[1:15]
        want[i, near] = knn.weights_of(d[i, near][None, :], np.log2(15))[0]
        assert want[i, near[0]] == 1
    both = want + want.T - want * want.T
    got = {(t["i"], t["j"]): t["w"] for t in similarity.fuzzy_graph(df, 15).collect()}
    assert got.keys() == {(i, j) for i, j in zip(*np.nonzero(both), strict=True) if i < j} and all(abs(w - both[k]) < 1e-6 for k, w in got.items())
    assert similarity.fuzzy_graph(df.limit(0)).count() == 0
    # Copies have no bandwidth of their own; a row of them alone weighs each fully.
    assert knn.weights_of(np.zeros((1, 3)), 2.0).tolist() == [[1, 1, 1]]
    a, b = knn.curve(0.1)
    assert (round(a, 2), round(b, 2)) == (1.58, 0.9)


def test_layout_parts_what_the_graph_parts(spark):
    r = np.random.default_rng(15)
    x = np.concatenate([r.normal(size=(20, 4)), r.normal(size=(20, 4)) + 12])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    start = spark.createDataFrame([(i, *map(float, r.normal(size=2))) for i in range(40)], "id long, u1 double, u2 double")
    graph = similarity.fuzzy_graph(df, 10)
    assert graph.where("(i < 20) <> (j < 20)").count() == 0
    before = start.orderBy("id").toPandas()[["u1", "u2"]].to_numpy()
    after = knn.layout(graph, start, epochs=12).orderBy("id").toPandas()[["u1", "u2"]].to_numpy()

    def linked(u):
        """How far linked rows lie apart, as a share of what rows of different groups do."""
        far = lambda i, j: float(np.linalg.norm(u[i] - u[j]))
        return np.mean([far(t["i"], t["j"]) for t in graph.collect()]) / np.mean([far(i, j) for i in range(20) for j in range(20, 40)])

    assert linked(after) < 0.92 * linked(before)
    one, two = (knn.layout(g, p, epochs=2).orderBy("id").toPandas()[["u1", "u2"]].to_numpy() for g, p in ((graph, start), (graph.repartition(7), start.repartition(3))))
    assert np.allclose(one, two)
    assert knn.layout(graph.limit(0), start.limit(1)).count() == 1


def test_layout_takes_all_epochs(spark, monkeypatch):
    """Without a number 500 epochs up to 10,000 rows, in the query too; blocks of rows and chunks of their edges give what one task does."""
    from knapline.plans import catalog

    r = np.random.default_rng(17)
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 4)))], "id long, v array<double>")
    start = spark.createDataFrame([(3 * i, *map(float, r.normal(size=2))) for i in range(61)], "id long, u1 double, u2 double")
    graph = similarity.fuzzy_graph(df, 8).localCheckpoint()
    table = lambda u: u.orderBy("id").toPandas()[["u1", "u2"]].to_numpy()
    whole = table(knn.layout(graph, start))
    assert np.array_equal(whole, table(knn.layout(graph, start, epochs=500))) and not np.allclose(whole, table(knn.layout(graph, start, epochs=100)))
    few = table(knn.layout(graph, start, epochs=6))
    assert np.array_equal(few, table(knn.layout(graph, start, epochs=6, one_task=0)))
    monkeypatch.setattr(knn, "ROWS", 7)
    monkeypatch.setattr(knn, "EDGES", 50)
    assert np.allclose(few, table(knn.layout(graph, start, epochs=6, one_task=0)))
    asked = []
    monkeypatch.setattr(knn, "_in_one_task", lambda pos, edges, epochs, *rest: asked.append(epochs) or pos.select("id", "u1", "u2"))
    assert catalog.queries()["umap_layout"](spark, "/root/testdata/sf0.001").count() == 500 and asked == [500]


def test_contrastive_gradient():
    r = np.random.default_rng(16)
    w, a, b = r.normal(size=(5, 3)), r.normal(size=(6, 5)), r.normal(size=(6, 5))
    loss, grad = contrast.loss_and_gradient(w, a, b, 0.5)
    z = np.concatenate([a, b]) @ w
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = np.mean([-np.log(np.exp(z[i] @ z[(i + 6) % 12] / 0.5) / sum(np.exp(z[i] @ z[j] / 0.5) for j in range(12) if j != i)) for i in range(12)])
    assert loss == pytest.approx(want)
    for i in range(5):
        for j in range(3):
            e = np.zeros_like(w)
            e[i, j] = 1e-6
            slope = (contrast.loss_and_gradient(w + e, a, b, 0.5)[0] - contrast.loss_and_gradient(w - e, a, b, 0.5)[0]) / 2e-6
            assert grad[i, j] == pytest.approx(slope, abs=1e-6)


def test_contrastive_epochs(spark):
    """Gradients summed over tasks are those of the batches, and the loss falls; one row an epoch."""
    r = np.random.default_rng(17)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(101, 8)))], "id long, v array<double>")
    pairs = contrast.views(df).repartition(3)
    rows = {t["id"]: (np.array(t["a"]), np.array(t["b"])) for t in pairs.collect()}
    w = r.normal(size=(8, 4))
    loss, grad, n = contrast._pass(pairs, w, 1, 16, 0.07)
    groups = {}
    for t in sampling.batches(pairs.select("id"), "id", 16, 1).orderBy("id").collect():
        groups.setdefault(t["batch"], []).append(rows[t["id"]])
    each = [contrast.loss_and_gradient(w, np.array([a for a, _ in g]), np.array([b for _, b in g])) for g in groups.values()]
    assert n == len(groups) == 7 and loss == pytest.approx(sum(x for x, _ in each)) and np.allclose(grad, sum(g for _, g in each))
    _, losses = contrast.train(pairs, width=4, epochs=4, rate=0.1)
    losses = [t["loss"] for t in losses.orderBy("epoch").collect()]
    assert len(losses) == 4 and losses[-1] < 0.9 * losses[0]
    assert contrast.train(pairs.limit(0), epochs=2)[1].count() == 0


def test_farthest_points_over_tasks(spark):
    """A cloud that all tasks share gives the points that one task finds, ties and copies included."""
    r = np.random.default_rng(9)
    rows = [(m, i, *map(float, x)) for m in (1, 2, 3) for i, x in enumerate(r.integers(0, 4, (60 * m, 3)) if m == 2 else r.normal(size=(60 * m, 3)))]
    p = spark.createDataFrame(rows, "mesh_id long, pid long, x double, y double, z double").repartition(5)
    one = sorted(map(tuple, sampling.farthest(p, 12).collect()))
    assert sorted(map(tuple, sampling.farthest(p, 12, large=100).collect())) == one and len(one) == 36


def test_components_over_tasks(spark):
    """Meshes of several pieces, paths in an awkward order among them, shared by all tasks."""
    r = np.random.default_rng(10)
    faces = [(1, i, *map(int, f)) for i, f in enumerate(r.integers(0, 120, (70, 3)))]
    path = r.permutation(90)
    faces += [(2, i, int(path[i]), int(path[i + 1]), int(path[i + 1])) for i in range(89) if i != 44] + [(3, 0, 0, 1, 2)]
    v = spark.createDataFrame([(m, i, 0.0, 0.0, 0.0) for m, n in ((1, 120), (2, 90), (3, 5)) for i in range(n)], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame(faces, "mesh_id long, fid long, a long, b long, c long").repartition(4)
    one = sorted(map(tuple, geometry.components(v, f).collect()))
    assert sorted(map(tuple, geometry.components(v, f, large=10).collect())) == one and len({t[::2] for t in one if t[0] == 2}) == 2


def test_components_of_a_million_faces(spark):
    """One mesh of two grids that don't touch, a million faces in all, without one group a mesh."""
    n = 500  # quads a side
    at = lambda g, i, j: g * (n + 1) ** 2 + i * (n + 1) + j
    cells = spark.range(2 * n * n).selectExpr("1L as mesh_id", "id as fid", f"id div {n * n} as g", f"id div {n} % {n} as i", f"id % {n} as j")
    corner = lambda di, dj: at(F.col("g"), F.col("i") + di, F.col("j") + dj).cast("long")
    f = cells.select("mesh_id", F.explode(F.array(F.struct(corner(0, 0).alias("a"), corner(0, 1).alias("b"), corner(1, 0).alias("c")), F.struct(corner(0, 1).alias("a"), corner(1, 1).alias("b"), corner(1, 0).alias("c")))).alias("t"), "fid").select("mesh_id", "fid", "t.*")
    v = spark.range(2 * (n + 1) ** 2).selectExpr("1L as mesh_id", "id as vid")
    got = geometry.components(v, f).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {(0, (n + 1) ** 2), ((n + 1) ** 2, (n + 1) ** 2)}


def test_tiles_draw_the_same_pixels(spark):
    """Whatever the size of the squares, also where faces lie across their borders, off the canvas or on top of others."""
    r = np.random.default_rng(11)
    rows = [(m, i, float(r.integers(0, 5)), *(r.uniform(-20, 90, 2).repeat(3).reshape(2, 3).T + r.normal(size=(3, 2)) * 15).ravel().tolist(), float(i)) for m in (1, 2) for i in range(60)]
    px = spark.createDataFrame(rows, "mesh_id long, fid long, order double, ax double, ay double, bx double, by double, cx double, cy double, v double")
    drawn = [sorted(map(tuple, images.render(px, 61, 75, ["v"], "top", tile).collect())) for tile in (1_000, 32, 7)]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) > 1_000
    t = [x for x in sorted(rows, key=lambda x: (x[2], x[1])) if x[0] == 1]
    whole = images.fill_triangles(np.array([x[3:9] for x in t]).reshape(-1, 3, 2), np.array([[x[9] + 1] for x in t]), 61, 75)[:, :, 0]
    assert {(x[2], x[3]): x[4] + 1 for x in drawn[0] if x[0] == 1} == {(i, j): whole[i, j] for i, j in zip(*np.nonzero(whole), strict=True)}


def test_samples_against_inverse_weights(spark, tmp_path):
    """Each point lies on the face that its random number picks from the cumulated weights, at the place that two more give."""
    v, f = grid(spark, 5)
    with_flat = f.unionByName(spark.createDataFrame([(1, 1000, 0, 0, 1)], f.schema))
    for mode in ("uniform", "curvature", "edge"):
        got = sampling.sample(v, with_flat, 40, mode, seed=3).orderBy("pid").toPandas()
        w = sampling.weights(v, with_flat, mode).where("w > 0").orderBy("fid").toPandas()
        draw = lambda k: sampling.uniform(F.lit(1).cast("long"), F.col("pid"), F.lit(3 + k))
        draws = spark.range(40).select(F.col("id").cast("int").alias("pid")).select("pid", *(draw(k).alias(f"u{k}") for k in range(3))).orderBy("pid").toPandas()
        x = np.array([list(t) for t in v.orderBy("vid").select("x", "y", "z").collect()])
        corners = {t["fid"]: x[[t["a"], t["b"], t["c"]]] for t in f.collect()}
        upto = np.cumsum(w["w"])
        assert upto.iloc[-1] == pytest.approx(1) and len(got) == 40
        for k, t in draws.iterrows():
            a, b, c = corners[w["fid"].iloc[min(int(np.searchsorted(upto, t["u0"], side="right")), len(w) - 1)]]
            root = t["u1"] ** 0.5
            want = (1 - root) * a + root * (1 - t["u2"]) * b + root * t["u2"] * c
            assert got.loc[k, ["x", "y", "z"]].to_numpy(float) == pytest.approx(want, abs=1e-9)
            normal = np.cross(b - a, c - a)
            assert got.loc[k, ["nx", "ny", "nz"]].to_numpy(float) == pytest.approx(normal / np.linalg.norm(normal))
    for points in (40, 20):
        sinks.write_clouds(sampling.sample(v, f, points), str(tmp_path / "clouds"), "one")
    sinks.write_clouds(sampling.sample(v, f, 5), str(tmp_path / "clouds"), "two")
    back = spark.read.parquet(str(tmp_path / "clouds"))
    assert {(r["run_id"], r["count"]) for r in back.groupBy("run_id").count().collect()} == {("one", 20), ("two", 5)} and dict(back.dtypes)["x"] == "float"


def test_ranks_at_any_size(spark):
    """400,000 rows with repeated names, over partitions that are coalesced: gapless, in order, and codes by distinct names."""
    df = spark.range(400_000).select("id", F.concat(F.lit("s"), (F.xxhash64("id") % 350_000).cast("string")).alias("stem")).repartition(7)
    got = sinks.consolidated(df).toPandas()
    assert sorted(got["ord"]) == list(range(400_000)) and got.sort_values("ord")["stem"].is_monotonic_increasing
    coded = metadata.codes(df, "id", "stem").join(df, "id").select("stem", "code").distinct().toPandas()
    names = sorted(coded["stem"])
    assert len(coded) == len(names) and coded.set_index("stem").loc[names, "code"].tolist() == list(range(len(names)))
    ranks = metadata.colours(df.select(F.col("stem").alias("site"))).toPandas().set_index("site")
    assert ranks.loc[names, "rank"].tolist() == list(range(len(names)))


def test_numbered_within_keys(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate([(None, 1), ("a", 3), ("a", None), ("", 2), ("a", 3), (None, None), ("b", 1)] * 30)]
    got = numbered(spark.createDataFrame(rows, "k string, v int, i int").repartition(5), ["v"], ["k"], total="n").toPandas()
    for _, g in got.groupby("k", dropna=False):
        assert sorted(g["ord"]) == list(range(len(g))) and set(g["n"]) == {len(g)}
        assert g.sort_values("ord")["v"].fillna(-1).is_monotonic_increasing
    assert len(got) == 210 and numbered(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_archetypes_in_blocks(spark, monkeypatch):
    """Passes over blocks give what the analysis of all rows at once gives, steps and restarts included."""
    monkeypatch.setattr(archetypes, "BLOCK", 256)
    monkeypatch.setattr(archetypes, "EVERY", 7)
    r = np.random.default_rng(3)
    x = r.dirichlet([0.6] * 4, size=1_500) @ np.array([[0, 0, 0], [4, 0, 1], [0, 5, 0], [1, 1, 6.0]]) + r.normal(size=(1_500, 3)) * 0.2
    ids = r.permutation(1_500)
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})).repartition(3)
    z, m = archetypes.analyse(x[np.argsort(ids)], 4, 20, 2)
    for one_task in (0, 10_000):
        tips, mix = archetypes.archetypes(df, ["a", "b", "c"], steps=20, restarts=2, one_task=one_task)
        assert np.allclose([t[1:] for t in sorted(map(tuple, tips.collect()))], z, atol=1e-6)
        assert np.allclose(mix.toPandas().pivot(index="id", columns="k", values="w").to_numpy(), m, atol=1e-6)
    assert archetypes.archetypes(df.limit(0), ["a", "b", "c"])[1].count() == 0


def test_blocks_are_dealt_evenly(spark):
    """Blocks from a table of one file are worked on by all tasks, and no more than two generations of them are held."""
    z = np.arange(24.0).reshape(8, 3)
    table = spark.createDataFrame([(b, bytearray(z.tobytes()), None, bytearray(b"")) for b in range(8)], archetypes.PACKED).coalesce(1)
    blocks = archetypes.Blocks(table, 3, 2, 4, 4)
    assert blocks.packed.glom().map(len).collect() == [2] * 4
    tips = np.ones((2, 4, 3))
    for _ in range(3):
        blocks.advanced([tips], None)
    assert len(blocks.held) == 2 and blocks.at == 3 and blocks.gradients([tips], None)[0].shape == (2, 4, 3)
    blocks.drop()


def test_archetypes_of_a_million_rows(spark):
    """A million rows in blocks: no collect of rows, the driver's largest result stays a few numbers a task."""
    df = spark.range(1_000_000).select("id", *(F.rand(s).alias(c) for s, c in enumerate("abc")))
    tips, mix = archetypes.archetypes(df, ["a", "b", "c"], steps=2, restarts=1)
    assert tips.count() == 4 and mix.count() == 4_000_000
    assert mix.groupBy("id").agg(F.sum("w").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def png(pixels):
    h, w, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    big = np.random.default_rng(2).integers(0, 256, (224, 224, 3), dtype=np.uint8)
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "large.png").write_bytes(png(big))
    whole = tables.images(spark, str(tmp_path / "big")).toPandas().sort_values(["row", "col", "channel"])
    assert np.allclose(whole["value"].to_numpy().reshape(224, 224, 3) * 255, big)
    (tmp_path / "big" / "large.png").unlink()
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3) * 14
    (tmp_path / "stone.top.png").write_bytes(png(pixels))
    got = tables.images(spark, str(tmp_path)).collect()
    assert {(r["stem"], r["height"], r["width"]) for r in got} == {("stone.top", 2, 3)}
    assert {(r["row"], r["col"], r["channel"]): round(r["value"] * 255) for r in got} == {(i, j, k): int(pixels[i, j, k]) for i in range(2) for j in range(3) for k in range(3)}


def test_small_files(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("stem,height\na,1.5\nb,\n")
    assert [tuple(r) for r in tables.metadata_csv(spark, str(tmp_path / "meta.csv"), "stem string, height double").orderBy("stem").collect()] == [("a", 1.5), ("b", None)]
    (tmp_path / "scale.json").write_text(json.dumps({"scale": 2.5, "canvas_W": 30, "canvas_H": 40, "max_z_range": 7.0}, indent=1))
    (tmp_path / "scale.txt").write_text(" 2.25\n")
    assert [tuple(r) for r in tables.scale_json(spark, str(tmp_path / "scale.json")).collect()] == [(2.5, 30, 40, 7.0)]
    assert [tuple(r) for r in tables.scale_json(spark, str(tmp_path / "scale.txt")).collect()] == [(2.25, None, None, 1.0)]
    (tmp_path / "dims.json").write_text(json.dumps({"a": [3, 2, 1], "b": [6.5, 5, 4]}))
    assert sorted(tuple(r) for r in tables.dims_json(spark, str(tmp_path / "dims.json")).collect()) == [("a", 3.0, 2.0, 1.0), ("b", 6.5, 5.0, 4.0)]
    rows = spark.createDataFrame([(1, 1, 2, 0.1234567), (1, 2, 3, 0.5)], "query long, rank int, neighbour long, distance double")
    sinks.write_csv(sinks.neighbour_table(rows), str(tmp_path / "nn"))
    back = spark.read.csv(str(tmp_path / "nn"), header=True).orderBy("rank").collect()
    assert [tuple(r) for r in back] == [("1", "1", "2", "0.12346"), ("1", "2", "3", "0.5")] and back[0].asDict().keys() == {"query", "rank", "neighbor", "cosine_distance"}
    sinks.write_json(rows, str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(str(tmp_path / "json")).collect())) == sorted(map(tuple, rows.collect()))


def test_matrices_of_many_blocks(spark):
    """Every pair of rows once, whatever block they stand in, also next to rows with equal ids, and vectors shuffled once."""
    from knapline.operators import similarity

    rng = np.random.default_rng(5)
    x = rng.normal(size=(83, 5))
    x[7] = 0
    ids = [int(i) for i in rng.permutation(83)]
    v = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "id long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    got = {(r["i"], r["j"]): r["value"] for r in similarity._products(v, 10, similarity._unit_rows).collect()}
    assert set(got) == {(i, j) for i in range(83) for j in range(i + 1, 83)}
    assert max(abs(got[i, j] - u[i] @ u[j]) for i, j in got) < 1e-12
    off = np.abs(u @ u.T)[~np.eye(83, dtype=bool)].max()
    assert similarity.largest_cosine(v, size=10).groupBy().max("value").first()[0] == pytest.approx(off, abs=1e-12)
    again = similarity._products(v.unionByName(v.where("id = 40")), 10, similarity._unit_rows)
    assert again.count() == 83 * 82 // 2 + 82 and not again.where("i >= j").count()
    plan = similarity.cosine_matrix(v)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan


@pytest.mark.parametrize("matrix", [similarity.cosine_matrix, similarity.pearson_matrix])
def test_matrices_take_few_bytes_a_pair(spark, tmp_path, matrix):
    """Rounded values recur where a writer looks for it: no column is left at eight bytes a pair."""
    import pyarrow.parquet as pq

    x = np.random.default_rng(12).normal(size=(700, 64))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    matrix(v, places=5).write.parquet(str(tmp_path / "out"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    columns = [m.row_group(g).column(c) for m in files for g in range(m.num_row_groups) for c in range(3)]
    assert sum(m.num_rows for m in files) == 700 * 699 // 2
    assert sum(c.total_compressed_size for c in columns) < 5 * 700 * 699 // 2


def test_neighbours_of_some_queries(spark):
    """The asked rows' neighbours among all rows, over many blocks, as plain loops find them; vectors are shuffled once."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(230, 4)), np.zeros((2, 4)), rng.normal(size=(1, 4)).repeat(12, 0)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for cosine in (True, False):
        v = similarity.unit(df) if cosine else df
        y = np.array([r["v"] for r in v.orderBy("id").collect()])
        d = 1 - y @ y.T if cosine else np.sqrt(((y[:, None] - y[None, :]) ** 2).sum(axis=2))
        got = {}
        for r in knn.nearest(v, 4, cosine=cosine, block=20, queries=F.col("id") % 10 == 0).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["neighbour"], r["distance"]))
        assert set(got) == set(range(0, len(x), 10))
        for q, found in got.items():
            want = sorted((round(float(d[q, j]), 6), j) for j in range(len(x)) if j != q)[:4]
            assert [round(e, 6) for _, e in found] == pytest.approx([e for e, _ in want], abs=2e-6)
            assert len({j for j, _ in found}) == 4 and q not in {j for j, _ in found}


def test_ward_search_by_blocks(spark, monkeypatch):
    """Each seeking cluster's best among all, over many blocks; no block is shuffled for each meeting."""
    from knapline.operators import ward
    from knapline.operators.lineage import settle

    monkeypatch.setattr(ward, "BLOCK", 9)
    rng = np.random.default_rng(3)
    x, size = rng.normal(size=(70, 3)), rng.integers(1, 5, 70)
    now = spark.createDataFrame([(i, int(size[i]), x[i].tolist()) for i in range(70)], "slot long, size long, c array<double>")
    found = ward._search(now.where("slot % 3 = 0"), now, (24, 70), "bigint", settle)
    d = ward.cost(size[:, None], size[None, :], ((x[:, None] - x[None, :]) ** 2).sum(axis=2)) + np.diag([np.inf] * 70)
    assert {r["slot"]: r["near"] for r in found.collect()} == {i: int(d[i].argmin()) for i in range(0, 70, 3)}
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()


def test_ward_blocks_reach_a_task_once(spark, monkeypatch):
    """Every block meets every other, but its contents go to a task once, not once a meeting."""
    from knapline.operators import blocks, ward

    monkeypatch.setattr(ward, "BLOCK", 9)
    now = spark.createDataFrame([(i, 1, [float(i)]) for i in range(198)], "slot long, size long, c array<double>").repartition(1)
    met = ward._meetings(ward._packed(now, "bigint"), ward._packed(now, "bigint"), (22, 22)).cache()
    assert met.where("again").select("b", "ob").distinct().count() == met.where("again").count() == 22 * 22
    assert met.where("x is not null").count() == met.where("ox is not null").count() == 22 * blocks.parts(22)


@pytest.mark.parametrize("scale", [1e-30, 1e-3, 1.0, 1e20])
def test_ward_screen_in_single_precision(scale):
    """What the screen leaves holds each cluster's best among others of other sizes, copies and equal costs included."""
    from knapline.operators import ward

    rng = np.random.default_rng(8)
    x, size = rng.normal(size=(300, 6)) * scale, rng.integers(1, 40, 300).astype(float)
    x[200:220], size[200:220] = x[100:120], size[100:120]
    slots = rng.permutation(300)
    d = ward.cost(size[:, None], size[None, :], 1.0) * ((x[:, None] - x[None, :]) ** 2).sum(axis=2) + np.diag([np.inf] * 300)
    bound = np.sort(d, axis=1)[:, 3]
    row, near, far = ward._closer(slots, size, x, bound, slots, size, x)
    assert row.tolist() == list(range(300)) and np.array_equal(far, d.min(axis=1))
    assert near.tolist() == [min(slots[d[i] == d[i].min()]) for i in range(300)]


def test_ward_merges_as_by_the_least_of_all(spark):
    """Remembered row minima choose as a search of the whole matrix does, of equal pairs the first."""
    rng = np.random.default_rng(9)
    x, size = rng.integers(0, 4, size=(90, 2)).astype(float), rng.integers(1, 3, 90)
    live, got = {i: (int(size[i]), x[i]) for i in range(90)}, []
    g, s = (x * x).sum(axis=1), size.astype(float)
    d = 2 * s[:, None] * s[None] / (s[:, None] + s[None]) * np.maximum(g[:, None] + g[None] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    while len(live) > 1:
        i, j = divmod(int(d.argmin()), 90)
        got.append((i, int(s[i]), j, int(s[j])))
        new = ((s[i] + s) * d[i] + (s[j] + s) * d[j] - s * d[i, j]) / (s[i] + s[j] + s)
        new[[k for k in range(90) if k not in live or k in (i, j)]] = np.inf
        d[i] = d[:, i] = new
        d[j] = d[:, j] = np.inf
        s[i] += s[j]
        del live[j]
    assert merges_of(list(range(90)), size, x) == got


def test_six_view_means_are_those_of_the_pixels(spark):
    """Means added up where they are drawn are those of the pixels themselves; faces are measured once for all views."""
    from knapline.operators import views
    from knapline.plans import inputs

    v, f = inputs.mesh(spark, "/root/testdata/sf0.001")
    own = views.six_views(v, f, 40).groupBy("mesh_id", "view").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    want = {(r["mesh_id"], r["view"]): (r["n"], r["mean"]) for r in own.collect()}
    means = views.six_view_means(v, f, 40)
    got = {(r["mesh_id"], r["view"]): (r["n"], r["mean"]) for r in means.collect()}
    assert got.keys() == want.keys() and len({k[1] for k in got}) == 6
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in got)
    assert views._six(v, f, 40, True).count() == 6 * f.count()


def test_covering_in_parts(monkeypatch):
    """Triangles looked at together or one after another: the last that holds a pixel's centre wins."""
    t = np.random.default_rng(2).uniform(-5, 45, (60, 3, 2))
    whole = images.covering(t, 40, 30, 3, 2)
    monkeypatch.setattr(images, "PAIRS", 10)
    assert np.array_equal(images.covering(t, 40, 30, 3, 2), whole) and whole.max() == 59
    out = np.full((40, 30), -1)
    for k in range(60):
        out = np.where(images.covering(t[k : k + 1], 40, 30, 3, 2) == 0, k, out)
    assert np.array_equal(out, whole) and (images.covering(t[:0], 4, 4) == -1).all()
