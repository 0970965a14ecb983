"""Models that do not depend on partitions, penalties, spatial learning, density windows and small operators."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import planted

from tessera.functions import colours
from tessera.operators import filters, matrix, rasters, regions, simulation
from tessera.operators import spatial as sp
from tessera.operators.binning import centred, hex_units
from tessera.operators.decode import decoded_anchors, decontaminated, learned
from tessera.operators.lda import Lda, starts, unmixed
from tessera.sources import readers


def test_model_does_not_depend_on_partitions(spark):
    counts = planted(spark)
    index = matrix.features(counts, 1).persist()
    genes = [r.gene for r in index.orderBy("idx").collect()]
    units = matrix.units(counts, index, 20).persist()
    lam = []
    for n in (2, 7):
        model = Lda(genes, 3, seed=4)
        for _ in range(2):
            model.update(units.repartition(n), 240)
        lam.append(model.lam)
    assert np.abs(lam[0] - lam[1]).max() < 1e-9 * lam[0].max()
    some = Lda(genes, 3, seed=4).fit(units, 1.5, 60)
    assert some.step == 6  # four batches, and half of them again
    x = starts(np.arange(20_000), 3)
    assert x.mean() == pytest.approx(1, abs=0.01) and x.std() == pytest.approx(0.1, abs=0.01) and len(np.unique(x)) == x.size


def test_unmixed_by_definition():
    rng = np.random.default_rng(0)
    stats, lam, ambient = rng.gamma(2, 5, (3, 6)), rng.gamma(2, 5, (3, 6)), rng.dirichlet(np.ones(6))
    for amb, only in ((None, False), (ambient, False), (ambient, True)):
        got = unmixed(stats, lam, 0.2, amb, only)
        profiles = [*(lam / lam.sum(1, keepdims=True)), *([amb] if amb is not None else [])]
        weights = np.append(lam.sum(1) / lam.sum(), [1.0] if amb is not None else [])
        weights = weights / weights.sum()
        for k in range(3):
            leak = amb if only else sum(w * p for i, (w, p) in enumerate(zip(weights, profiles)) if i != k)
            assert got[k] == pytest.approx(np.maximum((stats[k] - 0.2 * stats[k].sum() * leak) / 0.8, 1e-100))


def test_penalised_model_learns(spark, tmp_path):
    counts = planted(spark)
    index = matrix.features(counts, 1).persist()
    genes = [r.gene for r in index.orderBy("idx").collect()]
    units = matrix.units(counts, index, 20).persist()
    model = Lda(genes, 3, alpha=0.3, seed=1, penalty=0.1, ambient=np.ones(len(genes)), ambient_only=True).fit(units, 4, 60)
    share = model.lam / model.lam.sum(1, keepdims=True)
    assert all(max(share[k].reshape(3, 8).sum(1)) > 0.8 for k in range(3))
    model.save(spark, str(tmp_path / "m"))
    again = Lda.load(spark, str(tmp_path / "m"))
    assert again.penalty == 0.1 and again.ambient == pytest.approx(model.ambient) and again.ambient_only


def test_learning_from_pixels(spark):
    pixels, _, model = simulation.tissue(spark, extent=60, types=3, genes=40)
    anchors = centred(hex_units(pixels, 6.0, 2, min_ct=1), 6.0, 2).select("x", "y", F.array(*(F.lit(0.25) for _ in range(4))).alias("theta"))
    blurred = model.withColumn("lambda", F.col("lambda") * 0.5 + 5)
    for zeta in (0.0, 0.05):
        new, bounds = learned(pixels, anchors, blurred, 3, side=40, halo=12, r=6, zeta=zeta)
        assert new.count() == model.count() and bounds == sorted(bounds)
    got = decoded_anchors(pixels, anchors, model, side=80, halo=20, r=6)
    sums = got.select(F.aggregate("theta", F.lit(0.0), lambda a, x: a + x).alias("s"), "avg_size").agg(F.min("s"), F.max("s"), F.sum("avg_size")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1) and sums[2] > 0


def test_decontaminated_keeps_totals():
    rng = np.random.default_rng(1)
    lam, theta = rng.gamma(2, 5, (3, 8)), rng.dirichlet(np.ones(3), 10)
    links = [(i, j) for i in range(10) for j in ((i + 1) % 10, (i - 1) % 10)]
    one = decontaminated(lam, theta, np.array(links), 0.1, rounds=1)
    adj = np.eye(10)
    for i, j in links:
        adj[i, j] = 1
    near = theta.T @ (adj / adj.sum(1, keepdims=True)) @ theta / theta.sum(0)[:, None]
    np.fill_diagonal(near, 0)
    rest = np.maximum(lam - 0.1 * lam.sum(1, keepdims=True) * (near @ (lam / lam.sum(1, keepdims=True))), 0)
    assert one == pytest.approx(rest / rest.sum(1, keepdims=True) * lam.sum(1, keepdims=True))
    assert decontaminated(lam, theta, np.array(links), 0.1).sum(1) == pytest.approx(lam.sum(1))


def test_density_windows(spark):
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 1, (12_000, 2)) * [300, 100]
    high = rng.uniform(0, 1, (60_000, 2)) * [150, 100] + [0, 100]
    thin = rng.uniform(0, 1, (2_000, 2)) * [150, 100] + [150, 100]
    p = spark.createDataFrame([(float(x), float(y), "g", 1) for x, y in np.vstack([low, high, thin])], "X double, Y double, gene string, Count int")
    kept = regions.filter_by_anchors(p, 20, 1, windows=2, least_dense=0.05)
    share = lambda where: kept.filter(where).count() / p.filter(where).count()
    assert share("Y < 95") > 0.85 and share("Y > 110 and X < 140") > 0.95 and share("Y > 110 and X > 180") < 0.2
    assert regions.window_cut(np.array([5.0]), np.array([3]), 10, 0.1) == 5.0
    assert regions.window_cut(np.array([1.0, 2.0, 3.0]), np.array([9, 9, 9]), 100, 0.5) == 50.0
    assert regions.dense_anchors(p.limit(0)).count() == 0


def test_outline(spark):
    rows = [(0.0, 0.0, 2.0, 0.0, 0.0, 2.0), (2.0, 0.0, 0.0, 2.0, 2.0, 2.0), (9.0, 9.0, 10.0, 9.0, 9.0, 10.0)]
    rings = regions.outline(spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"))
    assert sorted(map(sorted, rings)) == [[(0, 0), (0, 2), (2, 0), (2, 2)], [(9, 9), (9, 10), (10, 9)]]


def test_polygons_united_with_holes_and_repeated_rows(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes = [[square(0.0, 6.0)], [square(4.0, 10.0), square(7.0, 9.0)], [square(7.5, 8.5)]]
    rows = [(5.1, 5.1), (5.1, 5.1), (3.0, 3.0), (8.0, 8.0), (7.2, 8.0), (9.5, 9.5), (11.0, 5.0), (-1.0, 3.0)]
    p = spark.createDataFrame(rows, "X double, Y double")
    got = sorted(map(tuple, sp.within(p, readers.polygon_edges(spark, shapes)).collect()))
    assert got == [(3.0, 3.0), (5.1, 5.1), (5.1, 5.1), (8.0, 8.0), (9.5, 9.5)]
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[*map(list, r), list(r[0])] for r in s] for s in shapes]}}]})
    assert readers.boundary(text) == shapes and readers.boundary("path\nM 0,0 L 2,0 L 2,1 Z\n") == [[[(0, 0), (2, 0), (2, 1)]]]


def test_lattice_by_steps_is_lattice_by_distance(spark):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(float(x), float(y), "g", 1) for x, y in rng.uniform(-80, 80, (400, 2))], "X double, Y double, gene string, Count int")
    for n in (1, 2):
        u = centred(hex_units(p, 24.0, n, min_ct=2), 24.0, n).withColumn("key", F.struct("ox", "oy", "hx", "hy")).persist()
        at = {tuple(r.key): (r.x, r.y) for r in u.collect()}
        want = {(a, b) for a in at for b in at if 0 < np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) < 24.0 / n + 0.5}
        assert {(tuple(r.key), tuple(r.other)) for r in sp.on_lattice(u, "key", 24.0 / n).collect()} == want


def test_nearest_however_far(spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 100, (60, 2)), np.vstack([rng.uniform(0, 100, (12, 2)), [[5000.0, 5000.0]]])
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "i int, X double, Y double")
    right = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(b)], "j int, x double, y double")
    got = {(r.i, r["rank"]): r.j for r in sp.nearest_any(left, right, 5.0, "i", "j", 3).collect()}
    assert got == {(i, k + 1): int(j) for i, p in enumerate(a) for k, j in enumerate(np.argsort(np.hypot(*(b - p).T))[:3])}
    assert {r.j for r in sp.nearest_any(left, right.filter("j = 12"), 5.0, "i", "j", 3).collect()} == {12}


def test_colours_of_given_places():
    at = np.array([0.4, 0.1, 0.7])
    got = colours.table(at)
    assert [r[1] for r in got] == [1, 0, 2]
    want = colours.turbo(np.array([0.05 + 0.95 * 0.5, 0.05, 1.0]))
    assert np.allclose([r[2:] for r in got], want) and colours.table(np.array([0.3]))[0][1] == 0
    w = np.array([0.2, 0.5, 0.3])
    p = colours.places(np.array([[0, 5, 1], [5, 0, 1], [1, 1, 0.0]]), w, "#0000ff")
    assert p[1] == pytest.approx(colours.place_of("#0000ff")) and ((p >= 0) & (p < 1)).all()
    assert colours.place_of("no colour") == colours.place_of(colours.TOP)


def test_small_operators(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    assert filters.limited(df, 7).count() == 7 and filters.limited(df).count() == 100
    one, two = (sorted(r.x for r in filters.sampled(df.repartition(n), 10, "x", 3).collect()) for n in (1, 5))
    assert one == two and len(one) == 10
    assert filters.even_slices(10, 3) == [(0, 3), (3, 6), (6, 10)] and filters.even_slices(2, 5) == [(0, 1), (1, 2)] and filters.even_slices(0, 4) == [(0, 0)]
    sizes = [r["count"] for r in filters.sliced(df, 4, "x").groupBy("slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2
    table = spark.createDataFrame([("a", 1.0, 0.0, 0.0)], "Name string, R double, G double, B double")
    got = rasters.with_colours(spark.createDataFrame([("x",), ("b",), (None,)], "label string"), table, "label", {"x": "a"}).collect()
    assert [(r.label, r.R, r.G) for r in got] == [("x", 1.0, 0.0), ("b", 0.5, 0.5), (None, 0.5, 0.5)]
    image = rasters.outlines([[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]])
    assert image.shape == (5, 4, 3) and image[0, 0].all() and image[4, 3].all() and not image[0, 3].any()
    assert rasters.oriented(image, True, True, True).shape == (4, 5, 3) and (rasters.oriented(image, True, True, True)[3, 4] == image[0, 0]).all()


def test_extent_of_an_image():
    text = b'<OME><Pixels PhysicalSizeX="0.5" PhysicalSizeY="0.25"/></OME>\0'
    for order in "<>":
        entries = [(256, 4, 1, 800), (257, 3, 1, 600), (270, 2, len(text), 8 + 2 + 36 + 4)]
        data = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 3)
        for tag, kind, n, value in entries:
            data += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        data += struct.pack(order + "I", 0) + text
        assert readers.tiff_extent(data) == {"width": 800, "height": 600, "xmax": 400, "ymax": 150}
    with pytest.raises(ValueError):
        readers.tiff_extent(b"nothing of the kind")
