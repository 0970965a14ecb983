"""Options of the verbs: trims, precision, learning rate, reports, views."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.cli import main
from tessera.operators import binning, simulation, spatial
from tessera.operators.lda import Lda


@pytest.fixture(scope="module")
def here(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("verbs")
    pixels, _, _ = simulation.tissue(spark, extent=60, genes=30, density=5)
    # Dense all around and thin in the middle, so that the dense region has a hole.
    hole = (F.col("X") - 30) ** 2 + (F.col("Y") - 30) ** 2 < 144
    pixels.filter(~hole | (F.xxhash64("X", "Y") % 40 == 0)).withColumn("grp", F.when(F.col("X") < 30, "a").otherwise("b")).write.parquet(str(d / "p.parquet"))
    return d


def run(spark, d, verb, name, source="p.parquet", **options):
    argv = [x for k, v in options.items() for x in ([f"--{k.replace('_', '-')}"] if v is True else [f"--{k.replace('_', '-')}", str(v)])]
    main([verb, "--input", str(d / source), "--output", str(d / name), *argv], spark)
    return str(d / name)


def test_outlines_read_back_keep_the_same_pixels(spark, here):
    run(spark, here, "filter_by_density", "den", radius=4, outlines=True)
    polygons = json.loads((here / "den" / "lenient.geojson").read_text())["features"][0]["geometry"]["coordinates"]
    assert any(len(p) > 1 for p in polygons)
    run(spark, here, "filter_by_boundary", "back", boundary=here / "den" / "lenient.geojson")
    rows = lambda name: sorted(tuple(r) for r in spark.read.parquet(str(here / name)).select("X", "Y", "gene").collect())
    assert rows("back") == rows("den/pixels") and 0 < len(rows("back")) < spark.read.parquet(str(here / "p.parquet")).count()
    run(spark, here, "filter_by_boundary", "tight", boundary=here / "den" / "lenient.geojson", buffer=0)
    assert set(rows("tight")) < set(rows("back"))


def test_distance_to_edges(spark):
    r = np.random.default_rng(2)
    points, ends = r.uniform(-20, 120, (400, 2)), r.uniform(0, 100, (30, 4))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, X double, Y double")
    edges = spark.createDataFrame([tuple(map(float, e)) for e in ends], "x1 double, y1 double, x2 double, y2 double")

    def far(p, e):
        u, v = e[2:] - e[:2], p - e[:2]
        return math.hypot(*(v - u * min(1, max(0, (v @ u) / (u @ u)))))

    want = {i for i, p in enumerate(points) if min(far(p, e) for e in ends) <= 3}
    assert {r.i for r in spatial.near_edges(df, edges, 3.0).collect()} == want


def test_trims(spark, here):
    p = spark.read.parquet(str(here / "p.parquet"))
    whole = spark.read.parquet(run(spark, here, "make_dge", "dge0", hex_width=8, min_ct=2, n_move=2, untrimmed=True, group_within="grp"))
    got = spark.read.parquet(run(spark, here, "make_dge", "dge1", hex_width=8, min_ct=2, n_move=2, group_within="grp"))
    ends = {r.grp: (r.lo + 4, r.hi - 4) for r in p.groupBy("grp").agg(F.min("X").alias("lo"), F.max("X").alias("hi")).collect()}
    least = binning.hexed(p, 8.0, 2).groupBy("grp", *binning.HEX).agg(F.min("X").alias("x")).collect()
    inner = {(r.grp, r.ox, r.oy, r.hx, r.hy) for r in least if ends[r.grp][0] < r.x < ends[r.grp][1]}
    key = lambda df: {tuple(r) for r in df.select("grp", *binning.HEX).distinct().collect()}
    assert key(got) == key(whole) & inner and key(got) < key(whole)


def test_transform_and_decode(spark, here):
    p = spark.read.parquet(str(here / "p.parquet"))
    genes = sorted(r.gene for r in p.select("gene").distinct().collect())
    Lda(genes, 3).save(spark, str(here / "m"))
    kept = spark.read.parquet(run(spark, here, "transform", "t1", model=here / "m", hex_width=10, n_move=2, min_ct=5, axis="Y") + "/anchors").collect()
    whole = spark.read.parquet(run(spark, here, "transform", "t0", model=here / "m", hex_width=10, n_move=2, min_ct=5, untrimmed=True, precision=-1) + "/anchors").collect()
    lo, hi = p.agg(F.min("Y"), F.max("Y")).first()
    assert {r.unit for r in kept} == {r.unit for r in whole if lo + 5 < r.y < hi - 5} and len(kept) < len(whole)
    assert all(round(v, 1) == v for r in kept for v in (r.x, r.y)) and any(round(r.x, 1) != r.x for r in whole)
    at = dict(model=here / "m", anchors=here / "t0" / "anchors", radius=9, side=40, halo=10, top=2)
    coarse = spark.read.parquet(run(spark, here, "slda_decode", "d1", precision=2, **at)).collect()
    fine = spark.read.parquet(run(spark, here, "slda_decode", "d0", precision=0, most=2000, **at)).collect()
    assert coarse and all(v % 2 == 0 for r in coarse for v in (r.X, r.Y)) and len(coarse) < len(fine)


def test_learning_rate(spark, here):
    run(spark, here, "make_dge", "units", hex_width=8, min_ct=5, n_move=1)
    options = dict(n_factor=3, restarts=1, min_ct_unit=5, min_ct_feature=5)
    models = [Lda.load(spark, run(spark, here, "fit_model", f"f{i}", "units", tau=tau, kappa=kappa, **options) + "/model") for i, (tau, kappa) in enumerate([(9, 0.7), (1, 0.9)])]
    assert [(m.tau, m.kappa) for m in models] == [(9.0, 0.7), (1.0, 0.9)] and not np.allclose(models[0].lam, models[1].lam)


def test_report(spark, here):
    spark.createDataFrame([(f"g{g}", str(k), float(100 * (g % 3 == k) + 5 + g)) for g in range(9) for k in range(3)], "gene string, factor string, n double").write.parquet(str(here / "post"))
    run(spark, here, "de_bulk", "de", "post", min_ct=1)
    spark.createDataFrame([(str(k), k, 0.5, 0.0, 1.0) for k in range(3)], "Name string, Color_index int, R double, G double, B double").write.parquet(str(here / "col"))
    (here / "names.tsv").write_text("0\tglia\n2\tneuron\n")
    run(spark, here, "factor_report", "rep", "post", markers=here / "de", colours=here / "col", annotation=here / "names.tsv")
    page, tree = (here / "rep" / "report.html").read_text(), (here / "rep" / "tree.nwk").read_text()
    assert all(x in page for x in ("glia", "neuron", "rgb(127,0,255)", tree.split(":")[0].strip("("))) and tree.endswith(";") and tree.count(",") == 2


def test_views(spark, here):
    rows = [(float(i % 20), float(i // 20), i % 3, (i + 1) % 3, 0.8, 0.2) for i in range(400)]
    spark.createDataFrame(rows, "X double, Y double, K1 int, K2 int, P1 double, P2 double").write.parquet(str(here / "top"))
    size = lambda f: tuple(int.from_bytes((here / f).read_bytes()[i : i + 4], "big") for i in (16, 20))
    run(spark, here, "plot_pixel_multi", "multi.png", "top", channels="0,1:#00ff00", colours=here / "col", top=2, xmax=9, transpose=True)
    assert size("multi.png") == (10, 20)
    run(spark, here, "plot_pixel_single", "single", "top", top=2, least=1, factors="2", ymin=5)
    assert [f.name for f in sorted((here / "single").glob("*.png"))] == ["factor_2.png"] and size("single/factor_2.png") == (15, 20)
    run(spark, here, "plot_boundary", "edge.png", "den/lenient.geojson", ink="#ff0000")
    assert (here / "edge.png").read_bytes()[:4] == b"\x89PNG"
    run(spark, here, "plot_pixel_full", "full.tif", "top", colours=here / "col", top=2)
    from tessera.sources import readers

    assert tuple(readers.image_box(spark, str(here / "full.tif")).first()) == (0.0, 20.0, 0.0, 20.0)


def test_lookup_of_factors(spark, here):
    """Places between decoded ones: the weighted mean of the nearest, from block-indexed results with an index or without."""
    r = np.random.default_rng(8)
    decoded = np.round(r.uniform(0, 60, (300, 2)) * 4) / 4
    decoded = np.unique(decoded, axis=0)
    rows = [(float(x), float(y), i % 3, (i + 1) % 3, 0.75, 0.25) for i, (x, y) in enumerate(decoded)]
    spark.createDataFrame(rows, "X double, Y double, K1 int, K2 int, P1 double, P2 double").write.parquet(str(here / "top2"))
    for name, flags in (("plain", {}), ("tabled", {"indexed": True})):
        run(spark, here, "block_index", f"blocks_{name}", "top2", n_factor=3, top=2, block=20, **flags)
        run(spark, here, "impute", f"imputed_{name}", decoded=here / f"blocks_{name}", radius=4, k=3, **flags)
    theta = np.zeros((len(rows), 3))
    for i, row in enumerate(rows):
        theta[i, row[2]], theta[i, row[3]] = 0.75, 0.25
    want, nu = {}, math.log(0.5) / math.log(0.7)
    for p in spark.read.parquet(str(here / "p.parquet")).select("X", "Y").distinct().collect():
        d = np.hypot(*(decoded - [p.X, p.Y]).T)
        near = [j for j in np.lexsort((decoded[:, 1], decoded[:, 0], d))[:3] if 0 < d[j] < 4]
        if near:
            w = 1 - (d[near] / 4) ** nu
            want[p.X, p.Y] = w @ theta[near] / w.sum()
    for name in ("plain", "tabled"):
        got = {(x.X, x.Y): x.theta for x in spark.read.parquet(str(here / f"imputed_{name}")).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_fit_from_a_prior(spark, here):
    counts = [(f"{u % 3}0{u}", f"g{(u % 2) * 3 + i}", 4.0 + (u + i) % 3) for u in range(90) for i in range(3)]
    spark.createDataFrame(counts, "unit string, gene string, n double").write.parquet(str(here / "cnt"))
    prior = [(f"g{g}", k, 50.0 if (g < 3) == (k == 0) else 1.0) for g in range(5) for k in range(2)] + [("absent", 0, 9.0)]
    spark.createDataFrame(prior, "gene string, factor int, `lambda` double").write.parquet(str(here / "prior.parquet"))
    options = dict(min_ct_unit=3, n_factor=7)
    for name, more in (("l0", {}), ("l1", {"rescale": 0.5, "total": 90.0}), ("l2", {"shift_log": True}), ("l3", {"epoch_length": 1, "epochs": 2}), ("l4", {"shift_log": True, "scale": 0.01})):
        run(spark, here, "lda", name, "cnt", prior=here / "prior.parquet", **options, **more)
        model = Lda.load(spark, str(here / name / "model"))
        assert model.k == 2 and model.genes == [f"g{i}" for i in range(5)] and model.step == (2 if name == "l3" else 1)
        theta = {r.unit: np.argmax(r.theta) for r in spark.read.parquet(str(here / name / "theta")).collect()}
        assert len(theta) == 90 and len({(int(u[2:]) % 2, k) for u, k in theta.items()}) == 2  # the two kinds of units are the two factors
    run(spark, here, "lda", "free", "cnt", min_ct_unit=3, n_factor=3)
    assert Lda.load(spark, str(here / "free" / "model")).k == 3


def test_pieces_of_the_bound(spark, here):
    """Two tiles apart from each other: the pieces of both are the sums of each by itself, and their total what they say."""
    from tessera.operators.decode import bound_pieces

    r = np.random.default_rng(1)
    part = lambda dx: ([(float(x + dx), float(y), f"g{i % 4}", 1 + i % 2) for i, (x, y) in enumerate(np.round(r.uniform(0, 40, (60, 2)), 1))], [(float(x + dx), float(y), [0.6, 0.4]) for x, y in np.round(r.uniform(0, 40, (14, 2)), 1)])
    near, far = part(0), part(3000)
    model = spark.createDataFrame([(f"g{g}", k, 1.0 + 5 * (g % 2 == k)) for g in range(4) for k in range(2)], "gene string, factor int, `lambda` double")
    frame = lambda p, a: (spark.createDataFrame(p, "X double, Y double, gene string, Count int"), spark.createDataFrame(a, "x double, y double, theta array<double>"))
    of = lambda p, a: {x.piece: x.value for x in bound_pieces(*frame(p, a), model).collect()}
    one, two, both = of(*near), of(*far), of(near[0] + far[0], near[1] + far[1])
    assert set(both) == {"pixel", "patch", "gamma", "beta", "total"} and both["beta"] == one["beta"] and both["pixel"] < 0
    assert all(both[k] == pytest.approx(one[k] + two[k], rel=1e-6) for k in ("pixel", "patch", "gamma"))
    assert both["total"] == pytest.approx(sum(v for k, v in both.items() if k != "total"))
