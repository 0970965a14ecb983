import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import with_top
from tessera.operators import binning, matrix, regions, simulation
from tessera.operators.decode import couple, decode, edges, prior
from tessera.operators.lda import Lda, from_pseudobulk, infer, restarts


def planted(spark, n=240, k=3, block=8, seed=0):
    """Units with one strong factor each, over disjoint blocks of genes."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(n):
        mix = np.full(k, 0.05)
        mix[u % k] = 0.9
        for g, c in zip(*np.unique(np.repeat(np.arange(k), rng.multinomial(80, mix / mix.sum())) * block + rng.integers(0, block, 80), return_counts=True)):
            rows.append((u, f"g{g:02d}", float(c)))
    return spark.createDataFrame(rows, "unit long, gene string, n double")


@pytest.fixture(scope="module")
def fitted(spark):
    counts = planted(spark)
    index = matrix.features(counts, 1).persist()
    units = matrix.units(counts, index, 20).persist()
    genes = [r.gene for r in index.orderBy("idx").collect()]
    return counts, units, genes, Lda(genes, 3, alpha=0.3, seed=1).fit(units, 8, 60)


def test_mass_is_kept(fitted):
    _, units, genes, model = fitted
    sums, n = model.expected(units)
    assert n == 240 and sums.sum() == pytest.approx(240 * 80, rel=1e-6)


def test_recovery(fitted):
    _, units, _, model = fitted
    theta = {r.unit: np.array(r.theta) for r in model.transform(units).collect()}
    assert all(t.sum() == pytest.approx(1) for t in theta.values())
    best = np.array([theta[u].argmax() for u in range(240)])
    agree = max(np.mean(best == np.array(p)[np.arange(240) % 3]) for p in [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)])
    assert agree > 0.97


def test_bound_rises(fitted, spark):
    _, units, genes, _ = fitted
    model, scores = Lda(genes, 3, alpha=0.3, seed=5), []
    for _ in range(4):
        model.batch_update(units)
        scores.append(model.bound(units)[0])
    assert scores == sorted(scores) and model.bound(units)[1] < 30


def test_relabel_and_save(fitted, spark, tmp_path):
    _, units, _, model = fitted
    model.relabelled().save(spark, str(tmp_path / "m"))
    again = Lda.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.lam, model.lam) and again.genes == list(map(str, model.genes))
    assert (np.diff(model.lam.sum(1)) <= 0).all()


def test_restarts_and_pseudobulk(fitted, spark):
    counts, units, genes, model = fitted
    best, scores = restarts(units, counts, genes, 3, 2, 0.5, 2, 0, alpha=0.3)
    assert scores.count() == 6 and scores.filter("score > 0").count() == 6
    m = from_pseudobulk(model.matrix(spark), genes, 0.0)
    assert m.lam.shape == (3, len(genes)) and m.transform(units).count() == 240


def test_infer_stops_by_unit():
    beta = np.array([[0.9, 0.1], [0.1, 0.9]])
    gamma, sums = infer(np.array([0, 0, 2]), np.array([0, 1, 1]), np.array([5.0, 1.0, 4.0]), 3, beta, 0.5)
    assert gamma[0, 0] > gamma[0, 1] and gamma[2, 1] > gamma[2, 0] and gamma[1] == pytest.approx([0.5, 0.5])
    assert sums.sum() == pytest.approx(10)


def test_decode_fixed_point():
    rng = np.random.default_rng(0)
    pixels, anchors = rng.uniform(0, 10, (60, 2)), rng.uniform(0, 10, (12, 2))
    px, ax, w = edges(pixels, anchors, 6.0)
    linked = np.unique(px)
    px = np.searchsorted(linked, px)
    assert (w >= 0.05).all() and (w <= 0.95).all()
    theta = prior(rng.dirichlet([1, 1], 12))
    xb = np.log(rng.dirichlet([2, 2], len(linked)))
    phi, gamma, psi, trail = couple(px, ax, w, len(linked), theta, xb, 200, 1e-9)
    assert phi.sum(1) == pytest.approx(np.ones(len(linked))) and np.bincount(px, psi) == pytest.approx(np.ones(len(linked)))
    assert gamma.sum() == pytest.approx(12 + len(linked))


def test_simulation_is_decoded(spark):
    pixels, truth, model = simulation.tissue(spark, types=3, genes=60)
    anchors = binning.centred(binning.hex_units(pixels, 6.0, 2, min_ct=1), 6.0, 2).select("x", "y", F.array(*(F.lit(0.25) for _ in range(4))).alias("theta"))
    got = with_top(decode(pixels, anchors, model, side=80, halo=20, r=6, rounds=40), 1)
    assert got.count() == got.select("X", "Y").distinct().count()
    joined = simulation.matched(got, truth)
    accuracy, label, _ = simulation.scored(joined)
    assert accuracy > 0.6 and len(label) == 4
    assert simulation.mismatches(joined, label).count() == joined.count() - round(accuracy * joined.count())


def test_decode_leaves_poor_tiles(spark):
    p = spark.createDataFrame([(1.0, 1.0, "a", 1)], "X double, Y double, gene string, Count int")
    a = spark.createDataFrame([(float(i), 1.0, [0.5, 0.5]) for i in range(9)], "x double, y double, theta array<double>")
    m = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 1.0)], "gene string, factor int, `lambda` double")
    assert decode(p, a, m, 100, 20, 10).count() == 0
    assert decode(p.limit(0), a, m).count() == 0


def test_density_region(spark):
    rng = np.random.default_rng(2)
    dense, sparse = rng.uniform(0, 200, (24000, 2)), rng.uniform(0, 600, (9000, 2))
    p = spark.createDataFrame([(float(x), float(y), "g", 1) for x, y in np.vstack([dense, sparse])], "X double, Y double, gene string, Count int")
    kept, totals, cut = regions.filter_by_density(p, radius=10)
    inner = kept.filter("X between 10 and 190 and Y between 10 and 190").count() / ((dense > 10).all(1) & (dense < 190).all(1)).sum()
    outer = kept.filter("X > 260 or Y > 260").count() / ((sparse > 260).any(1)).sum()
    assert inner > 0.99 and outer < 0.05 and cut.dense_mean > cut.sparse_mean and totals.count() == 1
    assert regions.filter_by_anchors(p, 20).count() > 0


def test_small_groups_of_triangles_go(spark):
    rows = [(0.0, 0.0, 2.0, 0.0, 0.0, 2.0), (2.0, 0.0, 0.0, 2.0, 2.0, 2.0), (9.0, 9.0, 10.0, 9.0, 9.0, 10.0)]
    tri = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    assert regions.large(tri, 3.0).count() == 2
