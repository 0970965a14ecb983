import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quadtree as q
from tessera.operators import spatial as sp
from tessera.operators.decode import decode


def spots(seed=0, n=3000):
    """Thin ground and one spot with a third of all rows."""
    r = np.random.default_rng(seed)
    ground, spot = r.uniform(0, 900, (2 * n // 3, 2)), r.normal((200, 700), 12, (n // 3, 2))
    return np.round(np.concatenate([ground, spot]), 2)


def brute_leaf(points, cells, most):
    """The leaf of each row by halving from the top."""
    number = np.floor((points - [cells.x0, cells.y0]) / cells.width).astype(int)
    out = {}

    def cut(rows, level):
        if len(rows) > most and level:
            nodes = number[rows] >> (level - 1)
            for node in np.unique(nodes, axis=0):
                cut(rows[(nodes == node).all(1)], level - 1)
        else:
            out.update({int(i): (level, *map(int, number[i] >> level)) for i in rows})

    cut(np.arange(len(points)), cells.depth)
    return out


@pytest.mark.parametrize("most", [1, 100, 5000])
def test_leaves_and_halos(spark, most):
    points = spots()
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, X double, Y double")
    cells = q.Cells.over((0.0, 950.0, 0.0, 950.0), 25.0)
    found = q.leaves(df, cells, most)
    got = q.spread(df, q.around(found, cells, 20.0), cells, 20.0).collect()
    want = brute_leaf(points, cells, most)
    assert {r.i: (r.level, r.qx, r.qy) for r in got if r.own} == want and sum(r.own for r in got) == len(points)
    sizes = {}
    for leaf in want.values():
        sizes[leaf] = sizes.get(leaf, 0) + 1
    assert all(n <= most or leaf[0] == 0 for leaf, n in sizes.items())
    # Every row of a leaf has all rows within the reach of it in its group.
    groups = {}
    for r in got:
        groups.setdefault((r.level, r.qx, r.qy), set()).add(r.i)
    assert len(got) == sum(map(len, groups.values()))
    for i in range(0, len(points), 29):
        near = np.nonzero(np.abs(points - points[i]).max(1) <= 20)[0]
        assert set(near.tolist()) <= groups[want[i]]


def test_decode_in_adaptive_tiles(spark):
    """Clusters apart from each other, each within one tile of both kinds: the same result."""
    r = np.random.default_rng(3)
    places = [(x, y) for x in range(60, 1600, 400) for y in range(60, 1600, 400)]
    pixels = [(float(a + u), float(b + v), f"g{(i + k) % 6}", 1 + i % 3) for k, (a, b) in enumerate(places) for i, (u, v) in enumerate(np.round(r.uniform(0, 30, (40, 2)), 1))]
    anchors = [(float(a + u), float(b + v), [0.7, 0.3] if i % 2 else [0.2, 0.8]) for a, b in places for i, (u, v) in enumerate(np.round(r.uniform(0, 30, (12, 2)), 1))]
    p, a = spark.createDataFrame(pixels, "X double, Y double, gene string, Count int"), spark.createDataFrame(anchors, "x double, y double, theta array<double>")
    model = spark.createDataFrame([(f"g{g}", k, 1.0 + 9 * (g % 2 == k)) for g in range(6) for k in range(2)], "gene string, factor int, `lambda` double")
    rows = lambda df: np.array(sorted((x.X, x.Y, *x.theta) for x in df.collect()))
    fixed = rows(decode(p, a, model, 400, 50))
    assert len(fixed) == p.select("X", "Y").distinct().count()
    for most in (45, 10**9):  # a tile's rounds end by the mean change of its anchors
        assert np.abs(rows(decode(p, a, model, halo=50, most=most)) - fixed).max() < 1e-4


@pytest.mark.parametrize("k", [1, 3, 9])
def test_nearest_by_the_pyramid(spark, k):
    """Dense and empty places, and fewer points than asked for: the same as all distances."""
    left, right = spots(1, 400), np.concatenate([spots(2, 60), [[-5000.0, 20_000.0]]])
    frame = lambda p, n, a, b: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], f"{n} int, {a} double, {b} double")
    for points in (right, right[:2]):
        got = sorted((r.i, r["rank"], r.j) for r in sp.nearest_any(frame(left, "i", "X", "Y"), frame(points, "j", "x", "y"), 7.0, "i", "j", k).collect())
        d = np.sqrt(((left[:, None] - points) ** 2).sum(2))
        want = sorted((i, n + 1, int(j)) for i in range(len(left)) for n, j in enumerate(np.lexsort((np.arange(len(points)), d[i]))[:k]))
        assert got == want


def test_the_plan_has_one_distance_join(spark):
    df = spark.range(50).select(F.col("id").alias("i"), F.col("id").cast("double").alias("X"), (F.col("id") * 7 % 11).cast("double").alias("Y"))
    plan = sp.nearest_any(df, df.select(F.col("i").alias("j"), F.col("X").alias("x"), F.col("Y").alias("y")), 1.0, "i", "j", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_level") and "Cartesian" not in plan
