"""Queries over all pixels, against brute force on small tables that reach beyond the corner of the others."""

import math

import numpy as np
import pytest

from tessera.catalogue import models as m


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    at = [(float(x), float(y)) for x, y in rng.integers(-40, 1060, (300, 2))]
    a = [(i, -i, float(x), float(y), int(n)) for i, (x, y, n) in enumerate(rng.integers(0, 1060, (400, 3)))]
    return at, a, spark.createDataFrame([(*p, 1 + i % 50) for i, p in enumerate(at)], "X double, Y double, Count int"), spark.createDataFrame(a, "hx long, hy long, x double, y double, tot long")


def near(p, a, r):
    return sorted((d, hx, hy, tot) for hx, hy, x, y, tot in a if (d := math.dist(p, (x, y))) <= r)


def test_joins_take_all_pixels(points):
    at, a, p, s = points
    got = sorted((r.X, r.Y, r.hx, r.hy) for r in m._radius_edges(p, s).collect())
    assert got == sorted((*q, hx, hy) for q in set(at) for _, hx, hy, _ in near(q, a, 13.0))
    assert sum(x >= 300 or y >= 300 for x, y, *_ in got) > len(got) / 2
    got = sorted((r.X, r.Y, r["rank"], r.hx, r.hy) for r in m._knn_join(p, s).collect())
    assert got == sorted((*q, i + 1, hx, hy) for q in set(at) for i, (_, hx, hy, _) in enumerate(near(q, a, 25.0)[:3]))
    want = {}
    for q in set(at):
        w = [(1 - (d / 20) ** m.NU, tot) for d, _, _, tot in near(q, a, 20.0) if d < 20]
        if w:
            want[q] = sum(x * t for x, t in w) / sum(x for x, _ in w)
    got = {(r.X, r.Y): r.value for r in m._knn_impute(p, s).collect()}
    assert set(got) == set(want) and all(got[q] == pytest.approx(want[q], abs=1e-5) for q in want)


def test_rasters_take_the_whole_extent(points):
    at, a, p, s = points
    count = {}
    for i, (x, y) in enumerate(at):
        c = (round(x / 20), round(y / 20))
        count[c] = count.get(c, 0) + 1 + i % 50
    xs, ys = zip(*count)
    want = dict(count)
    for c in ((x, y) for x in range(min(xs), max(xs) + 1) for y in range(min(ys), max(ys) + 1)):
        if c not in count and (d := min(((c[0] - x) ** 2 + (c[1] - y) ** 2, (x, y)) for x, y in count))[0] <= 4:
            want[c] = count[d[1]]
    got = [((r.px, r.py), r.n) for r in m._raster_filled_all(p).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert any(max(c) >= 30 for c in set(want) - set(count)) and any(min(c) < 0 for c in want)
    cells = m._grid(m.b.raster(p, 10.0, "X", "Y")).collect()
    px, py = ([round(q[i] / 10) for q in at] for i in (0, 1))
    assert sorted(cells) == [(x, y) for x in range(min(px), max(px) + 1) for y in range(min(py), max(py) + 1)]
    assert m._raster_filled_all(p.limit(0)).count() == 0
