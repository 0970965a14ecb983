import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import colours, special


def test_digamma():
    assert special.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert special.digamma(np.array([0.5]))[0] == pytest.approx(-1.9635100260214235, abs=1e-10)
    x = np.array([0.01, 0.3, 2.5, 40.0])
    assert special.digamma(x + 1) - special.digamma(x) == pytest.approx(1 / x, rel=1e-9)


def test_tails():
    assert special.chi2_tail(3.841458820694124) == pytest.approx(0.05, rel=1e-9)
    assert special.critical(1e-3) == pytest.approx(10.827566170662733, rel=1e-9)
    assert special.neglog10_tail(100.0) == pytest.approx(special.neglog10_tail(100.0001), abs=1e-3)
    assert math.isfinite(special.neglog10_tail(1e5))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_best(n, m, seed):
    from itertools import permutations

    gain = np.random.default_rng(seed).integers(0, 50, (n, m)).astype(float)
    got = special.assignment(gain)
    rows, cols = (range(n), range(m))
    best = max(sum(gain[i, j] for i, j in zip(r, c)) for r in permutations(rows, min(n, m)) for c in [tuple(range(min(n, m)))]) if n >= m else max(sum(gain[i, c[i]] for i in rows) for c in permutations(cols, n))
    assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)
    assert sum(gain[i, j] for i, j in got) == best


def test_mixture_finds_parts():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, 400), rng.normal(2, 0.3, 600)])
    share, mean, dev = special.mixture(x, np.ones(1000))
    assert mean == pytest.approx([0, 2], abs=0.1) and share == pytest.approx([0.4, 0.6], abs=0.05)
    assert (special.posterior(np.array([-0.1, 2.2]), share, mean, dev) == [0, 1]).all()


def test_line_layout_keeps_a_line():
    x = np.array([0.0, 1.0, 3.0, 7.0])
    got = special.line_layout(np.abs(x[:, None] - x[None, :]))
    assert np.abs(got[:, None] - got[None, :]) == pytest.approx(np.abs(x[:, None] - x[None, :]), abs=1e-3)


def test_linkage_and_trees():
    d = np.array([[0, 1, 6, 7], [1, 0, 5, 8], [6, 5, 0, 2], [7, 8, 2, 0.0]])
    merges = special.linkage(d)
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (4, 5)] and merges[-1][2] == 8
    assert special.newick(merges, list("abcd")).count("(") == 3
    assert special.neighbour_joining(d, list("abcd")).endswith(";")


def test_non_negative():
    rng = np.random.default_rng(0)
    a = rng.random((30, 4))
    x = np.array([0.5, 0, 2, 0])
    assert special.non_negative(a, a @ x, 20000) == pytest.approx(x, abs=1e-3)
    w, pairs = special.match_factors(a, a[:, [2, 0, 1, 3]])
    assert dict(pairs) == {0: 1, 1: 2, 2: 0, 3: 3}


def test_delaunay_covers_the_hull():
    p = np.random.default_rng(3).random((60, 2))
    t = special.delaunay(p)
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    area = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum() / 2
    hull = _hull_area(p)
    assert area == pytest.approx(hull, rel=0.02)


def _hull_area(p):
    p = sorted(map(tuple, p))

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = half(p) + half(p[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1]))) / 2


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.05, 0.5))
def test_grid_pairs_are_all_pairs(seed, r):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(-2, 2, (40, 2)), rng.uniform(-2, 2, (30, 2))
    i, j, _ = special.grid_pairs(a, b, r)
    want = {(x, y) for x in range(40) for y in range(30) if np.sqrt(((a[x] - b[y]) ** 2).sum()) <= r}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_helpers():
    assert special.stick_breaking(np.array([0.5, 0.5])).sum() == pytest.approx(1)
    assert special.polya_gamma_mean(1, np.array([0.0, 1e-3])) == pytest.approx([0.25, 0.25], abs=1e-6)
    assert colours.from_hex("#fff") == (1, 1, 1) and colours.to_hex((1, 0, 0)) == "#ff0000"
    at = colours.places(colours.similarity(np.array([[0, 5, 1], [5, 0, 1], [1, 1, 0.0]])), np.array([0.5, 0.3, 0.2]))
    assert ((at >= 0) & (at <= 1)).all() and len(colours.table(at)) == 3 and colours.bar().shape == (16, 256, 3)
