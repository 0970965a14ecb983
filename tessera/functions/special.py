"""Special functions and small dense algorithms in numpy: what neither Spark SQL nor the environment has.

All of these take objects whose size is bounded by factors and features, never by rows of data.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of gamma for positive x: shifted to 6 and above, then the asymptotic series."""
    x = np.asarray(x, float)
    out, z = np.zeros_like(x), x.copy()
    for _ in range(6):
        small = z < 6
        if not small.any():
            break
        out = np.where(small, out - 1 / np.where(small, z, 1.0), out)
        z = np.where(small, z + 1, z)
    w = 1 / (z * z)
    return out + np.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w * (1 / 132)))))


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def gammaln(x: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def logsumexp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.log(np.sum(np.exp(x - top), axis=axis)) + np.squeeze(top, axis=axis)


def expected_log(a: np.ndarray) -> np.ndarray:
    """E[log Dirichlet(a)] by row."""
    return digamma(a) - digamma(a.sum(axis=-1, keepdims=True))


def expit(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def logit(c: Column) -> Column:
    return F.log(c / (F.lit(1.0) - c))


def chi2_tail(x: float) -> float:
    """P(chi-square with one degree of freedom > x)."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def neglog10_tail(x: float) -> float:
    """-log10 of the tail; by its asymptotic form where the tail is too small for a double."""
    if x <= 1000:
        return -math.log10(chi2_tail(x))
    return x / (2 * math.log(10)) + 0.5 * math.log10(math.pi * x / 2) - math.log10(1 - 1 / x + 3 / (x * x))


def critical(p: float) -> float:
    """The chi-square value whose tail is p."""
    lo, hi = 0.0, 1500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid) > p else (lo, mid)
    return hi


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series) -> pd.Series:
    return x.map(chi2_tail, na_action="ignore")


@F.pandas_udf(DoubleType())
def neglog10_pvalue(x: pd.Series) -> pd.Series:
    return x.map(neglog10_tail, na_action="ignore")


@F.pandas_udf(DoubleType())
def digamma_of(x: pd.Series) -> pd.Series:
    return pd.Series(digamma(x.to_numpy(float)))


def stick_breaking(v: np.ndarray) -> np.ndarray:
    """Probabilities of a stick-breaking process from its fractions, by row; one more than fractions."""
    v = np.atleast_2d(v)
    left = np.cumprod(np.hstack([np.ones((len(v), 1)), 1 - v]), axis=1)
    return left * np.hstack([v, np.ones((len(v), 1))])


def polya_gamma_mean(b: float, c: np.ndarray) -> np.ndarray:
    """The mean of PG(b, c): b / 2c tanh(c / 2), b / 4 at zero."""
    c = np.asarray(c, float)
    safe = np.where(np.abs(c) < 1e-8, 1.0, c)
    return np.where(np.abs(c) < 1e-8, b / 4, b / (2 * safe) * np.tanh(safe / 2))


def nearest_point(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, r: float) -> np.ndarray:
    """For each place the number of the nearest point nearer than r, or -1; equal distances by px, then py.

    Points lie in rows, in the order of px. The neighbours along the rows around a
    place give a bound; the points within that bound are then compared exactly.
    """
    out, x, y, px, py = np.full(len(x), -1), *(np.asarray(v, float) for v in (x, y, px, py))
    if not len(x) or not len(px):
        return out
    x0, y0 = min(x.min(), px.min()), py.min()
    wide, high = max(x.max(), px.max()) - x0, py.max() - y0
    h = min(max(math.sqrt(max(wide, r) * max(high, r) / len(px)), r / 32), r)
    row, stride = np.floor((py - y0) / h), wide + 4 * r
    key = row * stride + (px - x0)
    order = np.argsort(key, kind="stable")
    key, slack = key[order], 1e-12 * (np.abs(key).max() + stride)
    steps = sorted(range(-int(r // h) - 2, int(r // h) + 3), key=abs)
    for a in range(0, len(x), 1 << 15):
        qx, qy = x[a : a + (1 << 15)], y[a : a + (1 << 15)]
        line, best = np.floor((qy - y0) / h), np.full(len(qx), float(r))

        def apart(s: int, i: np.ndarray) -> np.ndarray:  # of the row s steps on
            return np.maximum((s * h - (qy[i] - y0 - line[i] * h) if s > 0 else qy[i] - y0 - (line[i] + s + 1) * h if s < 0 else np.zeros(len(i))) - slack, 0.0)

        every = np.arange(len(qx))
        for s in steps:
            i = every[apart(s, every) < best]
            at = np.searchsorted(key, (line[i] + s) * stride + (qx[i] - x0))
            for j in (np.maximum(at - 1, 0), np.minimum(at, len(key) - 1)):
                dx, dy = qx[i] - px[order[j]], qy[i] - py[order[j]]
                best[i] = np.minimum(best[i], np.sqrt(dx * dx + dy * dy))
        pairs = []
        for s in steps:
            gap = apart(s, every)
            i = every[gap <= best]
            reach, middle = np.sqrt(best[i] ** 2 - gap[i] ** 2) + slack, (line[i] + s) * stride + (qx[i] - x0)
            lo, hi = np.searchsorted(key, middle - reach - slack), np.searchsorted(key, middle + reach + slack, "right")
            n = hi - lo
            i, j = np.repeat(i, n), order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            dx, dy = qx[i] - px[j], qy[i] - py[j]
            d = np.sqrt(dx * dx + dy * dy)
            keep = (d <= best[i]) & (d < r)
            pairs.append((i[keep], j[keep], d[keep]))
        i, j, d = (np.concatenate(v) for v in zip(*pairs))
        first = np.lexsort((py[j], px[j], d, i))
        i, at = np.unique(i[first], return_index=True)
        out[a + i] = j[first][at]
    return out


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns with the greatest sum: shortest augmenting paths, O(n^3)."""
    gain = np.asarray(gain, float)
    if gain.size == 0:
        return []
    turned = gain.shape[0] > gain.shape[1]
    cost = (gain.max() - gain).T if turned else gain.max() - gain
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j = row, -1
        while True:
            reduced = cost[i] - u[i] - v
            better = ~done & (reduced < least)
            least[better], via[better] = reduced[better], j
            nxt = int(np.argmin(np.where(done, np.inf, least)))
            step = least[nxt]
            u[row] += step
            for x in np.flatnonzero(done):
                u[match[x]] += step
            v[done] -= step
            least[~done] -= step
            done[nxt], j = True, nxt
            if match[nxt] < 0:
                break
            i = match[nxt]
        while j >= 0:
            k = via[j]
            match[j] = row if k < 0 else match[k]
            j = k
    pairs = [(int(r), c) for c, r in enumerate(match) if r >= 0]
    return sorted((c, r) if turned else (r, c) for r, c in pairs)


def mixture(values: np.ndarray, weights: np.ndarray, parts: int = 2, rounds: int = 500, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares, means, deviations) of a normal mixture on weighted values, ascending by mean.

    Expectation maximisation from quantiles, so that it needs no seed.
    """
    order = np.argsort(values)
    x, w = np.asarray(values, float)[order], np.asarray(weights, float)[order]
    at = np.searchsorted(np.cumsum(w) / w.sum(), (np.arange(parts) + 0.5) / parts)
    mean = x[np.minimum(at, len(x) - 1)].astype(float)
    spread = max(float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))), 1e-3)
    dev, share, last = np.full(parts, spread / parts), np.full(parts, 1 / parts), -np.inf
    for _ in range(rounds):
        log = np.log(share) - np.log(dev) - 0.5 * ((x[:, None] - mean) / dev) ** 2
        total = logsumexp(log, 1)
        post = np.exp(log - total[:, None]) * w[:, None]
        n = post.sum(0) + 1e-12
        share, mean = n / n.sum(), (post * x[:, None]).sum(0) / n
        dev = np.sqrt((post * (x[:, None] - mean) ** 2).sum(0) / n + 1e-6)
        now = float((total * w).sum() / w.sum())
        if abs(now - last) < tol:
            break
        last = now
    rank = np.argsort(mean)
    return share[rank], mean[rank], dev[rank]


def posterior(x: np.ndarray, share: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    """The likeliest part of each value."""
    return np.argmax(np.log(share) - np.log(dev) - 0.5 * ((np.asarray(x, float)[:, None] - mean) / dev) ** 2, axis=1)


def line_layout(distance: np.ndarray, rounds: int = 300, seed: int = 0, starts: int = 4) -> np.ndarray:
    """Places on a line for given dissimilarities, by majorisation of the stress; the best of some seeded starts."""
    d = (np.asarray(distance, float) + np.asarray(distance, float).T) / 2
    k, rng, best, least = len(d), np.random.default_rng(seed), np.zeros(len(d)), np.inf
    for _ in range(starts):
        x = rng.uniform(size=k)
        for _ in range(rounds):
            gap = x[:, None] - x[None, :]
            ratio = np.where(gap == 0, 0.0, d / np.where(gap == 0, 1.0, np.abs(gap)))
            b = -ratio
            b[np.arange(k), np.arange(k)] = ratio.sum(1)
            new = b @ x / k
            if np.abs(new - x).max() < 1e-9:
                break
            x = new
        stress = ((np.abs(x[:, None] - x[None, :]) - d) ** 2).sum()
        if stress < least:
            best, least = x, stress
    return best


def circle_layout(similar: np.ndarray, rounds: int = 500, seed: int = 0, rate: float = 0.1) -> np.ndarray:
    """Angles in [0, 2 pi) that put what is alike far apart: projected gradient on unit vectors."""
    s, rng = np.asarray(similar, float), np.random.default_rng(seed)
    a = rng.uniform(0, 2 * np.pi, len(s))
    for _ in range(rounds):
        gap = a[:, None] - a[None, :]
        a = a + rate * (s * np.sin(gap)).sum(1) / max(1e-12, s.sum(1).max())
    return np.mod(a, 2 * np.pi)


def linkage(distance: np.ndarray, kind: str = "complete") -> list[tuple[int, int, float, int]]:
    """Agglomerative clustering of a distance matrix: (a, b, height, size) for each merge; new clusters are numbered from n."""
    d = np.asarray(distance, float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), [1] * n, []
    join = {"complete": np.maximum, "single": np.minimum}
    while len(name) > 1:
        i, j = sorted(divmod(int(np.argmin(d)), len(d)))
        height = d[i, j]
        merged = join[kind](d[i], d[j]) if kind in join else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        out.append((name[i], name[j], float(height), size[i] + size[j]))
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        name[i], size[i] = n + len(out) - 1, size[i] + size[j]
        d = np.delete(np.delete(d, j, 0), j, 1)
        del name[j], size[j]
    return out


def newick(merges: list[tuple[int, int, float, int]], names: list[str]) -> str:
    """A tree of merges as Newick text."""
    at, height = dict(enumerate(names)), dict.fromkeys(range(len(names)), 0.0)
    for k, (a, b, h, _) in enumerate(merges):
        at[len(names) + k] = f"({at[a]}:{h - height[a]:.6g},{at[b]}:{h - height[b]:.6g})"
        height[len(names) + k] = h
    return f"{at[len(names) + len(merges) - 1]};" if names else ";"


def neighbour_joining(distance: np.ndarray, names: list[str]) -> str:
    """A neighbour-joining tree as Newick text."""
    d, at = np.asarray(distance, float).copy(), list(names)
    while len(at) > 2:
        n, total = len(at), d.sum(1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(np.argmin(q)), n))
        li = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        new = (d[i] + d[j] - d[i, j]) / 2
        at[i] = f"({at[i]}:{li:.6g},{at[j]}:{d[i, j] - li:.6g})"
        d[i], d[:, i], d[i, i] = new, new, 0.0
        d = np.delete(np.delete(d, j, 0), j, 1)
        del at[j]
    return f"({at[0]}:{d[0, 1] / 2:.6g},{at[1]}:{d[0, 1] / 2:.6g});" if len(at) == 2 else f"{''.join(at)};"


def rank_distance(m: np.ndarray, log: bool = False) -> np.ndarray:
    """One minus the correlation of ranks (or of their logarithms) between columns."""
    rank = np.argsort(np.argsort(-np.asarray(m, float), axis=0, kind="stable"), axis=0) + 1.0
    return 1 - np.corrcoef((np.log(rank) if log else rank).T)


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient."""
    ata, atb = a.T @ a, a.T @ b
    rate = 1 / max(np.linalg.eigvalsh(ata)[-1], 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - rate * (ata @ y - atb))
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def match_factors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weights, pairs): columns of ``b`` as non-negative sums of columns of ``a``, and the best one-to-one pairs."""
    w = np.column_stack([non_negative(a, b[:, j]) for j in range(b.shape[1])])
    return w, assignment(w)


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of point numbers) by incremental insertion; for the points of one block."""
    p = np.asarray(points, float)
    if len(p) < 3:
        return np.zeros((0, 3), int)
    mid, span = p.mean(0), max(float(np.ptp(p, axis=0).max()), 1.0) * 64
    # A lattice has many points on one circle; a tiny seeded shift makes the triangulation unique.
    jitter = np.random.default_rng(1).uniform(-1e-7, 1e-7, p.shape) * max(float(np.ptp(p, axis=0).max()), 1.0)
    q = np.vstack([p + jitter, mid + [-span, -span], mid + [span, -span], mid + [0, span]])
    n = len(p)
    tri = np.array([[n, n + 1, n + 2]])
    circle = _circle(q, tri)
    for i in range(n):
        bad = ((circle[:, :2] - q[i]) ** 2).sum(1) < circle[:, 2]
        edges = np.sort(np.vstack([tri[bad][:, x] for x in ([0, 1], [1, 2], [2, 0])]), axis=1)
        seen, count = np.unique(edges, axis=0, return_counts=True)
        rim = seen[count == 1]
        new = np.column_stack([rim, np.full(len(rim), i)])
        tri, circle = np.vstack([tri[~bad], new]), np.vstack([circle[~bad], _circle(q, new)])
    return tri[(tri < n).all(1)]


def _circle(q: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius of each triangle's circumscribed circle."""
    a, b, c = q[tri[:, 0]], q[tri[:, 1]], q[tri[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    d = np.where(d == 0, 1e-30, d)
    bb, cc = (b**2).sum(1), (c**2).sum(1)
    u = np.column_stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d])
    return np.column_stack([u + a, (u**2).sum(1)])


def grid_pairs(points: np.ndarray, anchors: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, anchor, distance) of all pairs within r, by a bucket grid."""
    if not len(points) or not len(anchors):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    cell = np.floor(anchors / r).astype(np.int64)
    base, span = cell.min(0) - 1, int(np.ptp(cell[:, 1])) + 4
    key = (cell[:, 0] - base[0]) * span + cell[:, 1] - base[1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    place = np.floor(points / r).astype(np.int64) - base
    out = []
    for i, j in product((-1, 0, 1), repeat=2):
        y = place[:, 1] + j
        k = (place[:, 0] + i) * span + y
        lo, hi = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
        n = np.where((y >= 0) & (y < span), hi - lo, 0)
        pi = np.repeat(np.arange(len(points)), n)
        ai = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        d = np.sqrt(((points[pi] - anchors[ai]) ** 2).sum(1))
        keep = d <= r
        out.append((pi[keep], ai[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))
