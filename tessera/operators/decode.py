"""Decoding factor probabilities of pixels: spatially coupled variational inference, one tile at a time.

Pixels and anchors of a tile are grouped together; the size of a tile bounds
what a task holds. A pixel in the overlap of tiles belongs to one of them only.
Genes are summed by place before tiles are made, so that a tile has a row of as
many numbers as factors for each place, however many rows of genes there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.special import expected_log, gammaln, grid_pairs
from tessera.operators import quadtree
from tessera.operators.binning import extent, owner, tiled

LEAST_ANCHORS = 10
#: Places of a tile that are inferred together where places do not depend on each other.
SLICE = 50_000
#: Pixels whose inference is one step of array operations.
PART = 8192


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(place, values[:, k], n) for k in range(values.shape[1])]) if values.shape[1] else np.zeros((n, 0))


def edges(pixels: np.ndarray, anchors: np.ndarray, r: float, halflife: float = 0.7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixel, anchor, weight): 1 - (d / r) ** nu, clipped to [.05, .95]; nu makes it one half at ``halflife`` of the radius."""
    i, j, d = grid_pairs(pixels, anchors, r)
    w = 1 - (d / r) ** (math.log(0.5) / math.log(halflife))
    keep = w > 0
    return i[keep], j[keep], np.clip(w[keep], 0.05, 0.95)


def _parts(px: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pixels, their edges): up to ``PART`` pixels with equally many edges, and the numbers of these, a column a pixel."""
    order, many = np.argsort(px, kind="stable"), np.bincount(px, minlength=n)
    first, out = np.cumsum(many) - many, []
    for m in np.unique(many[many > 0]):
        alike = np.flatnonzero(many == m)
        for i in range(0, len(alike), PART):
            at = alike[i : i + PART]
            out.append((at, order[first[at] + np.arange(m)[:, None]]))
    return out


def couple(px: np.ndarray, ax: np.ndarray, w: np.ndarray, n: int, theta: np.ndarray, xb: np.ndarray, rounds: int = 30, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(phi of pixels, gamma of anchors, psi of edges, bound by round).

    ``theta`` is the anchors' prior, ``xb`` the pixels' counts times E[log beta].
    phi: the pixel's factor; psi: the anchor it belongs to; gamma: the anchor's mixture.
    Each pixel has an edge. Pixels with equally many go together, a few thousand at a
    time, so that all steps are on whole rows of numbers that stay in a cache.
    """
    k, parts = theta.shape[1], _parts(px, n)
    held = []
    for at, of in parts:
        mine = w[of]
        held.append((at, of, ax[of], np.log(mine), np.ascontiguousarray(xb[at].T), mine / mine.sum(0)))
    gamma, trail = theta.copy(), []
    phi, psi = np.zeros((n, k)), np.zeros(len(px))
    for _ in range(rounds):
        log_theta = np.ascontiguousarray(expected_log(gamma).T)
        new, bound = theta.T.copy(), 0.0
        for i, (at, of, anchor, log_w, b, share) in enumerate(held):
            lt = log_theta.take(anchor, axis=1)
            s = (lt * share).sum(1)
            z = b + s
            most = z.max(0)
            z = np.exp(z - most)
            all_z = z.sum(0)
            z /= all_z
            score = (lt * z[:, None]).sum(0) + log_w
            top = score.max(0)
            share = np.exp(score - top)
            all_share = share.sum(0)
            share /= all_share
            for f in range(k):
                new[f] += np.bincount(anchor.ravel(), (share * z[f]).ravel(), len(theta))
            # Expected scores and entropies of a place: the logarithms of what divides its two softmaxes.
            bound += float((top + np.log(all_share) + most + np.log(all_z)).sum() - (z * s).sum())
            held[i] = (at, of, anchor, log_w, b, share)
            phi[at] = z.T
        trail.append(bound)
        change = np.abs(new.T - gamma).max(1).mean()
        gamma = np.ascontiguousarray(new.T)
        if change <= tol:
            break
    for at, of, *_, share in held:
        psi[of] = share
    return phi, gamma, psi, trail


def prior(theta: np.ndarray, share: float = 0.2) -> np.ndarray:
    """The anchors' probabilities, clipped to [b, 1 - b] with b = share / K, and made to sum to one."""
    b = share / theta.shape[1]
    t = np.clip(theta, b, 1 - b)
    return t / t.sum(1, keepdims=True)


def decode(pixels: DataFrame, anchors: DataFrame, model: DataFrame, side: float = 500, halo: float = 50, r: float = 25, halflife: float = 0.7, share: float = 0.2, rounds: int = 30, least: int = LEAST_ANCHORS, most: int = 0) -> DataFrame:
    """(X, Y, theta): factor probabilities of pixels (X, Y, gene, Count) that have anchors (x, y, theta) within r.

    ``model`` is (gene, factor, lambda), floored at 0.5; it is collected once:
    its size is features times factors. Tiles with fewer than ``least`` anchors
    are left out. With ``most`` tiles follow the pixels: none has more rows of its
    own, down to tiles as wide as the halo. In one round (``rounds``) no pixel depends
    on another, so tiles have their own pixels only, and infer some at a time.
    """

    def out(tile: Solved) -> dict[str, np.ndarray]:
        return {"X": tile.xy[tile.own, 0], "Y": tile.xy[tile.own, 1], "theta": tile.phi[tile.own]}

    return _tiles(pixels, anchors, model, out, "X double, Y double, theta array<double>", side, halo, r, halflife, share, rounds, least, most, alone=rounds == 1)


def decoded_anchors(pixels: DataFrame, anchors: DataFrame, model: DataFrame, side: float = 500, halo: float = 50, r: float = 25, halflife: float = 0.7, share: float = 0.2, rounds: int = 30, least: int = LEAST_ANCHORS) -> DataFrame:
    """(tx, ty, x, y, avg_size, theta): anchors of each tile after decoding, with the counts of the pixels that belong to them."""

    def out(tile: Solved) -> dict[str, np.ndarray]:
        t = np.exp(expected_log(tile.gamma))
        size = np.bincount(tile.ax, tile.psi * tile.count[tile.px], len(t))
        return {"x": tile.anchors[:, 0], "y": tile.anchors[:, 1], "avg_size": size, "theta": t / t.sum(1, keepdims=True)} | {c: np.full(len(t), v) for c, v in zip(("tx", "ty"), tile.key)}

    return _tiles(pixels, anchors, model, out, "x double, y double, avg_size double, theta array<double>, tx int, ty int", side, halo, r, halflife, share, rounds, least)


@dataclass
class Solved:
    """A tile after inference: linked pixels (place, counts, phi, whether the tile owns them), anchors and edges, sums by factor and gene (if asked for), the last bound and its pieces."""

    key: tuple
    xy: np.ndarray
    count: np.ndarray
    phi: np.ndarray
    own: np.ndarray
    anchors: np.ndarray
    gamma: np.ndarray
    px: np.ndarray
    ax: np.ndarray
    psi: np.ndarray
    stats: np.ndarray | None
    bound: float
    pieces: dict[str, float]


def _tiles(pixels: DataFrame, anchors: DataFrame, model: DataFrame, out: Callable[[Solved], Mapping], schema: str, side: float, halo: float, r: float, halflife: float, share: float, rounds: int, least: int, most: int = 0, alone: bool = False, by_gene: bool = False) -> DataFrame:
    """``out`` of each tile after inference, and of some of its own pixels at a time if these are ``alone``; ``by_gene`` for sums by factor and gene.

    What ``out`` gives for an array of the schema is a matrix with a column for each
    factor: these leave Python as columns of numbers, and not as an object for each row.
    """
    wide = model.toPandas().pivot_table(index="gene", columns="factor", values="lambda", aggfunc="sum", fill_value=0.0)
    log_beta = expected_log(np.maximum(wide.to_numpy(float), 0.5).T)
    genes, sums = [str(g) for g in wide.index], [f"b{k}" for k in range(len(log_beta))]
    box = extent(pixels)
    if box[0] is None:
        return pixels.sparkSession.createDataFrame([], schema)
    x0, x1, y0, y1 = box
    rows = pixels.select("X", "Y", F.col("gene").cast("string").alias("gene"), F.col("Count").cast("double").alias("n"))
    known = pixels.sparkSession.createDataFrame(pd.DataFrame({"gene": genes, "i": np.arange(len(genes))} | dict(zip(sums, log_beta))), "gene string, i int" + "".join(f", {b} double" for b in sums))
    p = rows.join(F.broadcast(known), "gene")
    if by_gene:
        p = p.groupBy("X", "Y", "i").agg(F.sum("n").alias("n"), *(F.first(b).alias(b) for b in sums))
    else:
        p = p.groupBy("X", "Y").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(b)).alias(b) for b in sums))
    # Anchors reach a tile from r around it.
    a = anchors.select(F.col("x").alias("ax"), F.col("y").alias("ay"), "theta").filter(F.col("ax").between(x0 - r, x1 + r) & F.col("ay").between(y0 - r, y1 + r))
    if most:
        cells = quadtree.Cells.over(box, max(halo, r))
        found = quadtree.leaves(rows, cells, most).persist()
        p, spread = (quadtree.spread(t, quadtree.around(found, cells, d), cells, d, *at_) for t, d, at_ in ((p, 0.0 if alone else halo, ("X", "Y")), (a, halo + r, ("ax", "ay"))))
        tile_of = quadtree.NODE
    else:
        p = tiled(p, side, halo, box=box)
        p = p.withColumn("own", (F.col("tx") == owner(F.col("X"), x0, x1, side, halo)) & (F.col("ty") == owner(F.col("Y"), y0, y1, side, halo)))
        p = p.filter("own") if alone else p
        hold = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
        near = F.array(*(F.struct(hold(F.col("ax") + dx, x0, x1).alias("X"), hold(F.col("ay") + dy, y0, y1).alias("Y")) for dx in (-r, 0.0, r) for dy in (-r, 0.0, r)))
        spread = tiled(a.select("*", F.inline(F.array_distinct(near))), side, halo, box=box).dropDuplicates(["tx", "ty", "ax", "ay"])
        tile_of = ["tx", "ty"]
    fields = [x.split() for x in schema.split(", ")]
    flat = [(f"{c}_{k}" if t == "array<double>" else c, t.removeprefix("array<").removesuffix(">")) for c, t in fields for k in range(len(sums) if t == "array<double>" else 1)]
    whole = [F.array(*(f"{c}_{k}" for k in range(len(sums)))).alias(c) if t == "array<double>" else F.col(c) for c, t in fields]

    def solved(key, xy: np.ndarray, own: np.ndarray, count: np.ndarray, xb: np.ndarray, near: np.ndarray, theta: np.ndarray, sums_of: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> Solved | None:
        px, ax, w = edges(xy, near, r, halflife)
        linked = np.unique(px)
        if not len(linked):
            return None
        renumber = np.full(len(xy), -1)
        renumber[linked] = np.arange(len(linked))
        px, xb = renumber[px], xb[linked]
        phi, gamma, psi, trail = couple(px, ax, w, len(linked), theta, xb, rounds)
        pixel, log_theta = float((phi * xb).sum()), expected_log(gamma)
        pieces = {"pixel": pixel, "patch": trail[-1] - pixel, "gamma": float(((theta - gamma) * log_theta + gammaln(gamma)).sum() - gammaln(gamma.sum(1)).sum())}
        stats = sums_of(np.where(own, renumber, -1), phi) if sums_of else None
        return Solved(key, xy[linked], count[linked], phi, own[linked], near, gamma, px, ax, psi, stats, trail[-1], pieces)

    def one(key, tile: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: np.zeros(0, {"double": float, "int": int}.get(t, object)) for c, t in flat})
        if len(near) < least or not len(tile):
            return none
        near = near.sort_values(["ax", "ay"])
        theta, near = prior(np.array(near.theta.tolist(), float), share), near[["ax", "ay"]].to_numpy(float)
        tile = tile.iloc[np.lexsort((*((tile.i,) if by_gene else ()), tile.Y, tile.X))]
        xy, own, count, xb, sums_of = tile[["X", "Y"]].to_numpy(float), tile.own.to_numpy(bool), tile.n.to_numpy(float), tile[sums].to_numpy(float), None
        if by_gene:
            first = np.append(True, (xy[1:] != xy[:-1]).any(1))
            place, gene, counts = np.cumsum(first) - 1, tile.i.to_numpy(int), count
            xy, own, count, xb = xy[first], own[first], np.bincount(place, counts), _sums(place, counts[:, None] * xb, int(first.sum()))

            def sums_of(mine: np.ndarray, phi: np.ndarray) -> np.ndarray:
                used = mine[place] >= 0
                at, which, n = mine[place][used], gene[used], counts[used]
                return np.stack([np.bincount(which, n * phi[at, k], len(genes)) for k in range(phi.shape[1])])

        step = SLICE if alone else len(xy)
        every = (solved(key, xy[i : i + step], own[i : i + step], count[i : i + step], xb[i : i + step], near, theta, sums_of) for i in range(0, len(xy), step))
        return pd.concat([columns(out(done)) for done in every if done] or [none])

    def columns(got: Mapping) -> pd.DataFrame:
        return pd.DataFrame({f"{c}_{k}" if t == "array<double>" else c: v for c, t in fields for k, v in (enumerate(got[c].T) if t == "array<double>" else [(0, got[c])])})

    tiles = p.drop("tile_id").groupBy(*tile_of).cogroup(spread.drop("tile_id").groupBy(*tile_of))
    return tiles.applyInPandas(one, ", ".join(f"{c} {t}" for c, t in flat)).select(*whole)


def bound_pieces(pixels: DataFrame, anchors: DataFrame, model: DataFrame, eta: float = 0.1, side: float = 500, halo: float = 50, r: float = 25, halflife: float = 0.7, share: float = 0.2, rounds: int = 30, least: int = LEAST_ANCHORS, most: int = 0) -> DataFrame:
    """(piece, value): the parts of the bound over all tiles, up to constants.

    ``pixel``: the pixels' counts given their factors; ``patch``: the pixels'
    factors and anchors given the anchors' mixtures; ``gamma``: the mixtures given
    their prior; ``beta``: the genes' shares given ``eta``; and their ``total``.
    Pixels in the halo of several tiles count in each.
    """

    def out(tile: Solved) -> pd.DataFrame:
        return pd.DataFrame({"piece": list(tile.pieces), "value": list(tile.pieces.values())})

    by = _tiles(pixels, anchors, model, out, "piece string, value double", side, halo, r, halflife, share, rounds, least, most).groupBy("piece").agg(F.sum("value").alias("value"))
    wide = model.toPandas().pivot_table(index="gene", columns="factor", values="lambda", aggfunc="sum", fill_value=0.0)
    lam = np.maximum(wide.to_numpy(float), 0.5).T
    beta = float(((eta - lam) * expected_log(lam) + gammaln(lam)).sum() - gammaln(lam.sum(1)).sum())
    every = by.unionByName(pixels.sparkSession.createDataFrame([("beta", beta)], "piece string, value double"))
    return every.unionByName(every.agg(F.sum("value").alias("value")).select(F.lit("total").alias("piece"), "value"))


def decontaminated(lam: np.ndarray, theta: np.ndarray, links: np.ndarray, zeta: float, rounds: int = 30, tol: float = 1e-4) -> np.ndarray:
    """Factor by gene sums less a share ``zeta`` of what spatial neighbours may have leaked into them.

    ``links`` are pairs of neighbouring anchors, each in both directions; an
    anchor is its own neighbour besides. Factors keep their totals.
    """
    n, total = len(theta), lam.sum(1, keepdims=True)
    pairs = np.concatenate([np.asarray(links, int).reshape(-1, 2), np.repeat(np.arange(n)[:, None], 2, axis=1)])
    degree = np.bincount(pairs[:, 0], minlength=n)
    around = _sums(pairs[:, 0], theta[pairs[:, 1]], n) / degree[:, None]
    near = theta.T @ around / theta.sum(0)[:, None]
    np.fill_diagonal(near, 0)
    for _ in range(rounds):
        rest = np.maximum(lam - zeta * total * (near @ (lam / lam.sum(1, keepdims=True))), 0)
        new = rest / rest.sum(1, keepdims=True) * total
        change = (np.abs(new - lam).max(1) / lam.sum(1)).mean()
        lam = new
        if change <= tol:
            break
    return lam


def learned(pixels: DataFrame, anchors: DataFrame, model: DataFrame, steps: int = 3, tau0: float = 1.0, kappa: float = 0.7, eta: float = 0.1, zeta: float = 0.0, side: float = 500, halo: float = 50, r: float = 25, **options) -> tuple[DataFrame, list[float]]:
    """(model (gene, factor, lambda), bound by step): the model learned further from the pixels themselves.

    A step infers all tiles, sums expected counts by factor and gene, and moves
    the model by (tau0 + step) ** -kappa. With ``zeta`` the sums of each tile are
    freed of what neighbouring factors leaked in. What comes to the driver is as
    large as the model.
    """
    spark, bounds = pixels.sparkSession, []
    o = {"halflife": 0.7, "share": 0.2, "rounds": 30, "least": LEAST_ANCHORS} | options

    def sums(tile: Solved) -> pd.DataFrame:
        stats = tile.stats + eta
        if zeta > 0:
            i, j, d = grid_pairs(tile.anchors, tile.anchors, 2 * r)
            stats = decontaminated(stats, tile.gamma / tile.gamma.sum(1, keepdims=True), np.stack([i, j], 1)[d > 0], zeta)
        k, g = np.indices(stats.shape)
        return pd.DataFrame({"factor": np.append(k.ravel(), -1), "gene": np.append(g.ravel(), 0), "v": np.append(stats.ravel(), tile.bound)})

    for step in range(steps):
        rows = model.toPandas().pivot_table(index="gene", columns="factor", values="lambda", aggfunc="sum", fill_value=0.0)
        got = _tiles(pixels, anchors, model, sums, "factor int, gene int, v double", side, halo, r, by_gene=True, **o).groupBy("factor", "gene").agg(F.sum("v").alias("v")).toPandas()
        bounds.append(float(got.loc[got.factor < 0, "v"].sum()))
        got, new = got[got.factor >= 0], np.zeros(rows.shape)
        new[got.gene.to_numpy(), got.factor.to_numpy()] = got.v.to_numpy()
        rho = (tau0 + step) ** -kappa
        lam = (1 - rho) * rows.to_numpy(float) + rho * new
        k, g = np.indices(lam.T.shape)
        model = spark.createDataFrame(pd.DataFrame({"gene": rows.index.astype(str).to_numpy()[g.ravel()], "factor": rows.columns.to_numpy(int)[k.ravel()], "lambda": lam.T.ravel()}), "gene string, factor int, `lambda` double")
    return model, bounds


def pixel_posterior_counts(decoded: DataFrame, pixels: DataFrame) -> DataFrame:
    """(gene, factor, cnt): expected counts over the decoded pixels."""
    both = pixels.select("X", "Y", "gene", "Count").join(decoded, ["X", "Y"])
    return both.select("gene", "Count", F.posexplode("theta").alias("factor", "p")).groupBy("gene", "factor").agg(F.sum(F.col("p") * F.col("Count")).alias("cnt"))
