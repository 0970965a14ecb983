"""Regions: density mixture, cutoffs, outlines of dense places, and filters of pixels by them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hexgrid import area_of, radius_of
from tessera.functions.special import delaunay, mixture, posterior
from tessera.operators.binning import hex_units, minor_windows
from tessera.operators.spatial import bucket, near_any


@dataclass
class Cutoffs:
    """Counts in a hexagon from which pixels (lenient) and features (strict) are kept."""

    lenient: float
    strict: float
    dense_mean: float
    sparse_mean: float


def density_cutoffs(units: DataFrame, width: float, quartile: int = 2, least_dense: float = 0.1, hard: float = 0.0, mixture_bound: bool = False) -> Cutoffs:
    """Cutoffs from a mixture of two normals on the logarithms of units' counts.

    Counts are integers, so the table of how often each count occurs holds the
    whole distribution; the fit sees every unit, and the driver as many rows as
    there are different counts.
    """
    table = units.groupBy(F.rint("tot").alias("tot")).agg(F.count("*").alias("n")).toPandas().sort_values("tot")
    area = area_of(width)
    if len(table) < 2:
        only = float(table.tot.min()) if len(table) else 0.0
        return Cutoffs(only, max(only, least_dense * area), only, only)
    x, w = np.log10(table.tot.to_numpy(float)), table.n.to_numpy(float)
    share, mean, dev = mixture(x, w)
    kept = table[posterior(x, share, mean, dev) == 1]
    kept = kept if len(kept) else table
    values, many = kept.tot.to_numpy(float), kept.n.to_numpy()
    ends = np.cumsum(many)

    def quantile(q: float) -> float:  # linear between the ranks of all units
        at = q * (ends[-1] - 1)
        lo, hi = values[np.searchsorted(ends, int(at), "right")], values[np.searchsorted(ends, int(np.ceil(at)), "right")]
        return float(lo + (hi - lo) * (at - int(at)))

    quantiles = [quantile(q) for q in (0, 0.25, 0.5, 0.75)]
    lenient = quantiles[0] if mixture_bound else 0.75 * quantiles[0] + 0.25 * quantiles[1]
    if hard > 0:
        strict = hard * area
    else:
        strict = max(quantiles[quartile] if quartile > 0 else lenient, least_dense * area)
    return Cutoffs(lenient, strict, float(10 ** mean[1]), float(10 ** mean[0]))


def triangles(centres: DataFrame, longest: float, block: float | None = None) -> DataFrame:
    """(x1, y1, x2, y2, x3, y3): Delaunay triangles of points whose edges are all shorter than ``longest``.

    Triangulated by blocks with a margin of twice that length, of which a
    triangle's own block keeps it; a task holds the points of one block.
    """
    side, margin = block or 4 * longest, 2 * longest
    at = F.array(*(F.struct(bucket(F.col("x") + dx, side).alias("bx"), bucket(F.col("y") + dy, side).alias("by")) for dx in (-margin, 0.0, margin) for dy in (-margin, 0.0, margin)))
    dealt = centres.select("x", "y").distinct().select("x", "y", F.inline(F.array_distinct(at)))

    def one(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        p = points[["x", "y"]].sort_values(["x", "y"]).to_numpy(float)
        t = p[delaunay(p)]
        if not len(t):
            return pd.DataFrame({c: [] for c in ("x1", "y1", "x2", "y2", "x3", "y3")})
        edge = np.sqrt(((t - np.roll(t, 1, axis=1)) ** 2).sum(2)).max(1)
        home = np.floor(t.mean(1) / side).astype(int)
        t = t[(edge < longest) & (home[:, 0] == key[0]) & (home[:, 1] == key[1])]
        return pd.DataFrame(t.reshape(-1, 6), columns=["x1", "y1", "x2", "y2", "x3", "y3"])

    return dealt.groupBy("bx", "by").applyInPandas(one, "x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")


def _reached(x: Column, y: Column, reach: float) -> Column:
    """Whether a point is within ``reach`` of the triangle x1 ... y3, inside it included."""

    def side(a: str, b: str) -> Column:
        return (F.col(f"x{b}") - F.col(f"x{a}")) * (y - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (x - F.col(f"x{a}"))

    def far(a: str, b: str) -> Column:
        ux, uy = F.col(f"x{b}") - F.col(f"x{a}"), F.col(f"y{b}") - F.col(f"y{a}")
        along = F.least(F.greatest(((x - F.col(f"x{a}")) * ux + (y - F.col(f"y{a}")) * uy) / F.greatest(ux * ux + uy * uy, F.lit(1e-30)), F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - F.col(f"x{a}") - along * ux, y - F.col(f"y{a}") - along * uy)

    s = [side("1", "2"), side("2", "3"), side("3", "1")]
    within = ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
    return within | (F.least(far("1", "2"), far("2", "3"), far("3", "1")) <= F.lit(float(reach)))


def _celled(tri: DataFrame, buffer: float, width: float) -> DataFrame:
    """Triangles under the cells (_bx, _by) that their box, wider by the buffer, touches."""
    ends = lambda f, c: f(*(F.col(f"{c}{i}") for i in (1, 2, 3)))

    def cells(c: str) -> Column:
        return F.sequence(bucket(ends(F.least, c) - buffer, width), bucket(ends(F.greatest, c) + buffer, width))

    return tri.withColumn("_bx", F.explode(cells("x"))).withColumn("_by", F.explode(cells("y")))


def in_triangles(pixels: DataFrame, tri: DataFrame, buffer: float) -> DataFrame:
    """Pixels within ``buffer`` of a triangle.

    Small cells that are covered as a whole are found from the triangles alone;
    pixels there need an equi-join only. The others, along the rim, are measured
    against the triangles of their cell.
    """
    fine, coarse = buffer / 2, 2.0 * buffer
    middle = lambda c: (F.col(c) + F.lit(0.5)) * F.lit(fine)
    covered = _celled(tri, buffer, fine).filter(_reached(middle("_bx"), middle("_by"), buffer - fine * 0.5**0.5)).select("_bx", "_by").distinct()
    p = pixels.withColumns({"_bx": bucket(F.col("X"), fine), "_by": bucket(F.col("Y"), fine)})
    sure = p.join(covered, ["_bx", "_by"], "left_semi").drop("_bx", "_by")
    rim = p.join(covered, ["_bx", "_by"], "left_anti").withColumns({"_px": bucket(F.col("X"), coarse), "_py": bucket(F.col("Y"), coarse)}).drop("_bx", "_by")
    t = _celled(tri, buffer, coarse)
    near = rim.join(t, (F.col("_px") == F.col("_bx")) & (F.col("_py") == F.col("_by")) & _reached(F.col("X"), F.col("Y"), buffer), "left_semi").drop("_px", "_py")
    return sure.unionByName(near)


def filter_by_density(pixels: DataFrame, width: float | None = None, radius: float = 15, n_move: int = 2, key: str = "Count", least: float = 0.02, min_area: float = 0.0, **options) -> tuple[DataFrame, DataFrame, Cutoffs]:
    """(pixels in the lenient region, feature totals in the strict region, cutoffs)."""
    width = width or radius * 3**0.5
    units = hex_units(pixels, width, n_move, key, min_ct=0, density=least).persist()
    cut = density_cutoffs(units, width, **options)
    lenient, strict = (x.persist() for x in _regions(units, cut, width, min_area))
    kept = in_triangles(pixels, lenient, radius_of(width))
    totals = in_triangles(pixels, strict, radius_of(width)).groupBy("gene").agg(F.sum(key).alias("total"))
    return kept, totals, cut


def _regions(units: DataFrame, cut: Cutoffs, width: float, min_area: float = 0.0) -> tuple[DataFrame, DataFrame]:
    longest = 2 * 3**0.5 * radius_of(width)
    out = (triangles(units.filter(F.col("tot") >= c), longest) for c in (cut.lenient, cut.strict))
    return tuple(large(x, min_area) if min_area > 0 else x for x in out)


def dense_triangles(pixels: DataFrame, cut: Cutoffs, width: float | None = None, radius: float = 15, n_move: int = 2, key: str = "Count", least: float = 0.02, min_area: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The triangles of the lenient and of the strict region for given cutoffs."""
    width = width or radius * 3**0.5
    return _regions(hex_units(pixels, width, n_move, key, min_ct=0, density=least), cut, width, min_area)


def large(tri: DataFrame, area: float, rounds: int = 50) -> DataFrame:
    """Triangles of connected groups with at least this area; triangles that share a corner are connected."""
    t = tri.withColumn("id", F.xxhash64("x1", "y1", "x2", "y2", "x3", "y3")).persist()
    corner = t.select("id", F.explode(F.array(*(F.struct(F.round(f"x{i}", 6).alias("x"), F.round(f"y{i}", 6).alias("y")) for i in (1, 2, 3)))).alias("c"))
    label = t.select("id", F.col("id").alias("g"))
    for i in range(rounds):
        by = corner.join(label, "id").groupBy("c").agg(F.min("g").alias("g"))
        new = corner.join(by, "c").groupBy("id").agg(F.min("g").alias("g")).persist()
        moved = new.join(label.withColumnRenamed("g", "was"), "id").filter("g <> was").limit(1).count()
        label = new.checkpoint() if i % 10 == 9 and t.sparkSession.sparkContext.getCheckpointDir() else new
        if not moved:
            break
    size = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / 2
    both = t.join(label, "id").withColumn("_a", size)
    keep = both.groupBy("g").agg(F.sum("_a").alias("_s")).filter(F.col("_s") >= area)
    return both.join(keep, "g", "left_semi").drop("g", "_a", "id")


def window_cut(counts: np.ndarray, many: np.ndarray, area: float, least_dense: float) -> float:
    """The least count of a dense unit in a window, from the table of its units' counts.

    Two normals on the logarithms; three where the sparse part is more than half
    as dense as the dense one, or the dense one too sparse. If it still is too
    sparse, the least density itself; if two parts are nearly as dense, all units.
    """
    if len(counts) < 2:
        return float(counts[0]) if len(counts) else 0.0
    x, w, dense, next_, cut = np.log10(counts), many.astype(float), 0.0, 0.0, 0.0
    for parts in (2, 3):
        share, mean, dev = mixture(x, w, parts)
        kept = counts[posterior(x, share, mean, dev) == parts - 1]
        dense, next_ = 10 ** mean[-1] / area, 10 ** mean[-2] / area
        cut = float(kept.min()) if len(kept) else float(counts.max())
        if next_ <= 0.5 * dense and dense >= least_dense:
            break
    if dense < least_dense:
        return least_dense * area
    return float(counts.min()) if next_ > 0.7 * dense else cut


def dense_anchors(pixels: DataFrame, width: float = 24, n_move: int = 2, least: float = 0.02, least_dense: float = 0.1, windows: int = 1, axis: str = "Y", precision: float = 0.0, hard: float = 0.0) -> DataFrame:
    """(x, y): centres of dense units, judged apart in windows of equal width along an axis and for each lattice offset.

    What comes to the driver is the table of different counts by window and offset.
    """
    lo, hi = pixels.agg(F.min(axis), F.max(axis)).first()
    if lo is None:
        return pixels.sparkSession.createDataFrame([], "x double, y double")
    place = F.least(F.greatest(minor_windows(F.col(axis), lo, (hi - lo + 1) / windows), F.lit(0)), F.lit(windows - 1)).cast("int")
    units = hex_units(pixels.withColumn("win", place), width, n_move, groups=("win",), min_ct=0, density=least).persist()
    area, by = area_of(width), ["win", "ox", "oy"]
    if hard > 0:
        dense = units.filter(F.col("tot") > hard * area)
    else:
        table = units.groupBy(*by, F.rint("tot").alias("tot")).agg(F.count("*").alias("n")).toPandas().sort_values([*by, "tot"])
        cuts = [(*map(int, k), window_cut(t.tot.to_numpy(float), t.n.to_numpy(), area, least_dense)) for k, t in table.groupby(by)]
        cuts = pixels.sparkSession.createDataFrame(cuts, "win int, ox int, oy int, cut double")
        dense = units.join(F.broadcast(cuts), by).filter(F.col("tot") >= F.col("cut"))
    if precision > 0:
        step = F.lit(float(precision))
        dense = dense.withColumns({c: F.rint(F.greatest(F.col(c), F.lit(0.0)) / step) * step for c in "xy"})
    return dense.select("x", "y").distinct()


def filter_by_anchors(pixels: DataFrame, width: float = 24, n_move: int = 2, least: float = 0.02, **options) -> DataFrame:
    """Pixels nearer than a radius to the centre of a dense unit; the options are those of :func:`dense_anchors`."""
    return near_any(pixels, dense_anchors(pixels, width, n_move, least, **options), radius_of(width))


def outline(tri: DataFrame) -> list[list[tuple[float, float]]]:
    """The closed outlines of a region of triangles: sides of one triangle only, joined end to end. The rim comes to the driver, not the region."""
    ends = [F.struct(F.col(f"x{a}").alias("xa"), F.col(f"y{a}").alias("ya"), F.col(f"x{b}").alias("xb"), F.col(f"y{b}").alias("yb")) for a, b in ((1, 2), (2, 3), (3, 1))]
    side = tri.distinct().select(F.inline(F.array(*ends)))
    turned = F.struct("xa", "ya") > F.struct("xb", "yb")
    one_way = side.select(*(F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("xa", "xb"), ("ya", "yb"), ("xb", "xa"), ("yb", "ya"))))
    rim = one_way.groupBy("xa", "ya", "xb", "yb").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    links: dict = {}
    for r in sorted(map(tuple, rim.collect())):
        links.setdefault(r[:2], []).append(r[2:])
        links.setdefault(r[2:], []).append(r[:2])
    rings = []
    for start in sorted(links):
        while links[start]:
            ring, at = [start], start
            while links[at]:
                to = links[at].pop(0)
                links[to].remove(at)
                at = to
                if at == start:
                    break
                ring.append(at)
            rings.append(ring)
    return rings
