"""Spatial joins by grid buckets: radius, nearest, nearest within a tolerance.

A theta join on distance would compare all pairs. Here the one side is listed
under its own bucket and the other under the 3 x 3 buckets around, with buckets
as wide as the radius, so that an equi-join finds all pairs in reach; distances
are then tested exactly. A crowded bucket is a skewed key, which the adaptive
join splits.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.hexgrid import pixel_to_hex, radius_of
from tessera.functions.special import nearest_point
from tessera.operators import quadtree


def bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width))).cast("long")


def _around(df: DataFrame, width: float, x: str, y: str) -> DataFrame:
    near = [F.struct((bucket(F.col(x), width) + i).alias("_bx"), (bucket(F.col(y), width) + j).alias("_by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return df.select("*", F.inline(F.array(*near)))


def radius_join(left: DataFrame, right: DataFrame, r: float, x: str = "X", y: str = "Y", rx: str = "x", ry: str = "y", strict: bool = False) -> DataFrame:
    """Pairs within a distance (``strict``: below it), with the distance d; the right side's coordinates go."""
    a = left.withColumns({"_bx": bucket(F.col(x), r), "_by": bucket(F.col(y), r)})
    b = _around(right.withColumnsRenamed({rx: "_rx", ry: "_ry"}), r, "_rx", "_ry")
    dx, dy = F.col(x) - F.col("_rx"), F.col(y) - F.col("_ry")
    both = a.join(b, ["_bx", "_by"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).drop("_bx", "_by", "_rx", "_ry")
    return both.filter(F.col("d") < r if strict else F.col("d") <= r)


def near_any(left: DataFrame, right: DataFrame, r: float, x: str = "X", y: str = "Y", rx: str = "x", ry: str = "y") -> DataFrame:
    """Rows of ``left`` with a point of ``right`` at a distance below r."""
    a = left.withColumns({"_bx": bucket(F.col(x), r), "_by": bucket(F.col(y), r)})
    b = _around(right.select(F.col(rx).alias("_rx"), F.col(ry).alias("_ry")), r, "_rx", "_ry").withColumnsRenamed({"_bx": "_cx", "_by": "_cy"})
    dx, dy = F.col(x) - F.col("_rx"), F.col(y) - F.col("_ry")
    return a.join(b, (F.col("_bx") == F.col("_cx")) & (F.col("_by") == F.col("_cy")) & (dx * dx + dy * dy < F.lit(float(r) * float(r))), "left_semi").drop("_bx", "_by")


def _met(left: DataFrame, right: DataFrame, on: list[str], x: str, y: str, r: float | None = None, strict: bool = False) -> DataFrame:
    """``left`` once for each row, with ``_near``: an array of (d, the columns of ``right``) of the points of its bucket, within r if given.

    ``right`` (with places _rx, _ry) is gathered by bucket before the join, so that no row is made for a pair.
    """
    cols = [c for c in right.columns if c not in {*on, "_rx", "_ry"}]
    listed = right.groupBy(*on).agg(F.collect_list(F.struct("_rx", "_ry", *cols)).alias("_near"))

    def far(p: Column) -> Column:
        dx, dy = F.col(x) - p["_rx"], F.col(y) - p["_ry"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), *(p[c].alias(c) for c in cols))

    near = F.transform("_near", far)
    if r is not None:
        near = F.filter(near, lambda p: p["d"] < r if strict else p["d"] <= r)
    return left.join(listed, on).withColumn("_near", near).drop(*on)


def _first(met: DataFrame, tie: str, k: int) -> DataFrame:
    """The k first of ``_near`` by d and ``tie``, a row each, with rank."""
    cols = [f.name for f in met.schema["_near"].dataType.elementType.fields]
    ordered = F.transform("_near", lambda p: F.struct(p["d"].alias("d"), p[tie].alias(tie), *(p[c].alias(c) for c in cols if c not in ("d", tie))))
    out = met.withColumn("_near", F.slice(F.array_sort(ordered), 1, k)).select("*", F.posexplode("_near").alias("_i", "_p")).drop("_near")
    return out.select(*(c for c in out.columns if c not in ("_i", "_p")), *(F.col("_p")[c].alias(c) for c in cols if c != "d"), F.col("_p.d").alias("d"), (F.col("_i") + 1).alias("rank"))


def _within_reach(left: DataFrame, right: DataFrame, r: float, x: str = "X", y: str = "Y", rx: str = "x", ry: str = "y", strict: bool = False) -> DataFrame:
    a = left.withColumns({"_bx": bucket(F.col(x), r), "_by": bucket(F.col(y), r)})
    return _met(a, _around(right.withColumnsRenamed({rx: "_rx", ry: "_ry"}), r, "_rx", "_ry"), ["_bx", "_by"], x, y, r, strict)


def nearest(left: DataFrame, right: DataFrame, r: float, key: str, tie: str, k: int = 1, **names) -> DataFrame:
    """The k nearest points of ``right`` within r for each row of ``left``, whose ``key`` is its own, with d and rank; equal distances by ``tie``."""
    return _first(_within_reach(left, right, r, **names), tie, k)


#: Rows of both sides that a task holds together, the levels of squares above the least, and cells that are sent to all tasks.
CROWD, LEVELS, BROADCAST_CELLS = 100_000, 8, 100_000


def nearest_one(left: DataFrame, right: DataFrame, r: float, x: str = "X", y: str = "Y", rx: str = "x", ry: str = "y", most: int = CROWD) -> DataFrame:
    """Each row of ``left`` that has a point of ``right`` nearer than r, with the nearest one's columns; equal distances by rx, then ry.

    Both sides meet in squares that follow their rows (at most ``most`` of both,
    down to a width of 2 r), ``right`` also around them, and are searched there:
    the work of a row does not grow with the points within r, and no pairs are shuffled.
    """
    cells = quadtree.Cells(0.0, 0.0, 2.0 * r, LEVELS)
    every = left.select(F.col(x).alias("X"), F.col(y).alias("Y")).unionAll(right.select(F.col(rx).alias("X"), F.col(ry).alias("Y")))
    found = quadtree.leaves(every, cells, most).persist()
    small = F.broadcast if found.count() <= BROADCAST_CELLS else lambda t: t
    own, spread = (quadtree.spread(t, small(quadtree.around(found, cells, d)), cells, d, *at).drop("own") for t, d, at in ((left, 0.0, (x, y)), (right, r, (rx, ry))))
    schema = StructType([*left.schema.fields, *right.schema.fields])
    mine, theirs = left.columns, right.columns

    def one(here: pa.Table, there: pa.Table) -> pa.Table:
        at = nearest_point(*(here[c].to_numpy() for c in (x, y)), *(there[c].to_numpy() for c in (rx, ry)), r)
        has = pa.array((at >= 0).nonzero()[0])
        here, there = here.select(mine).take(has), there.select(theirs).take(pa.array(at[at >= 0]))
        return pa.Table.from_arrays([*here.columns, *there.columns], names=[*mine, *theirs])

    return own.groupBy(*quadtree.NODE).cogroup(spread.groupBy(*quadtree.NODE)).applyInArrow(one, schema)


#: Cells on either side within which the k nearest are once 3 x 3 cells hold k points: the farthest of these is two diagonals away.
REACH = 3


def search_levels(left: DataFrame, right: DataFrame, r: float, k: int, depth: int) -> DataFrame:
    """(_cx, _cy, _level): for each occupied cell of ``left``, the least level of a count pyramid on which 3 x 3 cells around hold k points of ``right``.

    Both sides are tables of cells (_cx, _cy) of width r, ``right`` with the
    points _n of each; cells of level i are 2 ** i as wide. Where the whole of
    ``right`` has fewer than k points the level is ``depth``.
    """
    levels = F.array(*(F.struct(F.lit(i).alias("_level"), F.shiftright("_cx", i).alias("_bx"), F.shiftright("_cy", i).alias("_by")) for i in range(depth + 1)))
    counts = right.select("_n", F.inline(levels)).groupBy("_level", "_bx", "_by").agg(F.sum("_n").alias("_n"))
    steps = F.array(*(F.struct((F.col("_bx") + i).alias("_bx"), (F.col("_by") + j).alias("_by")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    full = counts.select("_level", "_n", F.inline(steps)).groupBy("_level", "_bx", "_by").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= k).drop("_n")
    found = left.select("_cx", "_cy", F.inline(levels)).join(full, ["_level", "_bx", "_by"]).groupBy("_cx", "_cy").agg(F.min("_level").alias("_level"))
    return left.join(found, ["_cx", "_cy"], "left").withColumn("_level", F.coalesce("_level", F.lit(depth)))


def nearest_any(left: DataFrame, right: DataFrame, r: float, key: str, tie: str, k: int = 1, x: str = "X", y: str = "Y", rx: str = "x", ry: str = "y") -> DataFrame:
    """The k nearest points of ``right`` for each ``key`` of ``left`` however far they are, with d and rank; equal distances by ``tie``.

    A pyramid of counts gives each point the width of cells among which its
    neighbours are before anything is joined; then one equi-join, in which a
    bucket is as wide as the points around need. ``r`` is the least width.
    """
    ends = [t.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first() for t, a, b in ((left, x, y), (right, rx, ry))]
    if None in (ends[0][0], ends[1][0]):
        return nearest(left, right, r, key, tie, k, x=x, y=y, rx=rx, ry=ry)
    span = max(max(e[i + 1] for e in ends) - min(e[i] for e in ends) for i in (0, 2))
    depth = max(0, math.ceil(math.log2(max(span / r, 1.0)))) + 1
    left = left.withColumns({"_cx": bucket(F.col(x), r), "_cy": bucket(F.col(y), r)})
    right = right.withColumnsRenamed({rx: "_rx", ry: "_ry"}).withColumns({"_cx": bucket(F.col("_rx"), r), "_cy": bucket(F.col("_ry"), r)})
    levels = search_levels(left.select("_cx", "_cy").distinct(), right.groupBy("_cx", "_cy").agg(F.count("*").alias("_n")), r, k, depth).persist()
    used = sorted(row[0] for row in levels.select("_level").distinct().collect())  # at most ``depth`` numbers
    a = left.join(levels, ["_cx", "_cy"]).withColumns({"_bx": F.expr("shiftright(_cx, _level)"), "_by": F.expr("shiftright(_cy, _level)")}).drop("_cx", "_cy")
    cells = [F.struct(F.lit(i).alias("_level"), (F.shiftright("_cx", i) + p).alias("_bx"), (F.shiftright("_cy", i) + q).alias("_by")) for i in used for p in range(-REACH, REACH + 1) for q in range(-REACH, REACH + 1)]
    b = right.select("*", F.inline(F.array(*cells))).drop("_cx", "_cy")
    return _first(_met(a, b, ["_level", "_bx", "_by"], x, y), tie, k)


def edge_weight(d: Column, r: float, nu: float) -> Column:
    """1 - (d / r) ** nu."""
    return F.lit(1.0) - F.pow(d / F.lit(float(r)), F.lit(float(nu)))


def imputed(edges: DataFrame, key: str, weight: str, value: str) -> DataFrame:
    """The mean of neighbours' arrays by weights that sum to one: (key, value array)."""
    long = edges.select(key, weight, F.posexplode(value).alias("_i", "_v"))
    sums = long.groupBy(key, "_i").agg((F.sum(F.col(weight) * F.col("_v")) / F.sum(weight)).alias("_v"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias(value))


def imputed_around(left: DataFrame, right: DataFrame, r: float, nu: float, value: str, **names) -> DataFrame:
    """Each row of ``left`` with points of ``right`` nearer than r, and the mean of their arrays ``value`` by :func:`edge_weight`."""
    met = _within_reach(left, right, r, strict=True, **names).filter(F.size("_near") > 0)
    total = F.aggregate("_near", F.lit(0.0), lambda s, p: s + edge_weight(p["d"], r, nu))
    mean = F.transform(F.sequence(F.lit(0), F.size(F.col("_near")[0][value]) - 1), lambda i: F.aggregate("_near", F.lit(0.0), lambda s, p: s + edge_weight(p["d"], r, nu) * F.get(p[value], i)) / total)
    return met.withColumn(value, mean).drop("_near")


def factor_lookup(points: DataFrame, decoded: DataFrame, key: str, r: float = 5.0, k: int = 1, halflife: float = 0.7, include_self: bool = False, sparsify: float = 0.0, value: str = "theta", x: str = "X", y: str = "Y") -> DataFrame:
    """(key, value): factor probabilities at places, from the k nearest decoded places (x, y, value) nearer than r.

    Weights are 1 - (d / r) ** nu, one half at ``halflife`` of r, and sum to one.
    Probabilities below ``sparsify`` count as none; without ``include_self`` a
    decoded place that is the point itself is passed over, though it is one of the k.
    """
    ref = decoded.select("x", "y", F.transform(value, lambda p: F.when(p < sparsify, F.lit(0.0)).otherwise(p)).alias(value)).withColumn("_tie", F.struct("x", "y"))
    near = nearest(points.select(key, F.col(x).alias("X"), F.col(y).alias("Y")), ref, r, key, "_tie", k)
    near = near.filter((F.col("d") < F.lit(float(r))) & (F.lit(include_self) | (F.col("d") > 0)))
    return imputed(near.withColumn("_w", edge_weight(F.col("d"), r, math.log(0.5) / math.log(halflife))), key, "_w", value)


def lattice_neighbours(points: DataFrame, key: str, x: str = "x", y: str = "y", reach: float = 1.0, slack: float = 0.5) -> DataFrame:
    """(key, other): points next to each other on a lattice.

    ``reach`` is a bound on the least positive distance; pairs up to that
    distance plus ``slack`` are neighbours, at most six a point as on a lattice.
    """
    other = points.select(F.col(key).alias("other"), F.col(x).alias("_ox"), F.col(y).alias("_oy"))
    pairs = radius_join(points.select(key, x, y), other, reach + slack, x, y, "_ox", "_oy").filter("d > 0")
    least = pairs.agg(F.min("d")).first()[0]
    if least is None:
        return pairs.select(key, "other")
    w = Window.partitionBy(key).orderBy("d", "other")
    return pairs.filter(F.col("d") < least + slack).withColumn("_n", F.row_number().over(w)).filter("_n <= 6").select(key, "other")


def on_lattice(points: DataFrame, key: str, spacing: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, other): neighbours of points that are centres of a hexagonal lattice with this distance between centres.

    A centre's six neighbours are six steps of its cell's coordinates: one
    equi-join, without distances. Centres of n sliding lattices are those of one
    lattice with an n-th of the distance.
    """
    at = points.select(F.col(key), pixel_to_hex(F.col(x), F.col(y), radius_of(spacing)).alias("_h")).select(key, F.col("_h.hx").alias("_q"), F.col("_h.hy").alias("_r"))
    steps = [F.struct((F.col("_q") + i).alias("_q"), (F.col("_r") + j).alias("_r")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))]
    return at.select(key, F.inline(F.array(*steps))).join(at.withColumnRenamed(key, "other"), ["_q", "_r"]).select(key, "other")


def proximity(neighbours: DataFrame, theta: DataFrame, key: str, value: str = "theta", n: int | None = None) -> DataFrame:
    """(a, b, w): for factors a and b, the sum over neighbouring points of their products; ``n`` factors, by default as many as the longest array has.

    The neighbours' arrays are summed for each point first, place by place, so
    that one row of n sums a point is shuffled and products are by point.
    """
    n = theta.agg(F.max(F.size(value))).first()[0] if n is None else n
    if not n or n < 0:
        return theta.sparkSession.createDataFrame([], "a int, b int, w double")
    t = theta.select(F.col(key), F.col(value).alias("_t"))
    u = theta.select(F.col(key).alias("other"), F.col(value).alias("_u"))
    sums = [f"_{b}" for b in range(n)]
    by_point = neighbours.join(u, "other").groupBy(key).agg(*(F.sum(F.get("_u", F.lit(b))).alias(c) for b, c in enumerate(sums)))
    by_factor = by_point.join(t, key).select(*sums, F.posexplode("_t").alias("a", "_s")).groupBy("a").agg(*(F.sum(F.col("_s") * F.col(c)).alias(c) for c in sums))
    return by_factor.select("a", F.posexplode(F.array(*sums)).alias("b", "w"))


# --- polygons ---


def inside(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd containment in rings, by crossings to the right; a boundary point may be in or out.

    Rings are driver-side geometry with a bounded number of vertices; larger ones go to :func:`within`.
    """
    crossed = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                at = F.lit(float(x2 - x1)) * (y - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
                crossed = crossed + F.when(((y < F.lit(float(y1))) != (y < F.lit(float(y2)))) & (x < at), 1).otherwise(0)
    return crossed % 2 == 1


#: Edges by cell that are sent to all tasks.
BROADCAST_EDGES = 20_000


def within(df: DataFrame, edges: DataFrame, height: float | None = None, x: str = "X", y: str = "Y", most: int = BROADCAST_EDGES) -> DataFrame:
    """Rows whose place is inside any of the polygons given as edges (x1, y1, x2, y2, and ``polygon`` if there are several).

    A place is in a polygon if an odd number of its edges is to the right, so
    the rings of one polygon cut holes; polygons that overlap are united. Edges
    are listed under the cells of their own strip (``height``) that their
    polygon's box covers, so a place meets polygons around it only; by default
    cells are as large as the mean edge is high and the mean polygon wide. Up to
    ``most`` edges by cell, each row meets the array of its cell's, and no row is
    shuffled; with more, rows of one place are judged once and kept together.
    """
    e = edges if "polygon" in edges.columns else edges.withColumn("polygon", F.lit(0))
    box = e.groupBy("polygon").agg(F.min(F.least("x1", "x2")).alias("_lo"), F.max(F.greatest("x1", "x2")).alias("_hi"))
    e = e.join(box, "polygon").filter("y1 <> y2")
    mean = e.agg(F.avg(F.abs(F.col("y1") - F.col("y2"))), F.avg(F.col("_hi") - F.col("_lo"))).first()  # two numbers
    high, wide = max(height or mean[0] or 1.0, 1e-9), max(mean[1] or 1.0, 1e-9)
    lines = [bucket(F.least("y1", "y2"), high), bucket(F.greatest("y1", "y2"), high)]
    cells = [bucket(F.col("_lo"), wide), bucket(F.col("_hi"), wide)]
    listed = e.withColumn("_s", F.explode(F.sequence(*lines))).withColumn("_c", F.explode(F.sequence(*cells)))
    many = e.agg(F.sum((lines[1] - lines[0] + 1) * (cells[1] - cells[0] + 1))).first()[0] or 0

    def crossed(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return ((py < y1) != (py < y2)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)

    ends = ["x1", "y1", "x2", "y2"]
    if many <= most:
        shapes = listed.groupBy("_s", "_c", "polygon").agg(F.collect_list(F.struct(*ends)).alias("_e")).groupBy("_s", "_c").agg(F.collect_list("_e").alias("_p"))
        right = lambda q: crossed(F.col(x), F.col(y), *(q[c] for c in ends))
        odd = F.exists("_p", lambda shape: F.size(F.filter(shape, right)) % 2 == 1)
        at = df.withColumns({"_s": bucket(F.col(y), high), "_c": bucket(F.col(x), wide)})
        return at.join(F.broadcast(shapes), ["_s", "_c"]).filter(odd).select(*(F.col(f"`{c}`") for c in df.columns))
    places = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).distinct().withColumns({"_s": bucket(F.col("_y"), high), "_c": bucket(F.col("_x"), wide)})
    odd = places.join(listed, ["_s", "_c"]).filter(crossed(F.col("_x"), F.col("_y"), *map(F.col, ends))).groupBy("_x", "_y", "polygon").agg(F.count("*").alias("_n")).filter("_n % 2 = 1")
    return df.join(odd.select("_x", "_y"), (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left_semi")


def near_edges(df: DataFrame, edges: DataFrame, r: float, x: str = "X", y: str = "Y") -> DataFrame:
    """Rows within a distance of any edge (x1, y1, x2, y2): edges are listed under the buckets that their box, wider by r, touches.

    Buckets are as wide as the mean edge and r are together, so that an edge has a few of them.
    """
    long = edges.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))))).first()[0]  # one number
    wide = max(r + (long or 0.0), 1e-9)
    cells = [F.explode(F.sequence(bucket(F.least(f"{c}1", f"{c}2") - F.lit(float(r)), wide), bucket(F.greatest(f"{c}1", f"{c}2") + F.lit(float(r)), wide))) for c in "xy"]
    listed = edges.select("x1", "y1", "x2", "y2").withColumn("_cx", cells[0]).withColumn("_cy", cells[1])
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    px, py = F.col(x) - F.col("x1"), F.col(y) - F.col("y1")
    along = F.least(F.greatest((px * ux + py * uy) / F.greatest(ux * ux + uy * uy, F.lit(1e-30)), F.lit(0.0)), F.lit(1.0))
    near = F.hypot(px - along * ux, py - along * uy) <= F.lit(float(r))
    at = df.withColumns({"_bx": bucket(F.col(x), wide), "_by": bucket(F.col(y), wide)})
    return at.join(listed, (F.col("_bx") == F.col("_cx")) & (F.col("_by") == F.col("_cy")) & near, "left_semi").drop("_bx", "_by")


def within_buffered(df: DataFrame, edges: DataFrame, buffer: float = 0.0, x: str = "X", y: str = "Y") -> DataFrame:
    """Rows in the polygons of :func:`within`, or within ``buffer`` of their edges: the region grown by the buffer."""
    if buffer <= 0:
        return within(df, edges, x=x, y=y)
    places = df.select(F.col(x).alias("_ax"), F.col(y).alias("_ay")).distinct()
    kept = within(places, edges, x="_ax", y="_ay").unionByName(near_edges(places, edges, buffer, "_ax", "_ay")).distinct()
    return df.join(kept, (F.col(x) == F.col("_ax")) & (F.col(y) == F.col("_ay")), "left_semi")
