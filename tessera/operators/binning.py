"""Sliding hexagonal bins, square tiles with a halo, and other binnings of pixels.

All of these are per-row expressions followed by one aggregation: there are no
chunks, no sort order and no carry-over between chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hexgrid import area_of, hex_to_pixel, moves, offsets, pixel_to_hex, radius_of

HEX = ["ox", "oy", "hx", "hy"]


def hexed(pixels: DataFrame, width: float, n_move: int = 1, x: str = "X", y: str = "Y") -> DataFrame:
    """``pixels`` once for each lattice offset, with ox, oy, hx, hy."""
    n = moves(n_move, width)
    out = pixels.withColumn("_o", F.explode(offsets(n))) if n > 1 else pixels.withColumn("_o", offsets(1)[0])
    cell = pixel_to_hex(F.col(x), F.col(y), radius_of(width), F.col("_o.ox") / F.lit(float(n)), F.col("_o.oy") / F.lit(float(n)))
    return out.withColumn("_h", cell).withColumns({"ox": F.col("_o.ox"), "oy": F.col("_o.oy"), "hx": F.col("_h.hx"), "hy": F.col("_h.hy")}).drop("_o", "_h")


def unit_id(*keys: str) -> Column:
    """A unit's id: offsets and cell, after the group if there is one."""
    return F.concat_ws("_", *(F.col(c).cast("string") for c in keys or HEX))


def shuffle_key(seed: int, *keys: str) -> Column:
    """A repeatable random key, for the order in which units are visited."""
    return F.xxhash64(F.lit(seed), *map(F.col, keys))


def centred(units: DataFrame, width: float, n_move: int = 1) -> DataFrame:
    """Units with the centre x, y of their cell."""
    n = moves(n_move, width)
    x, y = hex_to_pixel(F.col("hx"), F.col("hy"), radius_of(width), F.col("ox") / F.lit(float(n)), F.col("oy") / F.lit(float(n)))
    return units.withColumns({"x": x, "y": y})


def centres_of(units: DataFrame, width: float, n_move: int, floor: float) -> DataFrame:
    """Units with the centre x, y of their cell, null where their ``tot`` is below the floor.

    A centre follows from the group's keys: only by its total is a filter on it kept above
    the aggregation, and not put before it for each pixel and offset.
    """
    return centred(units, width, n_move).withColumns({c: F.when(F.col("tot") >= floor, F.col(c)) for c in ("x", "y")})


def hex_units(pixels: DataFrame, width: float = 24.0, n_move: int = 3, key: str = "Count", groups: tuple[str, ...] = (), min_ct: float = 20, density: float = 0.0, centre: str = "lattice") -> DataFrame:
    """Units (groups, ox, oy, hx, hy, tot, x, y) with at least max(min_ct, density * area) of ``key``.

    ``centre``: lattice, mean or median of the pixels' coordinates.
    """
    floor = max(min_ct, density * area_of(width))
    more = {"lattice": [], "mean": [F.avg("X").alias("x"), F.avg("Y").alias("y")], "median": [F.median("X").alias("x"), F.median("Y").alias("y")]}[centre]
    out = hexed(pixels, width, n_move).groupBy(*groups, *HEX).agg(F.sum(key).alias("tot"), *more).filter(F.col("tot") >= floor)
    return out if centre != "lattice" else centres_of(out, width, n_move, floor)


def edge_trimmed(pixels: DataFrame, hexed_pixels: DataFrame, width: float, axis: str = "X", groups: tuple[str, ...] = ()) -> DataFrame:
    """The cells whose least coordinate on the axis is inside the data's range, of their group, by half a width."""
    least = hexed_pixels.groupBy(*groups, *HEX).agg(F.min(axis).alias("least"))
    if groups:
        ends = pixels.groupBy(*groups).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
        return least.join(ends, list(groups)).filter((F.col("least") > F.col("_lo") + width / 2) & (F.col("least") < F.col("_hi") - width / 2)).drop("_lo", "_hi")
    lo, hi = pixels.agg(F.min(axis), F.max(axis)).first()
    return least.filter((F.col("least") > lo + width / 2) & (F.col("least") < hi - width / 2)) if lo is not None else least


def centre_trimmed(units: DataFrame, pixels: DataFrame, width: float, axis: str = "X") -> DataFrame:
    """Units whose centre is inside the data's range by radius * sqrt(3) / 2, for the projection of a model."""
    lo, hi = pixels.agg(F.min(axis), F.max(axis)).first()
    margin = radius_of(width) * 3**0.5 / 2
    c = F.col("x" if axis == "X" else "y")
    return units.filter((c > lo + margin) & (c < hi - margin)) if lo is not None else units


def dge(pixels: DataFrame, width: float = 24.0, n_move: int = 3, key: str = "Count", gene: str = "gene", groups: tuple[str, ...] = (), min_ct: float = 20, density: float = 0.0) -> DataFrame:
    """Long unit by gene counts of the kept units: (groups, ox, oy, hx, hy, gene, n, tot).

    One aggregation by cell and gene, combined before its shuffle; the units'
    totals are a window over its result, where a cell has a row a gene at most.
    """
    floor = max(min_ct, density * area_of(width))
    counts = hexed(pixels, width, n_move).groupBy(*groups, *HEX, gene).agg(F.sum(key).alias("n"))
    return counts.withColumn("tot", F.sum("n").over(Window.partitionBy(*groups, *HEX))).filter(F.col("tot") >= floor).filter("n > 0")


def group_key(*cols: str) -> Column:
    """Several columns as one group."""
    return F.concat_ws("_", *(F.col(c).cast("string") for c in cols))


def moves_for_overlap(overlap: float) -> int:
    """Lattice moves for a given overlap of neighbouring hexagons."""
    return int(1 / (1 - overlap))


# --- square tiles with a halo ---


def tile_bounds(lo: float, hi: float, side: float, step: float) -> list[tuple[float, float]]:
    """Tiles (start, end] of one axis: starts a step apart while they are half a side from the end; the first begins before the least point and the last ends at the greatest."""
    n = max(1, -int(-(hi - side / 2 + 1 - lo) // step))
    return [(lo - 1 if k == 0 else lo + k * step, hi if k == n - 1 else lo + k * step + side) for k in range(n)]


def _tiles(value: Column, lo: float, hi: float, side: float, step: float) -> Column:
    """The numbers of the tiles with the value: a range found by arithmetic, checked against the bounds."""
    n = max(1, -int(-(hi - side / 2 + 1 - lo) // step))
    last = F.least(F.lit(n - 1), F.ceil((value - F.lit(lo)) / F.lit(step)).cast("int"))
    first = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((value - F.lit(lo + side)) / F.lit(step)).cast("int")))

    def inside(k: Column) -> Column:
        start = F.when(k == 0, F.lit(lo - 1)).otherwise(F.lit(lo) + k * F.lit(step))
        end = F.when(k == n - 1, F.lit(hi)).otherwise(F.lit(lo) + k * F.lit(step) + F.lit(side))
        return (value > start) & (value <= end)

    return F.filter(F.sequence(first, F.greatest(last, first)), inside)


def extent(pixels: DataFrame, x: str = "X", y: str = "Y") -> tuple[float, float, float, float]:
    """(xmin, xmax, ymin, ymax): four numbers to the driver."""
    return tuple(pixels.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())


def tiled(pixels: DataFrame, side: float, halo: float, min_pixel: int = 0, seed: int = 0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``pixels`` once for each tile (tx, ty) with them; tiles with fewer than ``min_pixel`` go. ``tile_id`` is a hash of seed and place."""
    x0, x1, y0, y1 = box or extent(pixels)
    if x0 is None:
        return pixels.withColumns({"tx": F.lit(0), "ty": F.lit(0), "tile_id": F.lit(0).cast("long")})
    step = side - halo
    out = pixels.withColumn("tx", F.explode(_tiles(F.col("X"), x0, x1, side, step))).withColumn("ty", F.explode(_tiles(F.col("Y"), y0, y1, side, step)))
    if min_pixel > 0:
        full = out.groupBy("tx", "ty").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pixel).drop("_n")
        out = out.join(full, ["tx", "ty"], "left_semi")
    return out.withColumn("tile_id", F.xxhash64(F.lit(seed), "tx", "ty"))


def owner(value: Column, lo: float, hi: float, side: float, halo: float) -> Column:
    """The one tile that a point of several belongs to: overlaps are split in the middle."""
    step = side - halo
    n = max(1, -int(-(hi - side / 2 + 1 - lo) // step))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((value - F.lit(lo + halo / 2)) / F.lit(step)).cast("int") - 1))


# --- collapses, blocks, rasters ---


def truncated(pixels: DataFrame, precision: float) -> DataFrame:
    """``pixels`` with coordinates truncated toward zero to a precision, a row each as before."""
    cell = {c: F.col(c).cast("double") / F.lit(float(precision)) for c in ("X", "Y")}
    return pixels.withColumns({c: v.cast("long") * F.lit(float(precision)) for c, v in cell.items()})


def collapsed_truncating(pixels: DataFrame, precision: float, keys: tuple[str, ...] = ("gene",), key: str = "Count") -> DataFrame:
    """Counts by coordinates truncated toward zero to a precision."""
    return truncated(pixels, precision).groupBy(*keys, "X", "Y").agg(F.sum(key).alias(key))


def collapsed_rounding(pixels: DataFrame, precision: float, keys: tuple[str, ...] = (), key: str = "Count") -> DataFrame:
    """Counts by coordinates rounded half to even to a precision."""
    binned = pixels.withColumns({c: F.rint(F.col(c) / F.lit(float(precision))) * F.lit(float(precision)) for c in ("X", "Y")})
    return binned.groupBy(*keys, "X", "Y").agg(F.sum(key).alias(key))


def blocked(pixels: DataFrame, block: float = 2000, scale: float = 100, off_x: float = 0.0, off_y: float = 0.0) -> DataFrame:
    """Pixels with BLOCK, and X and Y as scaled integers from the offset, not below 0."""
    place = F.floor((F.col("X") - F.lit(float(off_x))) / F.lit(float(block)))
    return pixels.withColumns({
        "BLOCK": (F.greatest(place, F.lit(0)) * F.lit(int(block))).cast("long"),
        "X": F.greatest(((F.col("X") - F.lit(float(off_x))) * F.lit(float(scale))).cast("long"), F.lit(0).cast("long")),
        "Y": F.greatest(((F.col("Y") - F.lit(float(off_y))) * F.lit(float(scale))).cast("long"), F.lit(0).cast("long")),
    })


#: The column of places on a curve, and the bits of a cell's number along an axis.
CURVE, CURVE_BITS = "curve", 20


def curve_cell(value: Column, low: float, cell: float) -> Column:
    """The number of a value's cell from ``low``, held within the curve."""
    return F.least(F.greatest(F.floor((value - F.lit(float(low))) / F.lit(float(cell))), F.lit(0)), F.lit((1 << CURVE_BITS) - 1)).cast("long")


def curve_key(x: Column, y: Column, cell: float, box: tuple[float, float, float, float]) -> Column:
    """A place's number on a Z curve over cells: the bits of its cell's numbers in turn, those of x the higher ones."""

    def apart(c: Column) -> Column:  # each bit moves to twice its place
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return F.shiftleft(apart(curve_cell(x, box[0], cell)), 1).bitwiseOR(apart(curve_cell(y, box[2], cell)))


def curve_ranges(cells: tuple[int, int, int, int], most: int = 64) -> list[tuple[int, int]]:
    """Ranges of a Z curve that cover cells (first and last along x, and along y), bounds included: at most about ``most``, the rest being too much and not too little.

    Squares of the curve are divided while they are partly covered and there is room.
    """
    x0, x1, y0, y1 = cells
    open_, whole = [(CURVE_BITS, 0, 0)], []
    while open_ and len(open_) + len(whole) < most:
        level, qx, qy = max(open_)
        open_.remove((level, qx, qy))
        if level == 0:
            whole.append((level, qx, qy))
            continue
        for i in (0, 1):
            for j in (0, 1):
                k, a, b = level - 1, 2 * qx + i, 2 * qy + j
                if a << k > x1 or ((a + 1) << k) - 1 < x0 or b << k > y1 or ((b + 1) << k) - 1 < y0:
                    continue
                inside = x0 <= a << k and ((a + 1) << k) - 1 <= x1 and y0 <= b << k and ((b + 1) << k) - 1 <= y1
                (whole if inside else open_).append((k, a, b))
    out: list[tuple[int, int]] = []
    for lo, level in sorted((sum(((a >> i & 1) << 2 * i + 1) | ((b >> i & 1) << 2 * i) for i in range(CURVE_BITS)) << 2 * k, k) for k, a, b in whole + open_):
        hi = lo + (1 << 2 * level) - 1
        if out and out[-1][1] + 1 == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def bounding_box(pixels: DataFrame, mu_scale: float = 1.0) -> DataFrame:
    """One row (xmin, xmax, ymin, ymax) in micrometres."""
    s = F.lit(float(mu_scale))
    return pixels.agg((F.min("X") / s).alias("xmin"), (F.max("X") / s).alias("xmax"), (F.min("Y") / s).alias("ymin"), (F.max("Y") / s).alias("ymax"))


def raster(df: DataFrame, um: float, x: str = "x", y: str = "y", rounding: bool = True, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``df`` with raster places px, py: rounded half to even, or floored from an origin."""
    if rounding:
        return df.withColumns({"px": F.rint(F.col(x) / F.lit(float(um))).cast("long"), "py": F.rint(F.col(y) / F.lit(float(um))).cast("long")})
    return df.withColumns({"px": F.floor((F.col(x) - F.lit(x0)) / F.lit(float(um))).cast("long"), "py": F.floor((F.col(y) - F.lit(y0)) / F.lit(float(um))).cast("long")})


def minor_windows(value: Column, start: float, step: float) -> Column:
    """The window of a value on the minor axis."""
    return F.floor((value - F.lit(start)) / F.lit(step)).cast("long")
