"""Rasters of pixels and units. Aggregation by raster cell is distributed; an image is as large as its cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hexgrid import pixel_to_hex, radius_of
from tessera.functions.vectors import argmax
from tessera.operators.binning import raster
from tessera.operators.spatial import radius_join


def mean_values(df: DataFrame, um: float, value: str = "theta", k: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """(px, py, factor, p): the mean of arrays by raster cell."""
    binned = raster(df, um, x, y)
    return binned.select("px", "py", F.posexplode(value).alias("factor", "p")).groupBy("px", "py", "factor").agg(F.avg("p").alias("p"))


def mixed(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """(px, py, r, g, b): the sum over factors of value times colour; ``colours`` has a row a factor."""
    c = F.broadcast(colours.select(F.col("factor"), "R", "G", "B"))
    return cells.join(c, "factor").groupBy("px", "py").agg(*(F.sum(F.col("p") * F.col(x)).alias(x.lower()) for x in "RGB"))


def top_cells(cells: DataFrame) -> DataFrame:
    """(px, py, factor): the factor of the greatest mean, the lowest of equals."""
    best = F.max(F.struct("p", (-F.col("factor")).alias("f")))
    return cells.groupBy("px", "py").agg(best.alias("b")).select("px", "py", (-F.col("b.f")).cast("int").alias("factor"))


def top_rgb(df: DataFrame, um: float, colours: DataFrame, top: int = 3, x: str = "X", y: str = "Y") -> DataFrame:
    """(px, py, r, g, b): the mean over a cell's pixels of sum P_i times the colour of K_i."""
    binned = raster(df, um, x, y)
    pairs = F.array(*(F.struct(F.col(f"K{i + 1}").alias("factor"), F.col(f"P{i + 1}").alias("p")) for i in range(top)))
    n = binned.groupBy("px", "py").agg(F.count("*").alias("n"))
    long = binned.select("px", "py", F.inline(pairs)).filter("p > 0").groupBy("px", "py", "factor").agg(F.sum("p").alias("p"))
    out = mixed(long, colours)
    return n.join(out, ["px", "py"]).select("px", "py", *((F.col(c) / F.col("n")).alias(c) for c in "rgb"))


def single_factors(df: DataFrame, um: float, k: int, top: int = 3, least: int = 1, x: str = "X", y: str = "Y") -> DataFrame:
    """(px, py, factor, p): heat maps of all factors in one pass; factors in fewer than ``least`` pixels are left out."""
    binned = raster(df, um, x, y)
    pairs = F.array(*(F.struct(F.col(f"K{i + 1}").alias("factor"), F.col(f"P{i + 1}").alias("p")) for i in range(top)))
    n = binned.groupBy("px", "py").agg(F.count("*").alias("n"))
    long = binned.select("px", "py", F.inline(pairs)).filter("p > 0")
    enough = long.groupBy("factor").agg(F.count("*").alias("_c")).filter(F.col("_c") >= least)
    sums = long.join(F.broadcast(enough.select("factor")), "factor", "left_semi").groupBy("px", "py", "factor").agg(F.sum("p").alias("p"))
    return sums.join(n, ["px", "py"]).select("px", "py", "factor", (F.col("p") / F.col("n")).alias("p"))


def channels(df: DataFrame, um: float, chosen: list[tuple[int, tuple[float, float, float]]], top: int = 3, cut: float = 0.1, x: str = "X", y: str = "Y") -> DataFrame:
    """(px, py, r, g, b, a): up to five factors in colours of choice; a is the greatest sum of their probabilities, cells below the cut go."""
    if len(chosen) > 5:
        raise ValueError("at most five channels")
    p = {k: sum((F.when(F.col(f"K{i + 1}") == k, F.col(f"P{i + 1}")).otherwise(0.0) for i in range(top)), F.lit(0.0)) for k, _ in chosen}
    a = sum(p.values(), F.lit(0.0))
    rgb = {c: sum((p[k] * F.lit(float(v[i])) for k, v in chosen), F.lit(0.0)) for i, c in enumerate("rgb")}
    binned = raster(df, um, x, y).withColumns({**{f"_{c}": v for c, v in rgb.items()}, "_a": a}).filter(F.col("_a") >= cut)
    return binned.groupBy("px", "py").agg(*(F.avg(f"_{c}").alias(c) for c in "rgb"), F.max("_a").alias("a"))


def hexagon_cells(units: DataFrame, cells: DataFrame, um: float, width: float) -> DataFrame:
    """Raster cells (px, py) with the columns of the hexagon (hx, hy) that they are in."""
    at = pixel_to_hex(F.col("px") * F.lit(float(um)), F.col("py") * F.lit(float(um)), radius_of(width))
    return cells.withColumn("_h", at).select("px", "py", F.col("_h.hx").alias("hx"), F.col("_h.hy").alias("hy")).join(units, ["hx", "hy"])


def filled(cells: DataFrame, known: DataFrame, reach: int, value: str) -> DataFrame:
    """Empty raster cells with the value of the nearest known cell within reach; of equally near ones the least place."""
    a = cells.join(known.select("px", "py"), ["px", "py"], "left_anti").select(F.col("px").cast("double").alias("ax"), F.col("py").cast("double").alias("ay"))
    b = known.select(F.col("px").cast("double").alias("bx"), F.col("py").cast("double").alias("by"), F.struct("px", "py").alias("_tie"), value)
    order = Window.partitionBy("ax", "ay").orderBy("d", "_tie")
    near = radius_join(a, b, float(reach), "ax", "ay", "bx", "by").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return known.select("px", "py", value).unionByName(near.select(F.col("ax").cast("long").alias("px"), F.col("ay").cast("long").alias("py"), value))


def categories(df: DataFrame, um: float, column: str, names: DataFrame | None = None, x: str = "X", y: str = "Y") -> DataFrame:
    """(px, py, category): the most frequent category by cell, renamed by a map (From, To) where it has the name."""
    if names is not None:
        df = df.join(names.select(F.col("From").alias(column), "To"), column, "left").withColumn(column, F.coalesce("To", F.col(column))).drop("To")
    n = raster(df, um, x, y).groupBy("px", "py", column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("c")))
    return n.groupBy("px", "py").agg(best.alias("b")).select("px", "py", F.col("b.c").alias("category"))


def with_colours(df: DataFrame, colours: DataFrame, on: str = "Name", names: dict[str, str] | None = None, missing: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> DataFrame:
    """``df`` with the R, G, B of a label's row in a colour table, labels renamed first; labels without a colour get ``missing``."""
    label = F.col(on).cast("string")
    for a, b in (names or {}).items():
        label = F.when(F.col(on).cast("string") == a, F.lit(b)).otherwise(label)
    c = F.broadcast(colours.select(F.col("Name").cast("string").alias("_name"), *(F.col(x).alias(f"_{x}") for x in "RGB")))  # one row a label
    out = df.withColumn("_label", label).join(c, F.col("_label") == F.col("_name"), "left")
    return out.withColumns({x: F.coalesce(F.col(f"_{x}"), F.lit(float(m))) for x, m in zip("RGB", missing)}).drop("_label", "_name", "_R", "_G", "_B")


def outlines(rings: list[list[tuple[float, float]]], um: float = 1.0, ink: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """The edges of rings as an image, x along the rows: a boundary to look at."""
    points = np.array([p for r in rings for p in r], float).reshape(-1, 2) / um
    if not len(points):
        return np.zeros((1, 1, 3), np.uint8)
    base = np.floor(points.min(0))
    shape = (np.ceil(points.max(0)) - base + 1).astype(int)
    out = np.zeros((*shape, 3), np.uint8)
    for r in rings:
        for a, b in zip(r, r[1:] + r[:1]):
            a, b = (np.array(p, float) / um - base for p in (a, b))
            steps = int(np.abs(b - a).max()) * 2 + 2
            line = np.rint(a + (b - a) * np.linspace(0, 1, steps)[:, None]).astype(int)
            out[line[:, 0], line[:, 1]] = ink
    return out


def oriented(image: np.ndarray, transpose: bool = False, upside_down: bool = False, mirrored: bool = False) -> np.ndarray:
    """An image with its axes exchanged, its rows or its columns reversed, in this order."""
    out = image.transpose(1, 0, 2) if transpose else image
    out = out[::-1] if upside_down else out
    return np.ascontiguousarray(out[:, ::-1] if mirrored else out)


def with_argmax(df: DataFrame, value: str = "theta") -> DataFrame:
    return df.withColumn("factor", argmax(F.col(value)))


def image(cells: DataFrame, background: tuple[float, float, float] = (0, 0, 0), most: int = 1 << 26, origin: str = "upper") -> np.ndarray:
    """Cells (px, py, r, g, b) as an image with x along the rows; refused above ``most`` cells of area."""
    box = cells.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if box[0] is None:
        return np.zeros((1, 1, 3), np.uint8)
    x0, x1, y0, y1 = map(int, box)
    if (x1 - x0 + 1) * (y1 - y0 + 1) > most:
        raise ValueError("the image is too large: choose coarser cells")
    out = np.empty((x1 - x0 + 1, y1 - y0 + 1, 3), float)
    out[:] = background
    got = cells.select("px", "py", "r", "g", "b").toPandas()
    out[got.px.to_numpy() - x0, got.py.to_numpy() - y0] = got[["r", "g", "b"]].to_numpy(float)
    out = out[::-1] if origin == "upper" else out
    return np.clip((out * 255).astype(int), 0, 255).astype(np.uint8)
