"""Adaptive square tiles: a quadtree over counts, whose leaves hold a bounded number of rows.

Rows are counted by cells of the finest width; a node of a level is 2 x 2 nodes of
the level below, so that a node's number is a cell's number shifted. The leaf of
a cell is the largest node with it that has at most ``most`` rows, or the cell
itself where even that has more. Counts of all levels are one aggregation, and
what is joined with rows afterwards is a table of occupied cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = ["level", "qx", "qy"]


@dataclass
class Cells:
    """Cells of a width, numbered from an origin; ``depth`` levels above them, the last of which is one node."""

    x0: float
    y0: float
    width: float
    depth: int

    @classmethod
    def over(cls, box: tuple[float, float, float, float], width: float) -> Cells:
        """Cells for a box (xmin, xmax, ymin, ymax)."""
        many = int(max(box[1] - box[0], box[3] - box[2]) // width) + 1
        return cls(box[0], box[2], width, (many - 1).bit_length())

    def numbers(self, x: Column, y: Column) -> list[Column]:
        return [F.floor((c - F.lit(float(o))) / F.lit(float(self.width))).cast("long").alias(n) for c, o, n in ((x, self.x0, "cx"), (y, self.y0, "cy"))]

    def nodes(self) -> Column:
        """The nodes of every level with a cell (cx, cy)."""
        return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("cx", k).alias("qx"), F.shiftright("cy", k).alias("qy")) for k in range(self.depth + 1)))

    def gap(self, x: Column, y: Column) -> Column:
        """How far a place is outside of a node's square, along the axis where it is farther."""
        side = F.lit(float(self.width)) * F.pow(F.lit(2.0), F.col("level"))
        out = [F.greatest(F.lit(o) + F.col(q) * side - c, c - F.lit(o) - (F.col(q) + 1) * side) for c, o, q in ((x, float(self.x0), "qx"), (y, float(self.y0), "qy"))]
        return F.greatest(*out, F.lit(0.0))


def leaves(rows: DataFrame, cells: Cells, most: int, x: str = "X", y: str = "Y") -> DataFrame:
    """(cx, cy, level, qx, qy): the leaf of each occupied cell."""
    counts = rows.groupBy(*cells.numbers(F.col(x), F.col(y))).agg(F.count("*").alias("n"))
    listed = counts.select("cx", "cy", "n", F.inline(cells.nodes()))
    fit = listed.groupBy(*NODE).agg(F.sum("n").alias("all")).filter((F.col("all") <= most) | (F.col("level") == 0)).drop("all")
    # Counts rise with the level, so the highest node that fits has only such below it.
    top = listed.join(fit, NODE).groupBy("cx", "cy").agg(F.max("level").cast("int").alias("level"))
    return top.withColumns({"qx": F.expr("shiftright(cx, level)"), "qy": F.expr("shiftright(cy, level)")})


def around(found: DataFrame, cells: Cells, reach: float) -> DataFrame:
    """(cx, cy, nodes): for each cell the leaves that have an occupied cell within ``reach`` of it."""
    m = -int(-reach // cells.width)
    steps = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in range(-m, m + 1) for j in range(-m, m + 1)))
    return found.select(F.struct(*NODE).alias("node"), F.inline(steps)).groupBy("cx", "cy").agg(F.collect_set("node").alias("nodes"))


def spread(rows: DataFrame, near: DataFrame, cells: Cells, reach: float, x: str = "X", y: str = "Y") -> DataFrame:
    """``rows`` once for each leaf within ``reach``: level, qx, qy, and ``own`` where the row is in the leaf itself.

    ``near`` is what :func:`around` gives for this reach.
    """
    cx, cy = cells.numbers(F.col(x), F.col(y))
    listed = rows.withColumns({"cx": cx, "cy": cy}).join(near, ["cx", "cy"]).select("*", F.inline("nodes")).drop("nodes")
    own = (F.expr("shiftright(cx, level)") == F.col("qx")) & (F.expr("shiftright(cy, level)") == F.col("qy"))
    return listed.withColumn("own", own).filter(F.col("own") | (cells.gap(F.col(x), F.col(y)) <= F.lit(float(reach)))).drop("cx", "cy")
