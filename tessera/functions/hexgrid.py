"""Pointy-top hexagonal lattices in axial coordinates, as column expressions.

A lattice of width w (flat to flat) has hexagons of radius w / sqrt(3). Offsets
shift it by fractions of a cell. All rounding is half to even.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

R3 = math.sqrt(3)


def radius_of(width: float) -> float:
    return width / R3


def area_of(width: float) -> float:
    """A hexagon's area: radius times width times 3/2."""
    return radius_of(width) * width * 1.5


def pixel_to_hex(x: Column, y: Column, radius: float, ox: Column | float = 0.0, oy: Column | float = 0.0) -> Column:
    """struct(hx, hy): the cell of a point."""
    size = F.lit(float(radius))
    q = (F.lit(R3 / 3) * x - y / F.lit(3.0)) / size + (ox if isinstance(ox, Column) else F.lit(float(ox)))
    r = (F.lit(2 / 3) * y) / size + (oy if isinstance(oy, Column) else F.lit(float(oy)))
    rx, ry = F.rint(q), F.rint(r)
    dq, dr = q - rx, r - ry
    across = F.abs(dq) < F.abs(dr)
    hx = F.when(across, rx).otherwise(rx + F.rint(dq + dr / F.lit(2.0)))
    hy = F.when(across, ry + F.rint(dr + dq / F.lit(2.0))).otherwise(ry)
    return F.struct(hx.cast("long").alias("hx"), hy.cast("long").alias("hy"))


def hex_to_pixel(hx: Column, hy: Column, radius: float, ox: Column | float = 0.0, oy: Column | float = 0.0) -> tuple[Column, Column]:
    """The centre of a cell."""
    a = hx - (ox if isinstance(ox, Column) else F.lit(float(ox)))
    b = hy - (oy if isinstance(oy, Column) else F.lit(float(oy)))
    size = F.lit(float(radius))
    return size * (F.lit(R3) * a + F.lit(R3 / 2) * b), F.lit(1.5) * size * b


def offsets(n: int) -> Column:
    """The n * n lattice offsets as an array of (ox, oy), numbers of n-ths of a cell."""
    return F.array(*(F.struct(F.lit(i).alias("ox"), F.lit(j).alias("oy")) for i in range(n) for j in range(n)))


def moves(n_move: int, width: float) -> int:
    """The number of moves a lattice can take: more than half its width in units are too many."""
    return int(width) // 4 if n_move > int(width) // 2 else n_move


def register(spark: SparkSession) -> None:
    """SQL functions hex_q and hex_r (x, y, radius, ox, oy), and the table function hex_offsets(n)."""
    q, r = "((0.5773502691896257D * x - y / 3D) / radius + ox)", "((0.6666666666666666D * y) / radius + oy)"
    dq, dr = f"({q} - rint({q}))", f"({r} - rint({r}))"
    args = "x DOUBLE, y DOUBLE, radius DOUBLE, ox DOUBLE, oy DOUBLE"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hex_q({args}) RETURNS BIGINT RETURN CAST(CASE WHEN abs({dq}) < abs({dr}) THEN rint({q}) ELSE rint({q}) + rint({dq} + {dr} / 2D) END AS BIGINT)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hex_r({args}) RETURNS BIGINT RETURN CAST(CASE WHEN abs({dq}) < abs({dr}) THEN rint({r}) + rint({dr} + {dq} / 2D) ELSE rint({r}) END AS BIGINT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hex_offsets(n INT) RETURNS TABLE (ox INT, oy INT) RETURN SELECT o.i DIV n, o.i % n FROM (SELECT explode(sequence(0, n * n - 1)) AS i) o")
