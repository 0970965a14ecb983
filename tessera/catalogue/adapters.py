"""Pixels, markers, anchors and mixtures made from the test tables by plain expressions, for Spark and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hexgrid import area_of, radius_of
from tessera.functions.vectors import arrayed
from tessera.operators.binning import hex_units


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels X, Y, gene, Count, grp."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 100).alias("X"), ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 1000).cast("double").alias("Y"),
        (F.col("l_partkey") % 50).cast("string").alias("gene"), F.col("l_quantity").cast("int").alias("Count"), F.col("l_returnflag").alias("grp"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts gene, factor, n."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).cast("string").alias("gene"), (F.col("l_suppkey") % 5).cast("int").alias("factor"), F.col("l_quantity").alias("n"))


def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts unit, gene, n."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("unit"), (F.col("l_partkey") % 50).cast("string").alias("gene"), "l_quantity")
    return rows.groupBy("unit", "gene").agg(F.sum("l_quantity").alias("n"))


def theta_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures unit, factor, p."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("unit"), (F.col("l_suppkey") % 5).cast("int").alias("factor"), "l_quantity")
    by = rows.groupBy("unit", "factor").agg(F.sum("l_quantity").alias("n"))
    return by.join(by.groupBy("unit").agg(F.sum("n").alias("t")), "unit").select("unit", "factor", (F.col("n") / F.col("t")).alias("p"))


def theta0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures as arrays: unit, theta."""
    return arrayed(theta_long(spark, sf_dir), ["unit"], "factor", "p", 5)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexagon centres x, y of width 24 with at least 20 counts, and their cells."""
    return hex_units(px(spark, sf_dir), 24.0, 1).select("hx", "hy", "x", "y", "tot")


def words(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """A row unit, gene, n = 1 for each word of each document; ``dealt``: documents go by their unit first, so that what follows by unit needs no shuffle."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "text")
    docs = docs.repartition("unit") if dealt else docs
    return docs.select("unit", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("gene"), F.lit(1).cast("long").alias("n")).filter("gene <> ''")


def tokens(spark: SparkSession, sf_dir: str, least: int = 50) -> DataFrame:
    """Counts unit, gene, n of words in documents; words with at least ``least`` in all."""
    every = words(spark, sf_dir)
    kept = words(spark, sf_dir, False).groupBy("gene").agg(F.sum("n").alias("t")).filter(F.col("t") >= least)
    return every.join(kept, "gene", "left_semi").groupBy("unit", "gene").agg(F.sum("n").alias("n"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, for comparison."""
    return df.withColumns({c: F.round(F.col(c), digits) for c, t in df.dtypes if t == "double"})


# --- the same as SQL ---

PX = """px AS (SELECT l_extendedprice / 100 AS X, CAST((l_partkey * 37 + l_suppkey * 11) % 1000 AS DOUBLE) AS Y, CAST(l_partkey % 50 AS VARCHAR) AS gene,
    CAST(trunc(l_quantity) AS INT) AS Count, l_returnflag AS grp FROM lineitem)"""
LABELLED = "labelled AS (SELECT CAST(l_partkey % 50 AS VARCHAR) AS gene, CAST(l_suppkey % 5 AS INT) AS factor, l_quantity AS n FROM lineitem)"
UNITS = "counts AS (SELECT l_orderkey % 500 AS unit, CAST(l_partkey % 50 AS VARCHAR) AS gene, sum(l_quantity) AS n FROM lineitem GROUP BY ALL)"
THETA = """tn AS (SELECT l_orderkey % 500 AS unit, CAST(l_suppkey % 5 AS INT) AS factor, sum(l_quantity) AS n FROM lineitem GROUP BY ALL),
theta AS (SELECT unit, factor, n / sum(n) OVER (PARTITION BY unit) AS p FROM tn)"""


def hexed_sql(width: float, n: int, source: str = "px") -> str:
    """CTEs qr and hexed: pixels for each offset with their cell."""
    size = radius_of(width)
    return f"""o AS (SELECT CAST(a.range AS INT) AS ox, CAST(b.range AS INT) AS oy FROM range({n}) a, range({n}) b),
qr AS (SELECT s.*, ox, oy, ({math.sqrt(3) / 3!r}::DOUBLE * X - Y / 3.0::DOUBLE) / {size!r}::DOUBLE + ox / {float(n)!r}::DOUBLE AS q, ({2 / 3!r}::DOUBLE * Y) / {size!r}::DOUBLE + oy / {float(n)!r}::DOUBLE AS r FROM {source} s, o),
rq AS (SELECT *, round_even(q, 0) AS rx, round_even(r, 0) AS ry FROM qr),
hexed AS (SELECT * EXCLUDE (q, r, rx, ry), CAST(CASE WHEN abs(q - rx) < abs(r - ry) THEN rx ELSE rx + round_even((q - rx) + (r - ry) / 2.0::DOUBLE, 0) END AS BIGINT) AS hx,
    CAST(CASE WHEN abs(q - rx) < abs(r - ry) THEN ry + round_even((r - ry) + (q - rx) / 2.0::DOUBLE, 0) ELSE ry END AS BIGINT) AS hy FROM rq)"""


def centre_sql(width: float, n: int) -> tuple[str, str]:
    size = radius_of(width)
    a, b = f"(hx - ox / {float(n)!r}::DOUBLE)", f"(hy - oy / {float(n)!r}::DOUBLE)"
    return f"{size!r}::DOUBLE * ({math.sqrt(3)!r}::DOUBLE * {a} + {math.sqrt(3) / 2!r}::DOUBLE * {b})", f"1.5::DOUBLE * {size!r}::DOUBLE * {b}"


def anchors_sql() -> str:
    x, y = centre_sql(24.0, 1)
    return f"{hexed_sql(24.0, 1)},\nanchors AS (SELECT hx, hy, {x} AS ax, {y} AS ay, sum(Count) AS tot FROM hexed GROUP BY ox, oy, hx, hy HAVING sum(Count) >= 20)"


AREA = area_of
