"""Queries: spatial joins, markers, mixtures, rasters, geometry, vendor tables, models, streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import streaming
from tessera.catalogue.adapters import LABELLED, PX, THETA, UNITS, anchors, anchors_sql, centre_sql, hexed_sql, labelled, px, rounded, table, theta0, theta_long, unit_counts
from tessera.functions import special
from tessera.functions import vectors as v
from tessera.functions.hexgrid import radius_of
from tessera.operators import binning as b
from tessera.operators import filters, markers, matrix, quadtree, rasters, regions
from tessera.operators import spatial as sp
from tessera.operators.decode import decode
from tessera.operators.lda import Lda
from tessera.plans.workflow import factor_colours
from tessera.schema import factor_columns
from tessera.sources import readers
from tessera.sources.sinks import numbered

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            S[fn.__name__] = sql
        return fn

    return add


A = f"WITH {PX}, {anchors_sql()}"
NU = math.log(0.5) / math.log(0.7)


def _radius_edges(pixels: DataFrame, a: DataFrame) -> DataFrame:
    e = sp.radius_join(pixels.select("X", "Y").distinct(), a, 13.0)
    return rounded(e.withColumn("w", sp.edge_weight(F.col("d"), 13.0, NU)).select("X", "Y", "hx", "hy", "d", "w"))


def _knn_join(pixels: DataFrame, a: DataFrame) -> DataFrame:
    p = pixels.select("X", "Y").distinct().withColumn("key", F.struct("X", "Y"))
    return sp.nearest(p, a.withColumn("tie", F.struct("hx", "hy")), 25.0, "key", "tie", 3).select("X", "Y", "hx", "hy", "rank")


def _knn_impute(pixels: DataFrame, a: DataFrame) -> DataFrame:
    p = pixels.select("X", "Y").distinct()
    near = a.select("x", "y", F.array(F.col("tot").cast("double")).alias("value"))
    return rounded(sp.imputed_around(p, near, 20.0, NU, "value").select("X", "Y", F.get("value", F.lit(0)).alias("value")))


@query(A + " SELECT X, Y, gene, Count FROM px WHERE EXISTS (SELECT 1 FROM anchors WHERE (X - ax) * (X - ax) + (Y - ay) * (Y - ay) < 49.3::DOUBLE AND abs(X - ax) < 8)")
def nearest_anchor_filter(spark: SparkSession, d: str) -> DataFrame:
    r = math.sqrt(49.3)
    return sp.near_any(px(spark, d), anchors(spark, d), r).select("X", "Y", "gene", "Count")


@query(A + f", c AS (SELECT DISTINCT X, Y FROM px), e AS (SELECT X, Y, hx, hy, sqrt((X - ax) * (X - ax) + (Y - ay) * (Y - ay)) AS d FROM c JOIN anchors ON abs(X - ax) <= 13 AND abs(Y - ay) <= 13) SELECT round(X, 6) AS X, round(Y, 6) AS Y, hx, hy, round(d, 6) AS d, round(1.0::DOUBLE - pow(d / 13.0::DOUBLE, {NU!r}::DOUBLE), 6) AS w FROM e WHERE d <= 13")
def radius_edges(spark: SparkSession, d: str) -> DataFrame:
    return _radius_edges(px(spark, d), anchors(spark, d))


@query(A + f", c AS (SELECT DISTINCT X, Y FROM px), e AS (SELECT X, Y, hx, hy, sqrt((X - ax) * (X - ax) + (Y - ay) * (Y - ay)) AS d FROM c JOIN anchors ON abs(X - ax) <= 25 AND abs(Y - ay) <= 25), k AS (SELECT *, row_number() OVER (PARTITION BY X, Y ORDER BY d, hx, hy) AS rank FROM e WHERE d <= 25) SELECT X, Y, hx, hy, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return _knn_join(px(spark, d), anchors(spark, d))


@query(A + f""", c AS (SELECT DISTINCT X, Y FROM px), t AS (SELECT hx, hy, ax, ay, tot::DOUBLE AS tot FROM anchors), e AS (SELECT X, Y, tot, sqrt((X - ax) * (X - ax) + (Y - ay) * (Y - ay)) AS d FROM c JOIN t ON abs(X - ax) <= 20 AND abs(Y - ay) <= 20),
w AS (SELECT *, 1.0::DOUBLE - pow(d / 20.0::DOUBLE, {NU!r}::DOUBLE) AS w FROM e WHERE d < 20) SELECT round(w.X, 6) AS X, round(w.Y, 6) AS Y, round(sum(w * tot) / sum(w), 6) AS value FROM w GROUP BY w.X, w.Y""")
def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    return _knn_impute(px(spark, d), anchors(spark, d))


NEIGHBOURS = """n AS (SELECT a.hx AS hx, a.hy AS hy, b.hx AS nx, b.hy AS ny FROM anchors a JOIN anchors b ON (b.hx - a.hx, b.hy - a.hy) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)))"""


@query(A + ", " + NEIGHBOURS + " SELECT hx, hy, nx, ny FROM n")
def lattice_neighbors(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d).withColumn("key", F.struct("hx", "hy")).persist()
    return sp.on_lattice(a, "key", 24.0).select("key.hx", "key.hy", F.col("other.hx").alias("nx"), F.col("other.hy").alias("ny"))


@query(A + f""", {NEIGHBOURS}, g AS (SELECT hx, hy, CAST(gene AS INT) % 4 AS factor, sum(Count)::DOUBLE AS n FROM hexed SEMI JOIN anchors USING (hx, hy) GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY hx, hy) AS p FROM g)
SELECT a.factor AS a, b.factor AS b, round(sum(a.p * b.p), 6) AS w FROM n JOIN t a ON n.hx = a.hx AND n.hy = a.hy JOIN t b ON n.nx = b.hx AND n.ny = b.hy GROUP BY a.factor, b.factor""")
def factor_proximity(spark: SparkSession, d: str) -> DataFrame:
    u = _anchor_theta(spark, d).persist()
    near = sp.on_lattice(u, "key", 24.0)
    return rounded(sp.proximity(near, u, "key").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "w"))


def _anchor_theta(spark: SparkSession, d: str) -> DataFrame:
    """Anchors key, x, y, theta: mixtures of four factors by gene number.

    One aggregation has both a cell's total and its mixture. A join of the two put a
    filter on the cell's numbers, which are long expressions, below both aggregations.
    """
    g = b.hexed(px(spark, d), 24.0).groupBy(*b.HEX, (F.col("gene").cast("int") % 4).alias("factor")).agg(F.sum("Count").cast("double").alias("n"))
    p = g.withColumn("tot", F.sum("n").over(Window.partitionBy(*b.HEX))).withColumn("p", F.col("n") / F.col("tot"))
    units = b.centres_of(v.arrayed(p, [*b.HEX, "tot"], "factor", "p", 4), 24.0, 1, 20)
    return units.filter("x IS NOT NULL").select(F.struct("hx", "hy").alias("key"), "x", "y", "theta")


@query(A + " SELECT a.hx, a.hy, b.hx AS nx, b.hy AS ny, round(sqrt((a.ax - b.ax) * (a.ax - b.ax) + (a.ay - b.ay) * (a.ay - b.ay)), 6) AS d FROM anchors a JOIN anchors b ON b.hx BETWEEN a.hx - 4 AND a.hx + 4 AND b.hy BETWEEN a.hy - 4 AND a.hy + 4 WHERE sqrt((a.ax - b.ax) * (a.ax - b.ax) + (a.ay - b.ay) * (a.ay - b.ay)) <= 50")
def anchor_graph(spark: SparkSession, d: str) -> DataFrame:
    """Anchors within twice the radius of each other, themselves included."""
    a = anchors(spark, d)
    left = a.select("hx", "hy", F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = a.select(F.col("hx").alias("nx"), F.col("hy").alias("ny"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return rounded(sp.radius_join(left, right, 50.0, "ax", "ay", "bx", "by").select("hx", "hy", "nx", "ny", "d"))


def _grid(binned: DataFrame) -> DataFrame:
    """All raster cells px, py of the rectangle that holds those of ``binned``."""
    px0, px1, py0, py1 = b.extent(binned, "px", "py")
    if px0 is None:
        return binned.select("px", "py").limit(0)
    w, h = px1 - px0 + 1, py1 - py0 + 1
    return binned.sparkSession.range(w * h).select((F.col("id") % w + px0).alias("px"), (F.floor(F.col("id") / w) + py0).alias("py"))


GRID = """e AS (SELECT a.px, b.py FROM (SELECT unnest(range(min(px), max(px) + 1)) AS px FROM c) a, (SELECT unnest(range(min(py), max(py) + 1)) AS py FROM c) b)"""


@query(A + f""", c AS (SELECT CAST(round_even(X / 20.0::DOUBLE, 0) AS BIGINT) AS px, CAST(round_even(Y / 20.0::DOUBLE, 0) AS BIGINT) AS py, CAST(sum(Count) AS BIGINT) AS n FROM px GROUP BY 1, 2),
{GRID}, m AS (SELECT * FROM e ANTI JOIN c USING (px, py)),
r AS (SELECT m.px, m.py, c.n, row_number() OVER (PARTITION BY m.px, m.py ORDER BY (m.px - c.px) * (m.px - c.px) + (m.py - c.py) * (m.py - c.py), c.px, c.py) AS rn FROM m JOIN c ON c.px BETWEEN m.px - 2 AND m.px + 2 AND c.py BETWEEN m.py - 2 AND m.py + 2 WHERE (m.px - c.px) * (m.px - c.px) + (m.py - c.py) * (m.py - c.py) <= 4)
SELECT px, py, n FROM c UNION ALL SELECT px, py, n FROM r WHERE rn = 1""")
def raster_filled(spark: SparkSession, d: str) -> DataFrame:
    """Raster counts of all pixels, with empty cells of the whole extent filled from the nearest within two cells."""
    return _raster_filled_all(px(spark, d))


def _raster_filled_all(pixels: DataFrame) -> DataFrame:
    known = b.raster(pixels, 20.0, "X", "Y").groupBy("px", "py").agg(F.sum("Count").alias("n"))
    return rasters.filled(_grid(known), known, 2, "n")


@query(f"""WITH {PX}, e AS (SELECT min(X) AS x0, max(X) AS x1 FROM px), k AS (SELECT greatest(1, CAST(ceil((x1 - 100.0 + 1 - x0) / 170.0) AS INT)) AS n, x0 FROM e)
SELECT CAST(greatest(0, least(n - 1, CAST(ceil((X - (x0 + 15.0::DOUBLE)) / 170.0::DOUBLE) AS INT) - 1)) AS INT) AS tile, count(*) AS n FROM px, k GROUP BY 1""")
def tile_owner(spark: SparkSession, d: str) -> DataFrame:
    """Pixels by the one tile of the x axis that they belong to."""
    p = px(spark, d)
    x0, x1, _, _ = b.extent(p)
    return p.groupBy(b.owner(F.col("X"), x0, x1, 200.0, 30.0).cast("int").alias("tile")).agg(F.count("*").alias("n"))


@query(f"WITH {PX} SELECT CAST(floor((Y - 10.0::DOUBLE) / 75.0::DOUBLE) AS BIGINT) AS win, CAST(sum(CASE WHEN grp = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS A, CAST(sum(CASE WHEN grp = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS N FROM px GROUP BY 1")
def window_dummies(spark: SparkSession, d: str) -> DataFrame:
    """Indicator columns summed by window of the minor axis."""
    out = filters.dummies(px(spark, d), "grp", ["A", "N"]).withColumn("win", b.minor_windows(F.col("Y"), 10.0, 75.0))
    return out.groupBy("win").agg(F.sum("A").alias("A"), F.sum("N").alias("N"))


@query(f"""WITH {UNITS}, s AS (SELECT (unit + 1) % 500 AS unit, gene, n AS bn FROM counts), j AS (SELECT coalesce(c.unit, s.unit) AS unit, coalesce(c.gene, s.gene) AS gene, coalesce(c.n, 0) AS n, coalesce(bn, 0) AS buffer_n FROM counts c FULL JOIN s ON c.unit = s.unit AND c.gene = s.gene)
SELECT unit, gene, n, buffer_n, round(sum(buffer_n) OVER (PARTITION BY unit) / (sum(buffer_n) OVER (PARTITION BY unit) + 100.0::DOUBLE), 6) AS buffer_weight FROM j""")
def augmented_units(spark: SparkSession, d: str) -> DataFrame:
    """Units with the counts of the unit before as their surroundings."""
    c = unit_counts(spark, d)
    return rounded(matrix.augmented(c, c.withColumn("unit", (F.col("unit") + 1) % 500), 100.0))


# --- markers ---

DE = f"""WITH {LABELLED}, a0 AS (SELECT gene, factor, sum(n) AS a FROM labelled GROUP BY ALL), g AS (SELECT gene, sum(a) AS gt FROM a0 GROUP BY gene HAVING sum(a) >= 50),
a1 AS (SELECT a0.*, gt FROM a0 JOIN g USING (gene)), a2 AS (SELECT *, sum(a) OVER (PARTITION BY factor) AS kt, sum(a) OVER () AS t FROM a1),
a3 AS (SELECT *, gt - a AS b, kt - a AS c, t - kt - gt + a AS d FROM a2), a4 AS (SELECT *, (a / kt) / (b / (t - kt)) AS fold, round_even(a, 0) + 1.0::DOUBLE AS w, round_even(b, 0) + 1.0::DOUBLE AS x, round_even(c, 0) + 1.0::DOUBLE AS y, round_even(d, 0) + 1.0::DOUBLE AS z FROM a3 WHERE a > 0 AND b > 0),
de AS (SELECT gene, CAST(factor AS VARCHAR) AS factor, (w + x + y + z) * (w * z - x * y) * (w * z - x * y) / ((w + x) * (y + z) * (w + y) * (x + z)) AS chi2, fold, CAST(gt AS BIGINT) AS gene_total FROM a4 WHERE fold >= 1)"""
CRITICAL = special.critical(1e-3)
RANKED = DE + ", r AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY chi2 DESC) + (count(*) OVER (PARTITION BY factor, chi2) - 1) / 2.0::DOUBLE AS rank FROM de)"


@query(DE + " SELECT gene, factor, round(chi2, 6) AS chi2, round(fold, 6) AS fold, gene_total FROM de")
def de_chisq(spark: SparkSession, d: str) -> DataFrame:
    return rounded(markers.chi_square(labelled(spark, d)))


@query(RANKED + f" SELECT gene, factor, round(chi2, 6) AS chi2, rank FROM r WHERE (chi2 > {CRITICAL!r}::DOUBLE AND fold > 1.5) OR rank < 10")
def de_ranked(spark: SparkSession, d: str) -> DataFrame:
    return rounded(markers.ranked(markers.chi_square(labelled(spark, d))).select("gene", "factor", "chi2", "rank"))


TOP = f"""t AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY {{v}} DESC) AS rk, row_number() OVER (PARTITION BY factor ORDER BY {{v}} DESC, gene) AS rn FROM de),
k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY rn) AS rn2 FROM t WHERE rk < 10 OR (chi2 > {CRITICAL!r}::DOUBLE AND fold >= 1.5)), top AS (SELECT factor, string_agg(gene, ', ' ORDER BY rn2) AS genes FROM k WHERE rn2 <= 20 GROUP BY factor)"""


@query(DE + ", " + TOP.format(v="chi2") + " SELECT factor, genes FROM top")
def de_topgenes(spark: SparkSession, d: str) -> DataFrame:
    return markers.top_genes(markers.chi_square(labelled(spark, d)))


@query(DE + ", " + TOP.format(v="chi2") + ", " + TOP.format(v="fold").replace("t AS", "t2 AS").replace("FROM t ", "FROM t2 ").replace("k AS", "k2 AS").replace("FROM k ", "FROM k2 ").replace("top AS", "top2 AS") + f""",
h AS (SELECT CAST(factor AS VARCHAR) AS factor, gene, a, row_number() OVER (PARTITION BY factor ORDER BY a DESC, gene) AS rn FROM a0), s AS (SELECT factor, sum(a) AS n FROM h GROUP BY factor)
SELECT s.factor, round(s.n / (SELECT sum(n) FROM s), 6) AS weight, CAST(s.n AS BIGINT) AS post_umi, coalesce(top.genes, '.') AS top_chi2, coalesce(top2.genes, '.') AS top_fold, hv.genes AS top_weight
FROM s LEFT JOIN top USING (factor) LEFT JOIN top2 USING (factor) JOIN (SELECT factor, string_agg(gene, ', ' ORDER BY rn) AS genes FROM h WHERE rn <= 20 GROUP BY factor) hv USING (factor)""")
def factor_table(spark: SparkSession, d: str) -> DataFrame:
    c = labelled(spark, d)
    return rounded(markers.factor_table(c, markers.chi_square(c)))


@query(f"WITH {LABELLED.replace('labelled AS', 'l0 AS')}, labelled AS (SELECT * FROM l0 WHERE gene IN (SELECT CAST(p_partkey % 25 AS VARCHAR) FROM part)), " + DE.split(LABELLED + ", ")[1] + " SELECT gene, factor, round(chi2, 6) AS chi2, round(fold, 6) AS fold, gene_total FROM de")
def de_gene_set(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "part").select((F.col("p_partkey") % 25).cast("string").alias("gene"))
    return rounded(markers.chi_square(labelled(spark, d), genes=listed))


# --- mixtures ---

FULL = f"""WITH {THETA}, full_t AS (SELECT u.unit, k.k, coalesce(t.p, 0.0::DOUBLE) AS p FROM (SELECT DISTINCT unit FROM theta) u CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range(5)) k LEFT JOIN theta t ON t.unit = u.unit AND t.factor = k.k),
rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p DESC, k) AS rn FROM full_t)"""


@query(FULL + " SELECT unit, " + ", ".join(f"max(k) FILTER (WHERE rn = {i}) AS K{i}, round(max(p) FILTER (WHERE rn = {i}), 6) AS P{i}" for i in (1, 2, 3)) + " FROM rk GROUP BY unit")
def topk_wide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(v.with_top(theta0(spark, d), 3).drop("theta"))


@query(FULL + " SELECT unit, k AS topK, round(p, 6) AS topP FROM rk WHERE rn = 1")
def argmax_top(spark: SparkSession, d: str) -> DataFrame:
    return rounded(theta0(spark, d).select("unit", v.argmax(F.col("theta")).alias("topK"), F.array_max("theta").alias("topP")))


@query(f"WITH {THETA}, {UNITS} SELECT gene, factor, round(sum(p * counts.n), 4) AS cnt FROM counts JOIN theta USING (unit) GROUP BY gene, factor")
def posterior_counts(spark: SparkSession, d: str) -> DataFrame:
    out = v.posterior_counts(theta0(spark, d), unit_counts(spark, d))
    return rounded(out.select("gene", F.col("factor").cast("int").alias("factor"), "cnt"), 4)


@query(FULL + " SELECT unit % 7 AS label, k AS topK, count(*) AS n FROM rk WHERE rn = 1 GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    t = theta0(spark, d).select((F.col("unit") % 7).alias("label"), v.argmax(F.col("theta")).alias("topK"))
    return v.confusion(t, "label", "topK")


@query(f"WITH {THETA} SELECT unit, " + ", ".join(f"round(coalesce(max(p) FILTER (WHERE factor = {k}), 0.0::DOUBLE), 6) AS f_{k}" for k in range(5)) + " FROM theta GROUP BY unit")
def factor_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = theta_long(spark, d).groupBy("unit").pivot("factor", list(range(5))).agg(F.max("p")).fillna(0.0)
    wide = wide.toDF("unit", *(f"f_{k}" for k in range(5)))
    assert list(factor_columns(wide.columns)) == list("01234")
    return rounded(wide)


MARK = f"""m0 AS (SELECT factor, gene, row_number() OVER (PARTITION BY factor ORDER BY chi2 DESC, gene) AS rn FROM de), m AS (SELECT CAST(factor AS INT) AS factor, gene FROM m0 WHERE rn <= 10)"""


@query(DE.replace("WITH ", f"WITH {THETA}, {UNITS}, ", 1) + f""", {MARK}, f AS (SELECT gene, sum(n) AS f FROM counts GROUP BY gene), mf AS (SELECT factor, gene, f, row_number() OVER (PARTITION BY factor ORDER BY f DESC, gene) AS r FROM m JOIN f USING (gene)),
p AS (SELECT i.factor, i.gene AS gi, j.gene AS gj, i.f AS fi, j.f AS fj FROM mf i JOIN mf j ON i.factor = j.factor AND i.r < j.r),
s AS (SELECT p.factor, sum(theta.p * ln(coalesce(cj.n, 0) / (ci.n * fj / fi) + 1.0::DOUBLE)) AS score0 FROM p JOIN counts ci ON ci.gene = gi AND ci.n > 0 LEFT JOIN counts cj ON cj.unit = ci.unit AND cj.gene = gj JOIN theta ON theta.unit = ci.unit AND theta.factor = p.factor GROUP BY p.factor)
SELECT factor, round(score0, 5) AS score0, round(score0 / (SELECT sum(p) FROM theta WHERE theta.factor = s.factor), 6) AS score FROM s""")
def coherence(spark: SparkSession, d: str) -> DataFrame:
    tests = markers.chi_square(labelled(spark, d)).withColumn("_r", F.row_number().over(Window.partitionBy("factor").orderBy(F.col("chi2").desc(), "gene"))).filter("_r <= 10")
    out = markers.coherence(unit_counts(spark, d), theta_long(spark, d), tests.select(F.col("factor").cast("int").alias("factor"), "gene"))
    return out.select("factor", F.round("score0", 5).alias("score0"), F.round("score", 6).alias("score"))


@query(f"WITH {THETA}, w AS (SELECT factor, sum(p) AS w FROM theta GROUP BY factor) SELECT factor, round(sum(w) OVER (ORDER BY factor) / sum(w) OVER (), 6) AS cumulative FROM w")
def cumulative_weights(spark: SparkSession, d: str) -> DataFrame:
    w = theta_long(spark, d).groupBy("factor").agg(F.sum("p").alias("w"))  # one row a factor
    return rounded(w.select("factor", (F.sum("w").over(Window.orderBy("factor")) / F.sum("w").over(Window.partitionBy(F.lit(1)))).alias("cumulative")))


# --- rasters ---

COLOURS = [(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, 1.0, 1.0, 0.0)]
SQL_COLOURS = "colours AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {r}::DOUBLE, {g}::DOUBLE, {bb}::DOUBLE)" for k, r, g, bb in COLOURS) + ") c(factor, R, G, B))"
PIXEL_TOP = f"pt AS (SELECT X, Y, CAST(CAST(gene AS INT) % 4 AS INT) AS K1, CAST(CAST(gene AS INT) % 3 AS INT) AS K2, Count / 50.0::DOUBLE AS P1, 1.0::DOUBLE - Count / 50.0::DOUBLE AS P2 FROM px)"
CELL = "CAST(round_even(X / 20.0::DOUBLE, 0) AS BIGINT) AS px, CAST(round_even(Y / 20.0::DOUBLE, 0) AS BIGINT) AS py"


def _pixel_top(spark: SparkSession, d: str) -> DataFrame:
    g, n = F.col("gene").cast("int"), F.col("Count") / F.lit(50.0)
    return px(spark, d).select("X", "Y", (g % 4).alias("K1"), (g % 3).alias("K2"), n.alias("P1"), (F.lit(1.0) - n).alias("P2"))


@query(f"WITH {PX} SELECT {CELL}, round(avg(Count), 6) AS value FROM px GROUP BY 1, 2")
def raster_mean(spark: SparkSession, d: str) -> DataFrame:
    cells = rasters.mean_values(px(spark, d).withColumn("theta", F.array(F.col("Count").cast("double"))), 20.0, x="X", y="Y")
    return rounded(cells.select("px", "py", F.col("p").alias("value")))


LONG_TOP = f"long_t AS (SELECT {CELL}, K1 AS factor, P1 AS p FROM pt UNION ALL SELECT {CELL}, K2, P2 FROM pt), nn AS (SELECT px, py, count(*) / 2.0::DOUBLE AS n FROM long_t GROUP BY px, py)"


@query(f"WITH {PX}, {PIXEL_TOP}, {SQL_COLOURS}, {LONG_TOP} SELECT px, py, round(sum(p * R) / any_value(n), 6) AS r, round(sum(p * G) / any_value(n), 6) AS g, round(sum(p * B) / any_value(n), 6) AS b FROM long_t JOIN nn USING (px, py) JOIN colours USING (factor) GROUP BY px, py")
def raster_topk_rgb(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame(COLOURS, "factor int, R double, G double, B double")
    return rounded(rasters.top_rgb(_pixel_top(spark, d), 20.0, c, 2))


@query(f"WITH {PX}, {PIXEL_TOP}, {LONG_TOP} SELECT px, py, factor, round(sum(p) / any_value(n), 6) AS p FROM long_t JOIN nn USING (px, py) WHERE p > 0 GROUP BY px, py, factor")
def raster_single(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rasters.single_factors(_pixel_top(spark, d), 20.0, 4, 2))


@query(f"""WITH {PX}, {PIXEL_TOP}, c AS (SELECT {CELL}, CASE WHEN K1 = 0 THEN P1 ELSE 0 END + CASE WHEN K2 = 0 THEN P2 ELSE 0 END AS a, CASE WHEN K1 = 1 THEN P1 ELSE 0 END + CASE WHEN K2 = 1 THEN P2 ELSE 0 END AS b FROM pt)
SELECT px, py, round(avg(a), 6) AS r, round(avg(b), 6) AS g, round(avg(b), 6) AS b, round(max(a + b), 6) AS a FROM c WHERE a + b >= 0.1 GROUP BY px, py""")
def raster_channels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rasters.channels(_pixel_top(spark, d), 20.0, [(0, (1, 0, 0)), (1, (0, 1, 1))], 2))


_SIZE = radius_of(24.0)


@query(f"""WITH {PX}, {anchors_sql()}, c AS (SELECT CAST(round_even(X / 10.0::DOUBLE, 0) AS BIGINT) AS px, CAST(round_even(Y / 10.0::DOUBLE, 0) AS BIGINT) AS py FROM px), {GRID.replace('e AS', 'cells AS', 1)}, q0 AS (SELECT px, py, ({math.sqrt(3) / 3!r}::DOUBLE * (px * 10.0::DOUBLE) - (py * 10.0::DOUBLE) / 3.0::DOUBLE) / {_SIZE!r}::DOUBLE + 0.0::DOUBLE AS q, ({2 / 3!r}::DOUBLE * (py * 10.0::DOUBLE)) / {_SIZE!r}::DOUBLE + 0.0::DOUBLE AS r FROM cells),
q1 AS (SELECT *, round_even(q, 0) AS rx, round_even(r, 0) AS ry FROM q0), q2 AS (SELECT px, py, CAST(CASE WHEN abs(q - rx) < abs(r - ry) THEN rx ELSE rx + round_even((q - rx) + (r - ry) / 2.0::DOUBLE, 0) END AS BIGINT) AS hx, CAST(CASE WHEN abs(q - rx) < abs(r - ry) THEN ry + round_even((r - ry) + (q - rx) / 2.0::DOUBLE, 0) ELSE ry END AS BIGINT) AS hy FROM q1)
SELECT hx, hy, px, py, CAST(tot AS BIGINT) AS tot FROM q2 JOIN anchors USING (hx, hy)""")
def hex_raster(spark: SparkSession, d: str) -> DataFrame:
    """Raster cells of the pixels' whole extent with the hexagon that they are in."""
    return _hex_raster_all(px(spark, d), anchors(spark, d))


def _hex_raster_all(pixels: DataFrame, a: DataFrame) -> DataFrame:
    cells = _grid(b.raster(pixels, 10.0, "X", "Y"))
    return rasters.hexagon_cells(a.select("hx", "hy", "tot"), cells, 10.0, 24.0).select("hx", "hy", "px", "py", "tot")


@query(f"WITH {PX}, n AS (SELECT {CELL}, grp, count(*) AS n FROM px GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY n DESC, CASE grp WHEN 'A' THEN 'first' ELSE grp END) AS rn FROM n) SELECT px, py, CASE grp WHEN 'A' THEN 'first' ELSE grp END AS category FROM r WHERE rn = 1")
def raster_categories(spark: SparkSession, d: str) -> DataFrame:
    return rasters.categories(px(spark, d), 20.0, "grp", spark.createDataFrame([("A", "first")], "`From` string, `To` string"), "X", "Y")


# --- geometry, maps, vendor tables ---

RING = [(100.0, 100.0), (700.0, 150.0), (600.0, 800.0), (400.0, 400.0), (150.0, 700.0)]


def _inside_sql(*rings: list, x: str = "X", y: str = "Y") -> str:
    """The even-odd rule for the rings of one polygon."""
    terms = [f"CASE WHEN ({y} < {y1}::DOUBLE) <> ({y} < {y2}::DOUBLE) AND {x} < ({x2}::DOUBLE - {x1}::DOUBLE) * ({y} - {y1}::DOUBLE) / ({y2}::DOUBLE - {y1}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END" for ring in rings or (RING,) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if y1 != y2]
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query(f"WITH {PX} SELECT X, Y, gene, Count FROM px WHERE {_inside_sql()}")
def polygon_filter(spark: SparkSession, d: str) -> DataFrame:
    return px(spark, d).filter(sp.inside(F.col("X"), F.col("Y"), [RING])).select("X", "Y", "gene", "Count")


@query(f"WITH {PX} SELECT gene, count(*) AS n FROM px WHERE {_inside_sql()} GROUP BY gene")
def polygon_join(spark: SparkSession, d: str) -> DataFrame:
    """Distinct places meet the edges of their strip; pixels follow their place."""
    return sp.within(px(spark, d), readers.edges(spark, [RING])).groupBy("gene").agg(F.count("*").alias("n"))


#: Two polygons that overlap; one with a hole in which there is another polygon.
OVERLAP = [[RING], [[(300.0, 120.0), (900.0, 120.0), (900.0, 620.0), (300.0, 620.0)]]]
HOLED = [[[(50.0, 50.0), (950.0, 80.0), (900.0, 930.0), (80.0, 900.0)], [(250.0, 250.0), (750.0, 260.0), (720.0, 740.0), (260.0, 700.0)]], [[(400.0, 400.0), (600.0, 420.0), (500.0, 600.0)]]]


def _any_of(polygons: list, **names) -> str:
    return "(" + " OR ".join(_inside_sql(*rings, **names) for rings in polygons) + ")"


def _twice(spark: SparkSession, d: str) -> DataFrame:
    """Pixels, each of them twice."""
    return px(spark, d).withColumn("_i", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_i")


@query(f"WITH {PX} SELECT gene, 2 * count(*) AS n, CAST(2 * sum(Count) AS BIGINT) AS total FROM px WHERE {_any_of(OVERLAP)} GROUP BY gene")
def polygon_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Repeated pixels in polygons that overlap: all rows of a place in either are kept."""
    return sp.within(_twice(spark, d), readers.polygon_edges(spark, OVERLAP)).groupBy("gene").agg(F.count("*").alias("n"), F.sum("Count").alias("total"))


@query(f"WITH {PX} SELECT X, Y, gene, Count FROM px WHERE {_any_of(HOLED)}")
def polygon_holes(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in a polygon with a hole, or in one that is in the hole."""
    return sp.within(px(spark, d), readers.polygon_edges(spark, HOLED)).select("X", "Y", "gene", "Count")


@query(A + f" SELECT hx, hy, CAST(tot AS BIGINT) AS tot FROM anchors WHERE {_any_of(HOLED, x='ax', y='ay')}")
def hex_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Hexagons whose centre is inside a boundary."""
    return sp.within(anchors(spark, d), readers.polygon_edges(spark, HOLED), x="x", y="y").select("hx", "hy", "tot")


COARSE = f"WITH {PX}, {hexed_sql(240.0, 1)}, far AS (SELECT hx, hy, {centre_sql(240.0, 1)[0]} AS ax, {centre_sql(240.0, 1)[1]} AS ay FROM hexed GROUP BY ox, oy, hx, hy)"


@query(f"""WITH {PX}, e AS (SELECT min(X) AS x0, min(Y) AS y0, floor(greatest(max(X) - min(X), max(Y) - min(Y)) / 10) + 1 AS many FROM px),
d AS (SELECT min(range) AS depth FROM range(31), e WHERE 2 ** range >= many), c AS (SELECT CAST(floor((X - x0) / 10) AS BIGINT) AS cx, CAST(floor((Y - y0) / 10) AS BIGINT) AS cy FROM px, e),
n AS (SELECT range AS level, cx >> range AS qx, cy >> range AS qy, count(*) AS n FROM c, range(31), d WHERE range <= depth GROUP BY ALL)
SELECT CAST(n.level AS INT) AS level, n.qx, n.qy, n.n FROM n, d LEFT JOIN n u ON u.level = n.level + 1 AND u.qx = n.qx >> 1 AND u.qy = n.qy >> 1 WHERE (n.n <= 300 OR n.level = 0) AND (n.level = depth OR u.n > 300)""")
def adaptive_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Square tiles of at most 300 pixels, and their number."""
    p = px(spark, d)
    cells = quadtree.Cells.over(b.extent(p), 10.0)
    found = quadtree.leaves(p, cells, 300)
    return p.select(*cells.numbers(F.col("X"), F.col("Y"))).join(found, ["cx", "cy"]).groupBy(*quadtree.NODE).agg(F.count("*").alias("n"))


@query(COARSE + ", c AS (SELECT DISTINCT X, Y FROM px), k AS (SELECT X, Y, hx, hy, row_number() OVER (PARTITION BY X, Y ORDER BY sqrt((X - ax) * (X - ax) + (Y - ay) * (Y - ay)), hx, hy) AS rank FROM c, far) SELECT X, Y, hx, hy, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3")
def knn_any(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest of few far-off points for each place, found by a pyramid of counts."""
    p = px(spark, d)
    far = b.hex_units(p, 240.0, 1, min_ct=0).select("hx", "hy", "x", "y", F.struct("hx", "hy").alias("tie"))
    places = p.select("X", "Y").distinct().withColumn("key", F.struct("X", "Y"))
    return sp.nearest_any(places, far, 40.0, "key", "tie", 3).select("X", "Y", "hx", "hy", "rank")


@query("""WITH l AS (SELECT r_name AS lane, CAST(n_nationkey AS VARCHAR) AS tile, CAST(n_nationkey // 5 AS INT) AS row, CAST(n_nationkey % 5 AS INT) AS col FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT lane, tile, CAST(col * 10 AS DOUBLE) AS xmin, CAST(col * 10 + 7 + row AS DOUBLE) AS xmax, CAST(row * 20 AS DOUBLE) AS ymin, CAST(row * 20 + 15 + col AS DOUBLE) AS ymax FROM l WHERE row < 4)
SELECT lane, tile, row, col, xmin, xmax, ymin, ymax, max(ymax - ymin) OVER (PARTITION BY lane, row) AS row_height, max(xmax - xmin) OVER (PARTITION BY lane, col) AS col_width FROM l LEFT JOIN r USING (lane, tile)""")
def layout_map(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # noqa: E741
    l = l.select(F.col("r_name").alias("lane"), F.col("n_nationkey").cast("string").alias("tile"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("row"), (F.col("n_nationkey") % 5).cast("int").alias("col"))  # noqa: E741
    r, c = F.col("row"), F.col("col")
    ranges = l.filter(r < 4).select("lane", "tile", (c * 10).cast("double").alias("xmin"), (c * 10 + 7 + r).cast("double").alias("xmax"), (r * 20).cast("double").alias("ymin"), (r * 20 + 15 + c).cast("double").alias("ymax"))
    return readers.layout(l, ranges)


@query("SELECT coalesce(t, l_returnflag) AS category, count(*) AS n FROM lineitem LEFT JOIN (VALUES ('A', 'accepted'), ('R', 'returned')) m(f, t) ON l_returnflag = f GROUP BY 1")
def category_map(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([("A", "accepted"), ("R", "returned")], "`From` string, `To` string")
    return table(spark, d, "lineitem").join(F.broadcast(m), F.col("l_returnflag") == F.col("From"), "left").groupBy(F.coalesce("To", "l_returnflag").alias("category")).agg(F.count("*").alias("n"))


RAW = "raw AS (SELECT l_partkey % 200 AS x, l_suppkey % 100 AS y, CASE WHEN l_linenumber = 1 THEN 'NegPrb' || (l_partkey % 3) WHEN l_linenumber = 2 THEN 'Blank-1' ELSE 'g' || (l_partkey % 20) END AS gene, l_orderkey, l_quantity, l_returnflag FROM lineitem)"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    gene = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("NegPrb"), (F.col("l_partkey") % 3).cast("string"))).when(F.col("l_linenumber") == 2, F.lit("Blank-1")).otherwise(F.concat(F.lit("g"), (F.col("l_partkey") % 20).cast("string")))
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("x"), (F.col("l_suppkey") % 100).alias("y"), gene.alias("gene"), "l_orderkey", "l_quantity", "l_returnflag")


@query(f"WITH {RAW} SELECT x * 0.12::DOUBLE AS X, y * 0.12::DOUBLE AS Y, gene, CAST(count(*) AS INT) AS Count FROM raw WHERE NOT regexp_matches(gene, 'negprb|negative|systemcontrol|falsecode', 'i') GROUP BY raw.x, raw.y, gene")
def vendor_cosmx(spark: SparkSession, d: str) -> DataFrame:
    return readers.cosmx(_raw(spark, d).select(F.col("x").alias("x_global_px"), F.col("y").alias("y_global_px"), F.col("gene").alias("target")))


@query(f"WITH {RAW} SELECT gene, CAST(l_orderkey AS BIGINT) AS transcript_id, count(*) AS Count FROM raw WHERE NOT regexp_matches(gene, 'blank', 'i') GROUP BY gene, l_orderkey")
def vendor_vizgen(spark: SparkSession, d: str) -> DataFrame:
    m = readers.vizgen(_raw(spark, d).select(F.col("x").alias("global_x"), F.col("y").alias("global_y"), "gene", F.col("l_orderkey").alias("transcript_id")))
    return readers.feature_totals(m)


@query(f"WITH {RAW} SELECT CAST(x AS DOUBLE) AS X, CAST(y AS DOUBLE) AS Y, gene, l_returnflag AS cell_id, CAST(l_orderkey % 2 AS BIGINT) AS overlaps_nucleus, CAST(count(*) AS INT) AS Count FROM raw WHERE l_quantity > 13 AND NOT regexp_matches(gene, 'blank|negcontrol|antisense|unassigned|deprecated', 'i') GROUP BY raw.x, raw.y, gene, l_returnflag, l_orderkey % 2")
def vendor_xenium(spark: SparkSession, d: str) -> DataFrame:
    return readers.xenium(_raw(spark, d).select(F.col("x").alias("x_location"), F.col("y").alias("y_location"), F.col("gene").alias("feature_name"), F.col("l_quantity").alias("qv"), F.col("l_returnflag").alias("cell_id"), (F.col("l_orderkey") % 2).alias("overlaps_nucleus")))


@query("""WITH pos AS (SELECT CAST(s_suppkey AS VARCHAR) AS barcode, s_suppkey % 4 <> 0 AS tissue, s_suppkey % 10 AS r, s_suppkey // 10 AS c FROM supplier), bc AS (SELECT CAST(s_suppkey AS VARCHAR) AS barcode, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
m AS (SELECT l_partkey % 20 + 1 AS g, l_suppkey AS b, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY ALL) SELECT c * 2.0::DOUBLE AS X, r * 2.0::DOUBLE AS Y, 'g' || g AS gene, n AS Count FROM m JOIN bc ON m.b = bc.i JOIN pos USING (barcode) WHERE tissue""")
def vendor_visium(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey")
    pos = s.select(F.col("s_suppkey").cast("string").alias("barcode"), (F.col("s_suppkey") % 4 != 0).cast("int").alias("in_tissue"), (F.col("s_suppkey") % 10).alias("pxl_row_in_fullres"), F.floor(F.col("s_suppkey") / 10).alias("pxl_col_in_fullres"))
    bc = numbered(s, "barcode_idx", "s_suppkey").select(F.col("s_suppkey").cast("string").alias("barcode"), "barcode_idx")
    genes = spark.range(1, 21).select(F.col("id").alias("gene_idx"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene"))
    mtx = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 20 + 1).alias("gene_idx"), F.col("l_suppkey").alias("barcode_idx")).agg(F.count("*").cast("int").alias("Count"))
    return readers.visium(pos, bc, genes, mtx, 2.0)


# --- relational and scalar surface ---


@query("""WITH a AS (SELECT DISTINCT l_suppkey % 40 AS k FROM lineitem), b AS (SELECT DISTINCT p_partkey % 60 AS k FROM part WHERE p_partkey % 60 >= 20)
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS any_of,
(SELECT count(*) FROM a SEMI JOIN b USING (k)) AS semi, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS anti, (SELECT count(*) FROM a FULL JOIN b ON a.k = b.k) AS outer_n""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("k")).distinct()
    c = table(spark, d, "part").select((F.col("p_partkey") % 60).alias("k")).filter("k >= 20").distinct()
    parts = {"both": a.intersect(c), "only_a": a.subtract(c), "any_of": a.union(c).distinct(), "semi": a.join(c, "k", "left_semi"), "anti": a.join(c, "k", "left_anti"), "outer_n": a.join(c, "k", "full")}
    named = [x.select(F.lit(n).alias("name")) for n, x in parts.items()]
    every = named[0]
    for x in named[1:]:
        every = every.unionByName(x)
    return every.agg(*(F.count(F.when(F.col("name") == n, 1)).alias(n) for n in parts))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(median(l_extendedprice), 4) AS med, round(avg(l_quantity), 6) AS mean, min(l_tax) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY ALL")
def aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.percentile("l_extendedprice", 0.25), 4).alias("q25"), F.round(F.median("l_extendedprice"), 4).alias("med"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_tax").alias("lo"), F.max("l_discount").alias("hi"),
    )


@query("""SELECT DISTINCT l_returnflag, substr(l_returnflag || '_' || CAST(l_linenumber AS VARCHAR), 1, 2) AS prefix, right(lpad(CAST(l_linenumber AS VARCHAR), 5, '0'), 3) AS suffix, split_part('a,b,c', ',', 2) AS part, regexp_extract('factor_12', '(\\d+)$', 1) AS num,
replace(upper(l_linestatus), 'O', 'open') AS rep, printf('%.2f', CAST(l_linenumber AS DOUBLE) / 3) AS fmt, round_even(l_linenumber / 2.0::DOUBLE, 0) AS half_even, CAST(trunc(-l_linenumber / 2.0::DOUBLE) AS INT) AS truncated, least(greatest(l_linenumber, 2), 5) AS clipped, round(ln(l_linenumber + 1), 6) AS logged, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-l_linenumber::DOUBLE)), 6) AS squashed, coalesce(nullif(l_linenumber, 3), -1) AS filled FROM lineitem""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_returnflag", F.substring(F.concat("l_returnflag", F.lit("_"), n.cast("string")), 1, 2).alias("prefix"), F.right(F.lpad(n.cast("string"), 5, "0"), F.lit(3)).alias("suffix"), F.split(F.lit("a,b,c"), ",")[1].alias("part"), F.regexp_extract(F.lit("factor_12"), r"(\d+)$", 1).alias("num"),
        F.replace(F.upper("l_linestatus"), F.lit("O"), F.lit("open")).alias("rep"), F.format_string("%.2f", n.cast("double") / 3).alias("fmt"), F.rint(n / F.lit(2.0)).alias("half_even"), (-n / F.lit(2.0)).cast("int").alias("truncated"), filters.clipped(n, 2, 5).alias("clipped"), F.round(F.log(n + 1), 6).alias("logged"), F.round(special.expit(n.cast("double")), 6).alias("squashed"), F.coalesce(F.nullif(n, F.lit(3)), F.lit(-1)).alias("filled"),
    ).distinct()


@query("SELECT n_name, CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC) AS INT) AS least_rank, rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC) + (count(*) OVER (PARTITION BY n_regionkey, length(n_name)) - 1) / 2.0::DOUBLE AS mean_rank, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC, n_name) AS INT) AS place FROM nation")
def rank_ties(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").withColumn("len", F.length("n_name"))
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("len"))
    return t.select("n_name", F.rank().over(w).alias("least_rank"), markers.average_rank(F.col("len"), "n_regionkey").alias("mean_rank"), F.row_number().over(w.orderBy(F.desc("len"), "n_name")).alias("place"))


# --- models ---


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), "text")
    genes = [r.gene for r in matrix.features(matrix.word_totals(docs), 50).orderBy("idx").select("gene").collect()]
    return matrix.word_units(docs, genes, 20), genes


@query()
def lda_fit(spark: SparkSession, d: str) -> DataFrame:
    """A topic model of the documents' words: gene, factor, lambda."""
    units, genes = _units(spark, d)
    return Lda(genes, 6, seed=3).fit(units, 2, 2048).relabelled().matrix(spark)


@query()
def lda_transform(spark: SparkSession, d: str) -> DataFrame:
    """Factor probabilities of the documents by a given model, whose factors each prefer the words of one remainder by four."""
    units, genes = _units(spark, d)
    lam = np.where(np.arange(len(genes))[None, :] % 6 == np.arange(6)[:, None], 40.0, 10.0)
    return v.with_top(Lda(genes, 6, lam=lam).transform(units), 3)


def _model(spark: SparkSession, d: str) -> DataFrame:
    """A model whose factors each prefer the genes of one remainder by four."""
    g = px(spark, d).groupBy("gene").agg(F.sum("Count").cast("double").alias("n"))
    return g.select("gene", "n", F.explode(F.array(*map(F.lit, range(4)))).alias("factor")).select("gene", "factor", (F.col("n") * F.when(F.col("gene").cast("int") % 4 == F.col("factor"), 0.85).otherwise(0.05)).alias("lambda"))


@query()
def decode_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Factor probabilities of pixels from a model and anchors."""
    got = decode(b.truncated(px(spark, d), 0.1), _anchor_theta(spark, d).select("x", "y", "theta"), _model(spark, d), side=200, halo=50, r=25)
    return v.with_top(got, 3).drop("theta")


@query()
def density_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in dense regions by a mixture on hexagon counts."""
    return regions.filter_by_density(px(spark, d), radius=15)[0].select("X", "Y", "gene", "Count")


@query()
def choose_color(spark: SparkSession, d: str) -> DataFrame:
    """Colours for factors by their neighbourhood."""
    a = _anchor_theta(spark, d).withColumnRenamed("key", "unit")
    return spark.createDataFrame(factor_colours(a, 4, 24.0, 1), "Name string, Color_index int, R double, G double, B double")


# --- streams ---


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return streaming.source(spark, f"{d}/events.parquet", spark.read.parquet(f"{d}/events.parquet").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH px AS (SELECT value AS X, CAST(user_id AS DOUBLE) AS Y, 1 AS Count FROM events), {hexed_sql(24.0, 1)} SELECT ox, oy, hx, hy, CAST(sum(Count) AS BIGINT) AS tot FROM hexed GROUP BY ALL")
def stream_hexbin(spark: SparkSession, d: str) -> DataFrame:
    p = _stream(spark, d).select(F.col("value").alias("X"), F.col("user_id").cast("double").alias("Y"), F.lit(1).alias("Count"))
    return streaming.drained(streaming.hex_counts(p))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.drained(streaming.windowed(_stream(spark, d), "1 day"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
