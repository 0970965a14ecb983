"""Queries: hexagonal bins, tiles, collapses, features, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue.adapters import PX, anchors, anchors_sql, centre_sql, hexed_sql, px, rounded, table, unit_counts
from tessera.functions.hexgrid import area_of, radius_of
from tessera.operators import binning as b
from tessera.operators import filters as f
from tessera.operators import matrix as m
from tessera.sources import sinks

X3, Y3 = centre_sql(24.0, 3)
Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            S[fn.__name__] = sql
        return fn

    return add


@query(f"WITH {PX}, {hexed_sql(24.0, 3)} SELECT ox, oy, hx, hy, CAST(sum(Count) AS BIGINT) AS tot, round({X3}, 6) AS x, round({Y3}, 6) AS y FROM hexed GROUP BY ox, oy, hx, hy HAVING sum(Count) >= 20")
def hexbin_units(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.hex_units(px(spark, d), 24.0, 3))


@query(f"""WITH {PX}, {hexed_sql(24.0, 3)}, g AS (SELECT ox, oy, hx, hy, gene, sum(Count) AS n FROM hexed GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY ox, oy, hx, hy) AS tot FROM g)
SELECT ox, oy, hx, hy, gene, CAST(n AS BIGINT) AS n, CAST(tot AS BIGINT) AS tot FROM t WHERE tot >= 20 AND n > 0""")
def hexbin_dge(spark: SparkSession, d: str) -> DataFrame:
    return b.dge(px(spark, d), 24.0, 3)


@query(f"""WITH {PX}, {hexed_sql(24.0, 2)}, g AS (SELECT grp, ox, oy, hx, hy, gene, sum(Count) AS n FROM hexed GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY grp, ox, oy, hx, hy) AS tot FROM g)
SELECT grp, ox, oy, hx, hy, gene, CAST(n AS BIGINT) AS n, CAST(tot AS BIGINT) AS tot FROM t WHERE tot >= 20 AND n > 0""")
def hexbin_group_within(spark: SparkSession, d: str) -> DataFrame:
    return b.dge(px(spark, d), 24.0, 2, groups=("grp",))


@query(f"WITH {PX}, {hexed_sql(24.0, 2)} SELECT ox, oy, hx, hy, CAST(sum(Count) AS BIGINT) AS tot FROM hexed GROUP BY ALL HAVING sum(Count) >= greatest(20, {0.2 * area_of(24.0)!r}::DOUBLE)")
def hexbin_density_floor(spark: SparkSession, d: str) -> DataFrame:
    return b.hex_units(px(spark, d), 24.0, 2, density=0.2).drop("x", "y")


@query(f"""WITH {PX}, {hexed_sql(24.0, 2)}, e AS (SELECT min(X) AS lo, max(X) AS hi FROM px)
SELECT ox, oy, hx, hy, round(min(X), 6) AS least FROM hexed, e GROUP BY ox, oy, hx, hy, lo, hi HAVING min(X) > lo + 12 AND min(X) < hi - 12""")
def hexbin_edge_trim(spark: SparkSession, d: str) -> DataFrame:
    p = px(spark, d)
    return rounded(b.edge_trimmed(p, b.hexed(p, 24.0, 2), 24.0))


@query(f"""WITH {PX}, {hexed_sql(24.0, 3)}, e AS (SELECT min(X) AS lo, max(X) AS hi FROM px), u AS (SELECT ox, oy, hx, hy, sum(Count) AS tot, {X3} AS cx, {Y3} AS cy FROM hexed GROUP BY ox, oy, hx, hy HAVING sum(Count) >= 20)
SELECT ox, oy, hx, hy, CAST(tot AS BIGINT) AS tot, round(cx, 6) AS x, round(cy, 6) AS y FROM u, e WHERE cx > lo + {radius_of(24.0) * 3**0.5 / 2!r}::DOUBLE AND cx < hi - {radius_of(24.0) * 3**0.5 / 2!r}::DOUBLE""")
def hexbin_centre_trim(spark: SparkSession, d: str) -> DataFrame:
    p = px(spark, d)
    return rounded(b.centre_trimmed(b.hex_units(p, 24.0, 3), p, 24.0))


@query(f"WITH {PX}, {hexed_sql(24.0, 1)} SELECT ox, oy, hx, hy, CAST(sum(Count) AS BIGINT) AS tot, round(avg(X), 6) AS x, round(avg(Y), 6) AS y FROM hexed GROUP BY ox, oy, hx, hy HAVING sum(Count) >= 20")
def hex_centers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.hex_units(px(spark, d), 24.0, 1, centre="mean"))


@query(f"WITH {PX}, {hexed_sql(24.0, 1)} SELECT ox, oy, hx, hy, CAST(sum(Count) AS BIGINT) AS tot, round(median(X), 6) AS x, round(median(Y), 6) AS y FROM hexed GROUP BY ox, oy, hx, hy HAVING sum(Count) >= 20")
def hex_medians(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.hex_units(px(spark, d), 24.0, 1, centre="median"))


@query(f"WITH {PX}, {hexed_sql(24.0, 2)} SELECT grp, concat_ws('_', ox, oy, hx, hy) AS unit, CAST(sum(Count) AS BIGINT) AS tot FROM hexed GROUP BY grp, ox, oy, hx, hy HAVING sum(Count) >= 20")
def hex_region(spark: SparkSession, d: str) -> DataFrame:
    return b.hex_units(px(spark, d), 24.0, 2, groups=("grp",)).select("grp", b.unit_id().alias("unit"), "tot")


SGE = f"""WITH {PX}, {hexed_sql(24.0, 1)}, g AS (SELECT ox, oy, hx, hy, gene, sum(Count) AS n FROM hexed GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY ox, oy, hx, hy) AS tot FROM g),
k AS (SELECT * FROM t WHERE tot >= 20 AND n > 0), f AS (SELECT gene, row_number() OVER (ORDER BY gene) AS gene_idx FROM (SELECT DISTINCT gene FROM px)),
c AS (SELECT ox, oy, hx, hy, avg(X) AS x, avg(Y) AS y FROM hexed GROUP BY ALL),
u AS (SELECT DISTINCT ox, oy, hx, hy, tot FROM k), n AS (SELECT u.*, x, y, row_number() OVER (ORDER BY u.ox, u.oy, u.hx, u.hy) AS barcode_idx FROM u JOIN c USING (ox, oy, hx, hy))"""


def _sge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = px(spark, d)
    cells = b.hex_units(p, 24.0, 1, centre="mean").select(*b.HEX, "x", "y")
    return sinks.sparse_matrix(b.dge(p, 24.0, 1).join(cells, b.HEX), p)


@query(SGE + " SELECT gene, CAST(gene_idx AS INT) AS gene_idx FROM f")
def sge_features(spark: SparkSession, d: str) -> DataFrame:
    return _sge(spark, d)[0]


@query(SGE + " SELECT barcode_idx, ox, oy, hx, hy, round(x, 6) AS x, round(y, 6) AS y, CAST(tot AS BIGINT) AS tot FROM n")
def sge_barcodes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sge(spark, d)[1].select("barcode_idx", *b.HEX, "x", "y", "tot"))


@query(SGE + " SELECT CAST(gene_idx AS INT) AS gene_idx, barcode_idx, CAST(k.n AS BIGINT) AS n FROM k JOIN n USING (ox, oy, hx, hy) JOIN f USING (gene)")
def sge_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _sge(spark, d)[2]


SIDE, HALO = 200.0, 30.0
TILES = f"""WITH {PX}, e AS (SELECT min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM px),
c AS (SELECT *, greatest(1, CAST(ceil((x1 - {SIDE / 2} + 1 - x0) / {SIDE - HALO}) AS INT)) AS nx, greatest(1, CAST(ceil((y1 - {SIDE / 2} + 1 - y0) / {SIDE - HALO}) AS INT)) AS ny FROM e),
tx AS (SELECT CAST(i AS INT) AS tx, CASE WHEN i = 0 THEN x0 - 1 ELSE x0 + i * {SIDE - HALO} END AS lo, CASE WHEN i = nx - 1 THEN x1 ELSE x0 + i * {SIDE - HALO} + {SIDE} END AS hi FROM (SELECT *, unnest(range(nx)) AS i FROM c)),
ty AS (SELECT CAST(i AS INT) AS ty, CASE WHEN i = 0 THEN y0 - 1 ELSE y0 + i * {SIDE - HALO} END AS lo, CASE WHEN i = ny - 1 THEN y1 ELSE y0 + i * {SIDE - HALO} + {SIDE} END AS hi FROM (SELECT *, unnest(range(ny)) AS i FROM c)),
t AS (SELECT px.*, tx, ty FROM px JOIN tx ON X > tx.lo AND X <= tx.hi JOIN ty ON Y > ty.lo AND Y <= ty.hi)"""


@query(TILES + " SELECT X, Y, gene, Count, tx, ty FROM t")
def tile_assign(spark: SparkSession, d: str) -> DataFrame:
    return b.tiled(px(spark, d), SIDE, HALO).select("X", "Y", "gene", "Count", "tx", "ty")


@query(TILES + " SELECT tx, ty, count(*) AS n, CAST(sum(Count) AS BIGINT) AS total FROM t GROUP BY tx, ty")
def tile_counts(spark: SparkSession, d: str) -> DataFrame:
    return b.tiled(px(spark, d), SIDE, HALO).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.sum("Count").alias("total"))


@query(TILES + " SELECT tx, ty, count(*) AS n FROM t GROUP BY tx, ty HAVING count(*) >= 1500")
def tile_min_pixel(spark: SparkSession, d: str) -> DataFrame:
    return b.tiled(px(spark, d), SIDE, HALO, 1500).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query(f"WITH {PX} SELECT gene, trunc(X / 2.5::DOUBLE) * 2.5::DOUBLE AS X, trunc(Y / 2.5::DOUBLE) * 2.5::DOUBLE AS Y, CAST(sum(Count) AS BIGINT) AS Count FROM px GROUP BY 1, 2, 3")
def pixel_collapse_trunc(spark: SparkSession, d: str) -> DataFrame:
    return b.collapsed_truncating(px(spark, d), 2.5)


@query(f"WITH {PX} SELECT round_even(X / 2.0::DOUBLE, 0) * 2.0::DOUBLE AS X, round_even(Y / 2.0::DOUBLE, 0) * 2.0::DOUBLE AS Y, CAST(sum(Count) AS BIGINT) AS Count FROM px GROUP BY 1, 2")
def pixel_collapse_round(spark: SparkSession, d: str) -> DataFrame:
    return b.collapsed_rounding(px(spark, d), 2.0)


@query(f"WITH {PX} SELECT min(X) / 2.0::DOUBLE AS xmin, max(X) / 2.0::DOUBLE AS xmax, min(Y) / 2.0::DOUBLE AS ymin, max(Y) / 2.0::DOUBLE AS ymax FROM px")
def bbox_minmax(spark: SparkSession, d: str) -> DataFrame:
    return b.bounding_box(px(spark, d), 2.0)


@query(f"""WITH {PX} SELECT CAST(greatest(floor((X - 100) / 200::DOUBLE), 0) * 200 AS BIGINT) AS BLOCK, CAST(greatest(trunc((X - 100) * 100::DOUBLE), 0) AS BIGINT) AS X,
CAST(greatest(trunc((Y - 50) * 100::DOUBLE), 0) AS BIGINT) AS Y, gene, Count FROM px""")
def block_index(spark: SparkSession, d: str) -> DataFrame:
    return b.blocked(px(spark, d).drop("grp"), 200, 100, 100.0, 50.0).select("BLOCK", "X", "Y", "gene", "Count")


@query(f"WITH {PX} SELECT count(*) AS inclusive, count(*) FILTER (WHERE X > 100 AND X < 500 AND Y > 200 AND Y < 700) AS strict FROM px WHERE X >= 100 AND X <= 500 AND Y >= 200 AND Y <= 700")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    inner = f.in_box(px(spark, d), 100, 500, 200, 700)
    x, y = F.col("X"), F.col("Y")
    return inner.agg(F.count("*").alias("inclusive"), F.count(F.when((x > 100) & (x < 500) & (y > 200) & (y < 700), 1)).alias("strict"))


# --- features and matrices ---


@query(f"WITH {PX} SELECT gene, CAST(sum(Count) AS BIGINT) AS total FROM px GROUP BY gene")
def feature_totals(spark: SparkSession, d: str) -> DataFrame:
    return f.feature_totals(px(spark, d))


FLOOR = "(SELECT avg(total) FROM (SELECT sum(Count) AS total FROM px GROUP BY gene))"


@query(f"WITH {PX} SELECT gene, CAST(sum(Count) AS BIGINT) AS total FROM px GROUP BY gene HAVING sum(Count) >= {FLOOR} OR gene IN ('1', '2', '3', '99')")
def feature_whitelist(spark: SparkSession, d: str) -> DataFrame:
    p = px(spark, d)
    floor = f.feature_totals(p).agg(F.avg("total")).first()[0]
    return f.kept_features(p, floor, spark.createDataFrame([("1",), ("2",), ("3",), ("99",)], "gene string"))


@query(f"WITH {PX}, l AS (SELECT unnest(['7', '8', 'absent']) AS gene) SELECT l.gene, CAST(coalesce(sum(Count), 0) AS BIGINT) AS total FROM l LEFT JOIN px USING (gene) GROUP BY l.gene")
def feature_forced(spark: SparkSession, d: str) -> DataFrame:
    return f.forced_features(px(spark, d), spark.createDataFrame([("7",), ("8",), ("absent",)], "gene string"))


@query(f"WITH {PX} SELECT gene, CAST(sum(Count) AS BIGINT) AS total FROM px WHERE NOT regexp_matches(gene, '^1', 'i') AND Count > 0 AND gene IN (SELECT CAST(p_partkey % 40 AS VARCHAR) FROM part) GROUP BY gene")
def feature_filters(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "part").select((F.col("p_partkey") % 40).cast("string").alias("gene"))
    return f.feature_totals(f.with_features(f.positive(f.without(px(spark, d), "^1")), listed))


U = "counts AS (SELECT l_orderkey % 500 AS unit, CAST(l_partkey % 50 AS VARCHAR) AS gene, sum(l_quantity) AS n FROM lineitem GROUP BY ALL)"
UFLOOR = "(SELECT avg(s) FROM (SELECT sum(n) AS s FROM counts GROUP BY unit))"


@query(f"WITH {U} SELECT unit, count(*) AS genes, sum(n) AS tot FROM counts GROUP BY unit HAVING sum(n) >= {UFLOOR}")
def unit_floor(spark: SparkSession, d: str) -> DataFrame:
    c = unit_counts(spark, d)
    floor = c.groupBy("unit").agg(F.sum("n").alias("s")).agg(F.avg("s")).first()[0]
    return m.units(c, m.features(c, 1), floor).select("unit", F.size("idx").cast("long").alias("genes"), "tot")


@query(f"WITH {U}, f AS (SELECT gene, sum(n) AS total FROM counts GROUP BY gene HAVING sum(n) >= 50) SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INT) AS idx, total, round(total / sum(total) OVER (), 9) AS weight FROM f")
def feature_index(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.features(unit_counts(spark, d), 50), 9)


@query(f"WITH {PX}, {hexed_sql(24.0, 3)}, u AS (SELECT concat(ox, oy) AS epoch, sum(Count) AS tot FROM hexed GROUP BY ox, oy, hx, hy HAVING sum(Count) >= 20) SELECT epoch, count(*) AS units, CAST(sum(tot) AS BIGINT) AS total FROM u GROUP BY epoch")
def epoch_units(spark: SparkSession, d: str) -> DataFrame:
    u = b.hex_units(px(spark, d), 24.0, 3).withColumn("unit", F.concat(F.col("ox").cast("string"), F.col("oy").cast("string"), b.unit_id("hx", "hy")))
    return m.epochs(u).groupBy("epoch").agg(F.count("*").alias("units"), F.sum("tot").alias("total"))


@query(f"WITH {U} SELECT DISTINCT unit, CAST('0x' || substr(md5('7:' || CAST(unit AS VARCHAR)), 1, 12) AS BIGINT) % 1000000 < 500000 AS train FROM counts")
def unit_train_test(spark: SparkSession, d: str) -> DataFrame:
    return unit_counts(spark, d).select("unit").distinct().withColumn("train", f.train_test(F.col("unit"), 0.5, 7))


LOG = f"WITH {U}, s AS (SELECT unit, sum(n) AS s FROM counts GROUP BY unit), k AS (SELECT quantile_cont(s, 0.95) AS q, avg(s) AS mean FROM s)"


@query(LOG + " SELECT unit, gene, round(ln(n / s + 1.0::DOUBLE) / ln(1.0::DOUBLE / q + 1.0::DOUBLE), 6) AS x FROM counts JOIN s USING (unit), k")
def lognorm_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.log_normalised(unit_counts(spark, d)))


@query(LOG + " SELECT unit, gene, round(ln(n / (s / mean) + 1.0::DOUBLE), 6) AS x FROM counts JOIN s USING (unit), k")
def sizefactor_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.log_normalised(unit_counts(spark, d), size_factor=True))


@query(f"WITH {PX}, {anchors_sql()} SELECT hx, hy, round(ax, 6) AS x, round(ay, 6) AS y, CAST(tot AS BIGINT) AS tot FROM anchors")
def anchor_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anchors(spark, d))
