"""Queries for single parts: readers and sinks there and back, inference by a given model, special functions, colours, matches."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import bins, models
from tessera.catalogue.adapters import PX, THETA, UNITS, anchors, anchors_sql, centre_sql, hexed_sql, labelled, px, rounded, table, theta0, unit_counts
from tessera.catalogue.models import DE, HOLED, MARK, PIXEL_TOP, RANKED, RING, _any_of, _inside_sql, _model, _pixel_top
from tessera.functions import colours, special
from tessera.functions import vectors as v
from tessera.functions.hexgrid import area_of, moves, radius_of
from tessera.operators import binning as b
from tessera.operators import filters, markers, matrix, rasters, regions, simulation
from tessera.operators import spatial as sp
from tessera.operators.decode import decode
from tessera.operators.lda import Lda
from tessera.schema import pixel_key, wide
from tessera.sources import readers, sinks

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            S[fn.__name__] = sql
        return fn

    return add


def _folder(spark: SparkSession, d: str, name: str) -> str:
    """Where a query puts what it reads again: the shared folder of checkpoints, or else the warehouse; written over by the next run."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tessera-catalogue/{os.path.basename(d.rstrip('/'))}/{name}"


# --- there and back ---


@query(f'WITH {PX} SELECT X, Y, gene, Count AS count, grp AS "group" FROM px')
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pixels through a compressed text table with a header that is normalised."""
    path = _folder(spark, d, "tsv")
    sinks.write_tsv(px(spark, d).toDF("x", "y", "gene", "Count", "Group"), path)
    return readers.tsv(spark, path, "x double, y double, gene string, Count int, Group string", mode="all")


@query(f"""WITH {PX}, {PIXEL_TOP} SELECT CAST(greatest(floor((X - 10) / 200::DOUBLE), 0) * 200 AS BIGINT) AS BLOCK, greatest(trunc((X - 10) * 100::DOUBLE), 0) / 100.0::DOUBLE + 10 AS X, greatest(trunc((Y - 20) * 100::DOUBLE), 0) / 100.0::DOUBLE + 20 AS Y, K1, K2, round(P1, 6) AS P1, round(P2, 6) AS P2
FROM pt WHERE greatest(trunc((X - 10) * 100::DOUBLE), 0) / 100.0::DOUBLE + 10 BETWEEN 250 AND 650 AND greatest(trunc((Y - 20) * 100::DOUBLE), 0) / 100.0::DOUBLE + 20 BETWEEN 100 AND 900""")
def block_scan(spark: SparkSession, d: str) -> DataFrame:
    """A box of block-indexed results, written and read again."""
    path = _folder(spark, d, "blocks")
    sinks.write_blocks(_pixel_top(spark, d), path, 4, 2, 200, 100, 10.0, 20.0)
    return rounded(readers.blocks(spark, path, (250.0, 650.0, 100.0, 900.0))[0])


@query(f"""WITH {PX}, {PIXEL_TOP} SELECT CAST(greatest(floor((X - 10) / 200::DOUBLE), 0) * 200 AS BIGINT) AS BLOCK, greatest(trunc((X - 10) * 100::DOUBLE), 0) / 100.0::DOUBLE + 10 AS X, greatest(trunc((Y - 20) * 100::DOUBLE), 0) / 100.0::DOUBLE + 20 AS Y, K1, K2, round(P1, 6) AS P1, round(P2, 6) AS P2
FROM pt WHERE greatest(trunc((X - 10) * 100::DOUBLE), 0) / 100.0::DOUBLE + 10 BETWEEN 250 AND 650 AND greatest(trunc((Y - 20) * 100::DOUBLE), 0) / 100.0::DOUBLE + 20 BETWEEN 100 AND 900""")
def block_scan_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same box from block-compressed files by their indexes: only the members that it needs are read."""
    path = _folder(spark, d, "blocks-indexed")
    sinks.write_blocks_indexed(_pixel_top(spark, d), path, 4, 2, 200, 100, 10.0, 20.0)
    return rounded(readers.blocks_indexed(spark, path, (250.0, 650.0, 100.0, 900.0))[0])


MODEL = f"""{PX}, gn AS (SELECT gene, sum(Count)::DOUBLE AS n FROM px GROUP BY gene), model AS (SELECT gene, CAST(k.range AS INT) AS factor, n * CASE WHEN CAST(gene AS INT) % 4 = k.range THEN 0.85::DOUBLE ELSE 0.05::DOUBLE END AS lam FROM gn, range(4) k)"""


@query(f'WITH {MODEL} SELECT gene, factor, round(greatest(lam, 100.0::DOUBLE), 6) AS "lambda" FROM model')
def model_scan(spark: SparkSession, d: str) -> DataFrame:
    """A model as a text table of genes by factor columns, its values floored."""
    path = _folder(spark, d, "model")
    by_gene = _model(spark, d).groupBy("gene").pivot("factor", list(range(4))).agg(F.first("lambda"))
    sinks.write_tsv(by_gene.toDF("gene", *(f"k_{i}" for i in range(4))), path, compress=False)
    return rounded(readers.model(spark, path, 100.0))


def _given(spark: SparkSession, d: str) -> Lda:
    """The model of ``decode_pixels`` over its genes by name."""
    rows = _model(spark, d).toPandas()  # as large as a model
    lam = rows.pivot_table(index="gene", columns="factor", values="lambda").sort_index()
    return Lda(list(lam.index), 4, lam=lam.to_numpy().T.copy())


@query(f'WITH {MODEL} SELECT gene, factor, round(lam, 6) AS "lambda" FROM model')
def model_saved(spark: SparkSession, d: str) -> DataFrame:
    """A model saved and loaded."""
    path = _folder(spark, d, "saved")
    _given(spark, d).save(spark, path)
    return rounded(Lda.load(spark, path).matrix(spark))


@query(f"WITH {THETA} SELECT (u.unit % 25) / 2.0::DOUBLE AS x, (u.unit // 25) / 2.0::DOUBLE AS y, CAST(k.range AS INT) AS factor, round(coalesce(p, 0.0::DOUBLE), 6) AS p FROM (SELECT DISTINCT unit FROM theta) u CROSS JOIN range(5) k LEFT JOIN theta t ON t.unit = u.unit AND t.factor = k.range")
def anchor_scan(spark: SparkSession, d: str) -> DataFrame:
    """Anchors through a text table with factor columns, in other units."""
    path = _folder(spark, d, "anchors")
    t = theta0(spark, d).select((F.col("unit") % 25).alias("X"), F.floor(F.col("unit") / 25).alias("Y"), "theta")
    sinks.write_tsv(wide(t, 5), path)
    return rounded(v.long(readers.anchors(spark, path, 2.0)).withColumn("factor", F.col("factor").cast("int")))


@query(f"SELECT CAST(gene_idx AS BIGINT) AS gene_idx, barcode_idx, CAST(n AS INT) AS Count FROM ({bins.S['sge_matrix']})")
def matrix_scan(spark: SparkSession, d: str) -> DataFrame:
    """A unit by gene table through the files of a sparse matrix."""
    path, p = _folder(spark, d, "matrix"), px(spark, d)
    sinks.write_matrix(b.centred(b.dge(p, 24.0, 1), 24.0, 1), p, path)
    return readers.matrix_market(spark, f"{path}/matrix")


@query(f"WITH {PX} SELECT X, Y, gene, Count FROM px WHERE {_any_of(HOLED)}")
def geojson_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pixels inside the polygons of a GeoJSON file, holes cut out."""
    path = _folder(spark, d, "boundary.geojson")
    parts = [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[*r, r[0]] for r in rings]}} for rings in HOLED]
    sinks.write_bytes(spark, path, json.dumps({"type": "FeatureCollection", "features": parts}).encode())
    return sp.within(px(spark, d), readers.polygon_edges(spark, readers.boundary(readers.text_of(spark, path)))).select("X", "Y", "gene", "Count")


@query(f"WITH {PX} SELECT X, Y, gene, Count FROM px WHERE {_inside_sql()}")
def svg_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pixels inside an SVG path with relative steps, drawn at half the size."""
    path, half = _folder(spark, d, "boundary.svg"), [(x / 2, y / 2) for x, y in RING]
    steps = " ".join(f"l {x1 - x0:g} {y1 - y0:g}" for (x0, y0), (x1, y1) in zip(half, half[1:]))
    sinks.write_bytes(spark, path, f"path\nm {half[0][0]:g},{half[0][1]:g} {steps} z\n".encode())
    shapes = [readers.scaled(r, 2.0) for r in readers.boundary(readers.text_of(spark, path))]
    return sp.within(px(spark, d), readers.polygon_edges(spark, shapes)).select("X", "Y", "gene", "Count")


@query(f"WITH {PX} SELECT X, Y, gene, Count FROM px WHERE X BETWEEN 250 AND 420 AND Y BETWEEN 100 AND 333")
def curve_scan(spark: SparkSession, d: str) -> DataFrame:
    """A box of pixels that were written along a space-filling curve: files outside of its ranges are left out by their footers."""
    path, p = _folder(spark, d, "curve"), px(spark, d).select("X", "Y", "gene", "Count")
    extent = b.extent(p)
    sinks.write_curve(p, path, 5.0, extent)
    return readers.curve(spark, path, (250.0, 420.0, 100.0, 333.0), 5.0, extent)


@query(f"WITH {PX} SELECT X, Y, gene, Count, grp FROM px WHERE (grp = 'A' AND Y BETWEEN 100 AND 300) OR (grp = 'N' AND Y BETWEEN 500 AND 900)")
def region_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.lane_regions(px(spark, d), [("A", 100.0, 300.0), ("N", 500.0, 900.0)], "grp")


@query(f"WITH {PX} SELECT X, Y, CAST(gene AS INT) AS gn, Count AS gt, Count // 2 AS spl, Count - Count // 2 AS unspl, 0 AS ambig FROM px")
def solo_scan(spark: SparkSession, d: str) -> DataFrame:
    """Five counts out of one column."""
    n, half = F.col("Count"), F.floor(F.col("Count") / 2)
    return readers.solo(px(spark, d).select("X", "Y", F.concat_ws(",", "gene", n.cast("string"), half.cast("string"), (n - half).cast("string"), F.lit("0")).alias("counts")))


@query(f"WITH {PX} SELECT X, Y, gene, Count FROM px WHERE Count > 10 AND gene <> '3' AND X < Y")
def predicate_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.where(px(spark, d), "Count > 10 AND gene <> '3' AND X < Y").select("X", "Y", "gene", "Count")


# --- keys, order, lattices ---


@query(f"WITH {PX} SELECT X, Y, count(*) AS n, CAST(sum(Count) AS BIGINT) AS total FROM px GROUP BY X, Y")
def pixel_keys(spark: SparkSession, d: str) -> DataFrame:
    return px(spark, d).groupBy(pixel_key().alias("key")).agg(F.count("*").alias("n"), F.sum("Count").alias("total")).select("key.X", "key.Y", "n", "total")


@query(f"WITH {PX}, p AS (SELECT X, Y, gene, CAST(sum(Count) AS BIGINT) AS total FROM px GROUP BY ALL) SELECT row_number() OVER (ORDER BY Y, X, gene) AS place, X, Y, gene, total FROM p")
def sorted_places(spark: SparkSession, d: str) -> DataFrame:
    """Pixels numbered in the order of several keys, sorted by ranges."""
    p = px(spark, d).groupBy("X", "Y", "gene").agg(F.sum("Count").alias("total"))
    return sinks.numbered(p, "place", "Y", "X", "gene").select("place", "X", "Y", "gene", "total")


FEW = moves(7, 12.0)


@query(f"WITH {PX}, {hexed_sql(12.0, FEW)} SELECT ox, oy, hx, hy, CAST(sum(Count) AS BIGINT) AS tot FROM hexed GROUP BY ALL HAVING sum(Count) >= 20")
def hexbin_moves(spark: SparkSession, d: str) -> DataFrame:
    """A narrow lattice with more moves than it can take."""
    return b.hex_units(px(spark, d), 12.0, 7).select("ox", "oy", "hx", "hy", F.col("tot").cast("long").alias("tot"))


_X, _Y = centre_sql(24.0, 2)


@query(f"""WITH {PX}, e AS (SELECT min(Y) AS lo, max(Y) AS hi FROM px), placed AS (SELECT px.*, CAST(least(greatest(floor((Y - lo) / ((hi - lo + 1) / 3.0::DOUBLE)), 0), 2) AS INT) AS win FROM px, e), {hexed_sql(24.0, 2, 'placed')},
u AS (SELECT win, ox, oy, hx, hy, {_X} AS x, {_Y} AS y FROM hexed GROUP BY win, ox, oy, hx, hy HAVING sum(Count) > {1.6 * area_of(24.0)!r}::DOUBLE), a AS (SELECT DISTINCT round_even(greatest(x, 0) / 4.0::DOUBLE, 0) * 4.0::DOUBLE AS x, round_even(greatest(y, 0) / 4.0::DOUBLE, 0) * 4.0::DOUBLE AS y FROM u)
SELECT px.X, px.Y, gene, Count FROM px WHERE EXISTS (SELECT 1 FROM a WHERE sqrt((px.X - a.x) * (px.X - a.x) + (px.Y - a.y) * (px.Y - a.y)) < {radius_of(24.0)!r}::DOUBLE AND abs(px.X - a.x) < 14)""")
def density_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Pixels near units above a given density, in windows, their centres on a coarse grid."""
    return regions.filter_by_anchors(px(spark, d), 24.0, 2, windows=3, precision=4.0, hard=1.6).select("X", "Y", "gene", "Count")


@query(f"""WITH {PX}, r AS (SELECT X, Y, min(CAST(gene AS INT) % 4) AS K1 FROM px GROUP BY X, Y), t AS (SELECT X + 0.25::DOUBLE AS tx, Y + 0.5::DOUBLE AS ty, 'c' || min(CAST(gene AS INT) % 3) AS cell_label, min(grp) AS cell_shape FROM px WHERE Count > 25 GROUP BY X, Y),
e AS (SELECT *, sqrt((X - tx) * (X - tx) + (Y - ty) * (Y - ty)) AS d FROM r JOIN t ON abs(X - tx) <= 2 AND abs(Y - ty) <= 2), k AS (SELECT *, row_number() OVER (PARTITION BY X, Y ORDER BY d, tx, ty) AS rn FROM e WHERE d < 2) SELECT X, Y, K1, cell_label, cell_shape FROM k WHERE rn = 1""")
def truth_match(spark: SparkSession, d: str) -> DataFrame:
    """Places with the label of the nearest true place within a tolerance."""
    p, g = px(spark, d), F.col("gene").cast("int")
    truth = p.filter("Count > 25").groupBy("X", "Y").agg(F.concat(F.lit("c"), F.min(g % 3).cast("string")).alias("cell_label"), F.min("grp").alias("cell_shape"))
    truth = truth.withColumns({"X": F.col("X") + F.lit(0.25), "Y": F.col("Y") + F.lit(0.5)})
    return simulation.matched(p.groupBy("X", "Y").agg(F.min(g % 4).alias("K1")), truth, 2.0)


# --- special functions, colours ---


def _psi(x: str) -> str:
    """Digamma of a positive SQL expression: eight steps up, then the asymptotic series."""
    z = f"({x} + 8.0::DOUBLE)"
    w = f"(1.0::DOUBLE / ({z} * {z}))"
    up = " + ".join(f"1.0::DOUBLE / ({x} + {i}.0::DOUBLE)" for i in range(8))
    return f"(ln({z}) - 0.5::DOUBLE / {z} - {w} * (1.0::DOUBLE / 12 - {w} * (1.0::DOUBLE / 120 - {w} * (1.0::DOUBLE / 252 - {w} * (1.0::DOUBLE / 240 - {w} * 1.0::DOUBLE / 132)))) - ({up}))"


@query(f"""WITH q AS (SELECT DISTINCT l_quantity::DOUBLE AS x FROM lineitem) SELECT x, round({_psi('x')}, 6) AS digamma, round({_psi('x')}, 6) AS digamma_udf, round(lgamma(x), 6) AS gammaln, round(1 / x * tanh(x / 2), 6) AS polya_gamma, round(ln(x / (51 - x)), 6) AS logit FROM q""")
def special_functions(spark: SparkSession, d: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = p["x"].to_numpy(float)
            yield p.assign(digamma=special.digamma(x), gammaln=special.gammaln(x), polya_gamma=special.polya_gamma_mean(2.0, x))

    q = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x")).distinct()
    out = q.mapInPandas(run, "x double, digamma double, gammaln double, polya_gamma double")
    return rounded(out.withColumns({"digamma_udf": special.digamma_of("x"), "logit": special.logit(F.col("x") / F.lit(51.0))}))


@query(f"""WITH {THETA}, f AS (SELECT u.unit, CAST(k.range AS INT) AS k, coalesce(p, 0.0::DOUBLE) / 2 AS p FROM (SELECT DISTINCT unit FROM theta) u CROSS JOIN range(5) k LEFT JOIN theta t ON t.unit = u.unit AND t.factor = k.range),
c AS (SELECT unit, k, p, coalesce(product(1 - p) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0::DOUBLE) AS l FROM f)
SELECT unit, k, round(p * l, 6) AS p FROM c UNION ALL SELECT unit, 5, round(l * (1 - p), 6) FROM c WHERE k = 4""")
def stick_breaking(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities from fractions: the halves of units' mixtures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(theta=list(special.stick_breaking(np.stack(p["theta"].to_list()) / 2))) if len(p) else p

    t = theta0(spark, d).mapInPandas(run, "unit long, theta array<double>")
    return rounded(t.select("unit", F.posexplode("theta").alias("k", "p")))


_SHADES = 64


@query("WITH t AS (SELECT range AS i, 0.05::DOUBLE + 0.95::DOUBLE * range / " + f"{_SHADES - 1}.0::DOUBLE AS t FROM range({_SHADES})) SELECT CAST(i AS VARCHAR) AS Name, i AS Color_index, " + ", ".join(
    f"round(least(greatest({' + '.join(f'({c!r}::DOUBLE) * pow(t, {j})' for j, c in enumerate(poly))}, 0), 1), 6) AS {name}" for name, poly in zip("RGB", colours.TURBO)) + " FROM t")
def colour_table(spark: SparkSession, d: str) -> DataFrame:
    """Colours of even places, stretched over the map."""
    return rounded(spark.createDataFrame(colours.table(np.arange(_SHADES) / 100 + 0.2), "Name string, Color_index long, R double, G double, B double"))


@query("""WITH c AS (SELECT * FROM (VALUES ('ASIA', 0.0, 0.2, 0.4), ('AFRICA', 1.0, 0.8, 0.6), ('FAR', 0.5, 0.25, 1.0)) c(Name, R, G, B)), n AS (SELECT n_name, r_name, CASE r_name WHEN 'EUROPE' THEN 'FAR' ELSE r_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_name, r_name, coalesce(R, 0.5)::DOUBLE AS R, coalesce(G, 0.5)::DOUBLE AS G, coalesce(B, 0.5)::DOUBLE AS B FROM n LEFT JOIN c ON n.label = c.Name""")
def label_colours(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the colours of a table, some renamed, some without one."""
    c = spark.createDataFrame([("ASIA", *colours.from_hex("#003366")), ("AFRICA", *colours.from_hex("fc9")[:1], 0.8, 0.6), ("FAR", 0.5, 0.25, 1.0)], "Name string, R double, G double, B double")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return rasters.with_colours(n, c, "r_name", {"EUROPE": "FAR"})


# --- tests and inference ---

#: exp(z * z) * sqrt(pi) / 2 * erfc(z) by Simpson's rule, z the root of half of ``x``; steps shrink with z.
_TAIL = """list_sum(list_transform(range(0, 2561), lambda i: (CASE WHEN i IN (0, 2560) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(i / 128.0::DOUBLE / (1 + sqrt({x} / 2)), 2) - 2 * sqrt({x} / 2) * (i / 128.0::DOUBLE) / (1 + sqrt({x} / 2))))) / 384.0::DOUBLE / (1 + sqrt({x} / 2))"""


@query(RANKED + f""", k AS (SELECT gene, factor, chi2, round(chi2, 1) AS c1, fold, gene_total, rank FROM r WHERE (chi2 > {models.CRITICAL!r}::DOUBLE AND fold > 1.5) OR rank < 10)
SELECT gene, factor, c1 AS chi2, round(fold, 2) AS fold, gene_total, rank, round(2 / sqrt(pi()) * exp(-chi2 / 2) * {_TAIL.format(x='chi2')}, 6) AS pval, round(c1 / 2 / ln(10) - log10(2 / sqrt(pi()) * {_TAIL.format(x='c1')}), 6) + 0.0::DOUBLE AS log10pval FROM k""")
def de_pvalues(spark: SparkSession, d: str) -> DataFrame:
    """The tests with p-values and logarithms of tails, rounded."""
    out = markers.with_pvalues(markers.ranked(markers.chi_square(labelled(spark, d))))
    return rounded(out).withColumn("log10pval", F.col("log10pval") + F.lit(0.0))


@query(DE.replace("WITH ", f"WITH {UNITS}, ", 1) + f""", {MARK}, qo AS (SELECT DISTINCT unit, gene FROM counts WHERE n > 0), qs AS (SELECT gene, count(*) AS c FROM qo GROUP BY gene), qt AS (SELECT count(DISTINCT unit) AS n FROM counts),
qp AS (SELECT a.factor, a.gene AS gi, b.gene AS gj FROM m a JOIN m b ON a.factor = b.factor AND a.gene < b.gene), qg AS (SELECT DISTINCT gi, gj FROM qp), qj AS (SELECT gi, gj, count(*) AS c FROM qg JOIN qo a ON a.gene = gi JOIN qo b ON b.gene = gj AND a.unit = b.unit GROUP BY gi, gj)
SELECT qp.factor, round(avg(ln((coalesce(qj.c, 0) + 1.0::DOUBLE) * (qt.n + 1.0::DOUBLE) / ((x.c + 1.0::DOUBLE) * (y.c + 1.0::DOUBLE)))), 6) AS pmi FROM qp LEFT JOIN qj USING (gi, gj) JOIN qs x ON x.gene = qp.gi JOIN qs y ON y.gene = qp.gj CROSS JOIN qt GROUP BY qp.factor""")
def pair_information(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of each factor's ten best markers."""
    tests = markers.chi_square(labelled(spark, d))
    best = tests.withColumn("_r", F.row_number().over(markers.Window.partitionBy("factor").orderBy(F.col("chi2").desc(), "gene"))).filter("_r <= 10")
    return rounded(markers.pair_information(unit_counts(spark, d), best.select(F.col("factor").cast("int").alias("factor"), "gene")))


#: The posterior of each unit by a given model: the same steps, a unit stopping by itself.
POSTERIOR = f"""WITH RECURSIVE {MODEL}, {UNITS}, lb AS (SELECT gene, list({_psi('lam')} - ps ORDER BY factor) AS lb FROM model JOIN (SELECT factor, {_psi('sum(lam)')} AS ps FROM model GROUP BY factor) USING (factor) GROUP BY gene),
u AS (SELECT unit, list(n::DOUBLE ORDER BY gene) AS cnt, list(lb ORDER BY gene) AS lbs, list(list_transform(lb, lambda x: exp(x)) ORDER BY gene) AS b FROM counts JOIN lb USING (gene) GROUP BY unit HAVING sum(n) >= 20),
steps AS (SELECT unit, cnt, b, [1.0, 1.0, 1.0, 1.0]::DOUBLE[] AS gamma, 1e9::DOUBLE AS change, 0 AS it FROM u UNION ALL
SELECT unit, cnt, b, new, list_sum(list_transform([1, 2, 3, 4], lambda k: abs(new[k] - gamma[k]))) / 4, it + 1 FROM (SELECT *, list_transform([1, 2, 3, 4], lambda k: 0.25::DOUBLE + theta[k] * list_dot_product(share, list_transform(b, lambda x: x[k]))) AS new
FROM (SELECT *, list_transform(range(1, len(cnt) + 1), lambda j: cnt[j] / (list_dot_product(theta, b[j]) + 1e-100)) AS share FROM (SELECT *, list_transform(gamma, lambda g: exp({_psi('g')} - es)) AS theta
FROM (SELECT *, {_psi('list_sum(gamma)')} AS es FROM steps WHERE change >= 1e-3 AND it < 100))))),
post AS (SELECT unit, gamma, list_sum(gamma) AS total FROM steps QUALIFY row_number() OVER (PARTITION BY unit ORDER BY it DESC) = 1)"""


def _given_units(spark: SparkSession, d: str, model: Lda) -> DataFrame:
    index = spark.createDataFrame([(g, i) for i, g in enumerate(model.genes)], "gene string, idx int")
    return matrix.units(unit_counts(spark, d), index, 20)


@query(POSTERIOR + " SELECT unit, CAST(k.range AS INT) AS factor, round(gamma[k.range + 1] / total, 6) AS p FROM post, range(4) k")
def lda_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Factor probabilities of units by a given model."""
    model = _given(spark, d)
    out = v.long(model.transform(_given_units(spark, d, model)))
    return rounded(out.withColumn("factor", F.col("factor").cast("int")))


@query(POSTERIOR + f""", lt AS (SELECT unit, gamma, total, list_transform(gamma, lambda g: {_psi('g')} - es) AS lt FROM (SELECT *, {_psi('total')} AS es FROM post)),
w AS (SELECT sum(list_sum(list_transform(range(1, len(cnt) + 1), lambda j: cnt[j] * ln(list_sum(list_transform([1, 2, 3, 4], lambda k: exp(lt[k] + lbs[j][k]))))))) AS s, sum(list_sum(cnt)) AS n FROM u JOIN lt USING (unit)),
x AS (SELECT sum(list_sum(list_transform([1, 2, 3, 4], lambda k: (0.25::DOUBLE - gamma[k]) * lt[k] + lgamma(gamma[k]) - lgamma(0.25::DOUBLE))) + lgamma(1.0::DOUBLE) - lgamma(total)) AS s FROM lt),
y AS (SELECT sum(a + lgamma(0.25::DOUBLE * m) - lgamma(t)) AS s FROM (SELECT factor, sum((0.25::DOUBLE - lam) * lb[factor + 1] + lgamma(lam) - lgamma(0.25::DOUBLE)) AS a, count(*) AS m, sum(lam) AS t FROM model JOIN lb USING (gene) GROUP BY factor))
SELECT round(w.s + x.s + y.s, 2) AS bound, round(exp(-(w.s + x.s + y.s) / n), 6) AS perplexity FROM w, x, y""")
def lda_bound(spark: SparkSession, d: str) -> DataFrame:
    """The variational bound and perplexity of units by a given model."""
    model = _given(spark, d)
    s, p = model.bound(_given_units(spark, d, model))
    return spark.createDataFrame([(round(s, 2), round(p, 6))], "bound double, perplexity double")


@query(f"""WITH {MODEL}, {anchors_sql()},
ps AS (SELECT factor, {_psi('sum(greatest(lam, 0.5::DOUBLE))')} AS ps FROM model GROUP BY factor), flo AS (SELECT gene, factor, greatest(lam, 0.5::DOUBLE) AS lam FROM model),
lb AS (SELECT gene, factor, {_psi('lam')} - ps AS lb FROM flo JOIN ps USING (factor)),
xb AS (SELECT X, Y, factor, sum(Count * lb) AS xb FROM px JOIN lb USING (gene) GROUP BY ALL),
raw AS (SELECT hx, hy, CAST(k.range AS INT) AS factor, (((hx * 7 + hy * 3 + k.range * 2) % 5 + 5) % 5 + 0.1)::DOUBLE AS t FROM anchors, range(4) k),
clipped AS (SELECT hx, hy, factor, least(greatest(t / sum(t) OVER (PARTITION BY hx, hy), 0.05::DOUBLE), 0.95::DOUBLE) AS t FROM raw), prior AS (SELECT hx, hy, factor, t / sum(t) OVER (PARTITION BY hx, hy) AS t FROM clipped),
lt AS (SELECT hx, hy, factor, {_psi('t')} - ({_psi('1.0::DOUBLE')}) AS lt FROM prior),
near AS (SELECT c.X, c.Y, hx, hy, sqrt((c.X - ax) * (c.X - ax) + (c.Y - ay) * (c.Y - ay)) AS d FROM (SELECT DISTINCT X, Y FROM px) c JOIN anchors ON c.X BETWEEN ax - 25 AND ax + 25 AND c.Y BETWEEN ay - 25 AND ay + 25),
w AS (SELECT X, Y, hx, hy, least(greatest(1 - pow(d / 25, {math.log(0.5) / math.log(0.7)!r}::DOUBLE), 0.05::DOUBLE), 0.95::DOUBLE) AS w FROM near WHERE d < 25),
z AS (SELECT X, Y, factor, s + xb AS z FROM (SELECT X, Y, factor, sum(w / total * lt) AS s FROM (SELECT *, sum(w) OVER (PARTITION BY X, Y) AS total FROM w) JOIN lt USING (hx, hy) GROUP BY ALL) JOIN xb USING (X, Y, factor)),
e AS (SELECT X, Y, factor, exp(z - max(z) OVER (PARTITION BY X, Y)) AS e FROM z)
SELECT X, Y, factor, round(e / sum(e) OVER (PARTITION BY X, Y), 6) AS p FROM e""")
def decode_step(spark: SparkSession, d: str) -> DataFrame:
    """The first round of decoding with given anchors and a given model, in adaptive tiles: each pixel's factors."""
    t = F.array(*(F.pmod(F.col("hx") * 7 + F.col("hy") * 3 + 2 * k, F.lit(5)) + F.lit(0.1) for k in range(4)))
    a = anchors(spark, d).withColumn("t", t).select("x", "y", F.transform("t", lambda v: v / F.aggregate("t", F.lit(0.0), lambda s, u: s + u)).alias("theta"))
    got = decode(px(spark, d), a, _model(spark, d), halo=50, r=25, rounds=1, least=1, most=4000)
    return rounded(v.long(got).withColumn("factor", F.col("factor").cast("int")))
