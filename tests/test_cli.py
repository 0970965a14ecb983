"""Verbs with the options that choose what is kept and what is shown."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.cli import main
from tessera.operators import simulation
from tessera.operators.lda import Lda
from tessera.plans import workflow


@pytest.fixture(scope="module")
def here(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    pixels, _, _ = simulation.tissue(spark, extent=60, genes=30, density=5)
    pixels.withColumn("grp", F.when(F.col("X") < 30, "a").otherwise("b")).write.parquet(str(d / "p.parquet"))
    shapes = [[[[5, 5], [35, 5], [35, 35], [5, 35], [5, 5]], [[15, 15], [25, 15], [25, 25], [15, 25], [15, 15]]], [[[30, 30], [55, 30], [55, 55], [30, 55], [30, 30]]]]
    (d / "b.json").write_text(json.dumps({"type": "MultiPolygon", "coordinates": shapes}))
    inside = lambda x, y: (5 <= x < 35 and 5 <= y < 35 and not (15 <= x < 25 and 15 <= y < 25)) or (30 <= x < 55 and 30 <= y < 55)
    return d, inside


def test_boundaries(spark, here):
    d, inside = here
    p = spark.read.parquet(str(d / "p.parquet"))
    main(["filter_by_boundary", "--input", str(d / "p.parquet"), "--output", str(d / "in"), "--boundary", str(d / "b.json")], spark)
    got = spark.read.parquet(str(d / "in")).groupBy("X", "Y", "gene").count().collect()
    want = {(r.X, r.Y, r.gene): r["count"] for r in p.groupBy("X", "Y", "gene").count().collect() if inside(r.X, r.Y)}
    assert {(r.X, r.Y, r.gene): r["count"] for r in got} == want
    main(["make_dge", "--input", str(d / "p.parquet"), "--output", str(d / "dge"), "--hex-width", "8", "--min-ct", "2", "--n-move", "1", "--boundary", str(d / "b.json"), "--group-within", "grp"], spark)
    rows = spark.read.parquet(str(d / "dge")).collect()
    assert rows and all(inside(r.x, r.y) for r in rows) and {r.grp for r in rows} == {"a", "b"} and all(r.unit.startswith(r.grp) for r in rows)
    main(["make_sge_by_hexagon", "--input", str(d / "p.parquet"), "--output", str(d / "sge"), "--hex-width", "8", "--overlap", "0.5", "--boundary", str(d / "b.json")], spark)
    names = [r.value.split("_") for r in spark.read.text(str(d / "sge" / "barcodes")).collect()]
    assert names and all(inside(float(n[2]), float(n[3])) for n in names)


def test_models_and_images(spark, here):
    d, _ = here
    p = spark.read.parquet(str(d / "p.parquet"))
    counts = workflow.counts_of(p, 10.0, 2, 5).persist()
    for o in ({"norm": "log"}, {"norm": "size"}, {"by_epoch": True, "epochs": 2}):
        model, scores = workflow.fit(counts.select("unit", "gene", "n"), 3, {"restarts": 1, "epochs": 1, "min_ct_unit": 10, "min_ct_feature": 5} | o)
        assert model.lam.shape[0] == 3 and (np.diff(model.lam.sum(1)) <= 0).all() and scores.count() == 3
    half = [g for i, g in enumerate(sorted(model.genes)) if i % 2]
    bulk = model.matrix(spark).filter(F.col("gene").isin(half)).withColumn("lambda", F.col("lambda") + 60)
    start, theta, post = workflow.from_pseudobulk_counts(bulk, counts.select("unit", "gene", "n"), min_ct_feature=5, min_ct_unit=5, reorder=True)
    by = post.groupBy("factor").agg(F.sum("cnt").alias("c")).orderBy("factor").collect()
    assert sorted(start.genes) == half and post.select("gene").distinct().count() > len(half) and [r.c for r in by] == sorted((r.c for r in by), reverse=True)
    model.save(spark, str(d / "m"))
    main(["transform", "--input", str(d / "p.parquet"), "--output", str(d / "t"), "--model", str(d / "m"), "--hex-width", "10", "--n-move", "1", "--min-ct", "5"], spark)
    assert Lda.load(spark, str(d / "m")).k == 3
    anchors, colours = str(d / "t" / "anchors"), str(d / "c")
    main(["choose_color", "--input", anchors, "--output", colours, "--n-factor", "3", "--width", "10", "--circle", "--even"], spark)
    main(["plot_base", "--input", anchors, "--output", str(d / "base.png"), "--colours", colours, "--um", "5", "--top-image", "--by-factor", "--xmax", "40", "--origin", "lower", "--transpose"], spark)
    assert all((d / f).read_bytes()[:4] == b"\x89PNG" for f in ("base.png", "base.png.top.png", "base.png.factor_0.png"))
    spark.createDataFrame([("left", 1.0, 0.0, 0.0), ("b", 0.0, 1.0, 0.0)], "Name string, R double, G double, B double").write.parquet(str(d / "cc"))
    (d / "names.tsv").write_text("a\tleft\n")
    main(["plot_pixel_full", "--input", str(d / "p.parquet"), "--output", str(d / "cat.png"), "--colours", str(d / "cc"), "--um", "5", "--category", "grp", "--names", str(d / "names.tsv"), "--background", "#ffffff"], spark)
    assert (d / "cat.png").read_bytes()[:4] == b"\x89PNG"


def test_density_verbs(spark, here):
    d, _ = here
    main(["filter_by_density", "--input", str(d / "p.parquet"), "--output", str(d / "den"), "--radius", "5", "--outlines"], spark)
    rings = json.loads((d / "den" / "lenient.geojson").read_text())["features"][0]["geometry"]["coordinates"]
    assert rings and all(r[0][0] == r[0][-1] for r in rings)
    main(["filter_by_density_windows", "--input", str(d / "p.parquet"), "--output", str(d / "win"), "--width", "8", "--windows", "2"], spark)
    assert 0 < spark.read.parquet(str(d / "win")).count() <= spark.read.parquet(str(d / "p.parquet")).count()


def test_visium(spark, tmp_path):
    spark.createDataFrame([("bc1", 1, 3, 4), ("bc2", 0, 5, 6), ("bc3", 1, 7, 8)], "barcode string, in_tissue int, pxl_row_in_fullres int, pxl_col_in_fullres int").write.parquet(str(tmp_path / "pos.parquet"))
    (tmp_path / "bc.tsv").write_text("bc1\nbc2\nbc3\n")
    (tmp_path / "ft.tsv").write_text("id1\tg1\tx\nid2\tg2\tx\n")
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 3\n1 1 5\n2 2 7\n2 3 9\n")
    main(["format", "--platform", "visium", "--scale", "2", "--input", str(tmp_path / "m.mtx"), "--output", str(tmp_path / "o"), "--positions", str(tmp_path / "pos.parquet"), "--barcodes", str(tmp_path / "bc.tsv"), "--features", str(tmp_path / "ft.tsv")], spark)
    got = sorted((r.X, r.Y, r.gene, r.Count) for r in spark.read.parquet(str(tmp_path / "o" / "pixels")).collect())
    assert got == [(8.0, 6.0, "g1", 5), (16.0, 14.0, "g2", 9)]
