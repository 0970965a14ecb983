import gzip
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.cli import main, parser
from tessera.operators import binning as b
from tessera.plans.stages import Graph
from tessera.sources import readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tsv_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "p.tsv.gz", "wt") as f:
        f.write("x\ty\tgene\tCount\tmore\n1.5\t2\ta\t3\tz\n")
    p = readers.pixels(spark, str(tmp_path / "p.tsv.gz"), mu_scale=0.5)
    assert p.columns == ["X", "Y", "gene", "Count"] and p.first()[:2] == (3.0, 4.0)
    sinks.write_tsv(p, str(tmp_path / "out"), "%.2f")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).first()["X"] == "3.00"


def test_model_and_anchors(spark, tmp_path):
    m = readers.model(spark, write(tmp_path / "m.tsv", "gene\t0\t1\na\t0.1\t5\nb\t2\t0\n"), 0.5)
    assert sorted(map(tuple, m.collect())) == [("a", 0, 0.5), ("a", 1, 5.0), ("b", 0, 2.0), ("b", 1, 0.5)]
    a = readers.anchors(spark, write(tmp_path / "a.tsv", "X\tY\tk_1\tk_0\n2\t4\t0.25\t0.75\n"), 2)
    assert tuple(a.first()) == (1.0, 2.0, [0.75, 0.25])


def test_blocks_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(y), 1, 0, 0.75, 0.25) for x, y in np.round(rng.uniform(10, 500, (300, 2)), 2)]
    df = spark.createDataFrame(rows, "X double, Y double, K1 int, K2 int, P1 double, P2 double")
    sinks.write_blocks(df, str(tmp_path / "b"), 4, 2, block=100, scale=100, off_x=10.0, off_y=10.0)
    got, meta = readers.blocks(spark, str(tmp_path / "b"))
    assert meta["K"] == 4 and meta["SCALE"] == 100 and got.count() == 300
    back = sorted((r.X, r.Y) for r in got.collect())
    assert np.allclose(back, sorted((r[0], r[1]) for r in rows), atol=0.011)
    box = readers.blocks(spark, str(tmp_path / "b"), (100.0, 250.0, 50.0, 300.0))[0]
    assert abs(box.count() - sum(100 <= r[0] <= 250 and 50 <= r[1] <= 300 for r in rows)) <= 2
    sinks.block_table(df, str(tmp_path / "t"), block=100)
    assert spark.read.parquet(str(tmp_path / "t")).filter("BLOCK = 100").count() == sum(100 <= r[0] < 200 for r in rows)


def test_sparse_matrix_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(float(i % 40), float(i % 23), f"g{i % 4}", 1) for i in range(300)], "X double, Y double, gene string, Count int")
    cells = b.hex_units(p, 12.0, 1, min_ct=1, centre="mean").select(*b.HEX, "x", "y")
    dge = b.dge(p, 12.0, 1, min_ct=1).join(cells, b.HEX)
    for _ in range(2):  # the second time instead of the first
        sinks.write_matrix(dge, p, str(tmp_path / "m"))
    m = readers.matrix_market(spark, str(tmp_path / "m" / "matrix"))
    assert m.agg(F.sum("Count")).first()[0] == 300 and m.agg(F.max("gene_idx")).first()[0] == 4
    assert spark.read.text(str(tmp_path / "m" / "barcodes")).count() == m.agg(F.max("barcode_idx")).first()[0]


def test_numbered_lines(spark, tmp_path):
    path = write(tmp_path / "l.txt", "\n".join(f"line{i}" for i in range(500)))
    assert all(r.text == f"line{r.line - 1}" for r in readers.numbered_lines(spark, path).collect())


def test_geometry():
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)]
    assert readers.geojson(sinks.geojson([ring])) == [ring]
    assert readers.geojson(json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]})) == [[(0, 0), (1, 0), (1, 1)]]
    assert readers.svg_path("M 0,0 L 2,0 l 0 1 Z") == [ring]
    curve = readers.svg_path("M0 0 Q 1 2 2 0 C 3 -1 4 -1 5 0 z")[0]
    assert len(curve) == 17 and curve[4] == pytest.approx((1, 1))
    assert readers.scaled([ring], 2, 1, 0, True) == [[(0, 2), (0, 6), (2, 6)]]


def test_png_and_report(spark, tmp_path):
    image = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    data = sinks.png(image)
    at = data.index(b"IDAT") + 4
    rows = zlib.decompress(data[at : at + int.from_bytes(data[at - 8 : at - 4], "big")])
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and rows == b"".join(b"\0" + image[i].tobytes() for i in range(2))
    page = sinks.report([{"Factor": "<0>", "RGB": "255,255,255"}], tree=data)
    assert "&lt;0&gt;" in page and "color:#000" in page and "base64," in page
    assert sinks.gzipped(b"x") == sinks.gzipped(b"x")
    sinks.write_bytes(spark, str(tmp_path / "f.png"), data)
    assert (tmp_path / "f.png").read_bytes() == data


def test_solo_and_regions(spark):
    s = readers.solo(spark.createDataFrame([("b", "1,2,3,4,5")], "barcode string, counts string"))
    assert tuple(s.first()) == ("b", 1, 2, 3, 4, 5)
    r = spark.createDataFrame([("1", 5.0), ("1", 9.0), ("2", 5.0)], "lane string, Y double")
    assert readers.lane_regions(r, [("1", 5, 6)]).count() == 1


def test_stage_graph():
    done, ran, g = set(), [], Graph()
    g.add("a", ["in"], lambda: ran.append("a"))
    g.add("b", ["a"], lambda: ran.append("b"))
    g.add("c", ["a", "b"], lambda: ran.append("c"))
    with pytest.raises(ValueError):
        g.add("a", [], lambda: None)
    assert g.levels() == [["a"], ["b"], ["c"]] and g.describe().startswith("a: in")
    assert g.run(done=lambda t: t in done) == ["a", "b", "c"] == ran
    done |= {"a", "c"}
    assert g.run(done=lambda t: t in done) == ["b", "c"]
    loop = Graph()
    loop.add("x", ["y"], lambda: None)
    loop.add("y", ["x"], lambda: None)
    with pytest.raises(ValueError):
        loop.levels()


def test_whole_run(spark, tmp_path):
    from tessera.operators.simulation import tissue

    pixels, _, _ = tissue(spark, extent=80, genes=40, density=6)
    pixels.write.parquet(str(tmp_path / "p.parquet"))
    out = str(tmp_path / "out")
    main(["run_together", "--input", str(tmp_path / "p.parquet"), "--output", out, "--train-widths", "10", "--n-factors", "3", "--restarts", "1", "--epochs", "2"], spark)
    assert "<table>" in (tmp_path / "out" / "nF3.d_10" / "report.html").read_text()
    assert spark.read.parquet(f"{out}/nF3.d_10/pixels").count() > 1000
    decoded, colours, anchors = (f"{out}/nF3.d_10/{x}" for x in ("pixels", "colours", "anchors"))
    main(["plot_pixel_multi", "--input", decoded, "--output", f"{out}/multi.png", "--channels", "0:#ff0000,1:#00ff00"], spark)
    main(["plot_pixel_single", "--input", decoded, "--output", f"{out}/single", "--n-factor", "3", "--least", "1"], spark)
    main(["plot_base", "--input", anchors, "--output", f"{out}/base.png", "--colours", colours, "--um", "4", "--fill", "2"], spark)
    main(["plot_hexagon", "--input", anchors, "--output", f"{out}/hex.png", "--colours", colours, "--um", "2", "--width", "10"], spark)
    main(["block_index", "--input", decoded, "--output", f"{out}/blocks", "--n-factor", "3"], spark)
    assert all((tmp_path / "out" / f).read_bytes()[:4] == b"\x89PNG" for f in ("multi.png", "base.png", "hex.png", "single/factor_0.png"))
    assert readers.blocks(spark, f"{out}/blocks")[0].count() == spark.read.parquet(decoded).count()
    main(["make_dge", "--input", str(tmp_path / "p.parquet"), "--output", out + "/dge", "--hex-width", "10", "--min-ct", "5"], spark)
    assert spark.read.parquet(out + "/dge").count() > 0
    assert {a.dest for a in parser()._subparsers._group_actions[0].choices["slda_decode"]._actions} >= {"radius", "halflife", "share"}
