import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.cli import main
from tessera.sources import bgzf, readers, sinks

BOX = (120.0, 180.0, 300.0, 420.0)


@pytest.fixture(scope="module")
def decoded(spark):
    rand = [(F.floor(F.rand(i) * 4000) / 4 + 5).alias(c) for i, c in enumerate("XY")]
    return spark.range(400_000).select(*rand, F.lit(1).alias("K1"), F.lit(2).alias("K2"), F.lit(0.75).alias("P1"), F.lit(0.25).alias("P2"))


@pytest.fixture(scope="module")
def written(spark, decoded, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bgzf") / "blocks")
    sinks.write_blocks_indexed(decoded, path, 4, 2, block=100, scale=100, off_x=5.0, off_y=5.0)
    return path


def places(df):
    return sorted((round(r.X, 2), round(r.Y, 2)) for r in df.select("X", "Y").collect())


@pytest.mark.parametrize("box", [BOX, (0.0, 30.0, 0.0, 30.0), (990.0, 2000.0, 0.0, 2000.0), (3000.0, 4000.0, 0.0, 9.0), (300.0, 300.0, 500.0, 500.0)])
def test_a_box_is_the_box(spark, decoded, written, box):
    want = decoded.filter(F.col("X").between(box[0], box[1]) & F.col("Y").between(box[2], box[3]))
    assert places(readers.blocks_indexed(spark, written, box)[0]) == places(want)


def test_bytes_follow_the_box(written):
    meta = readers.block_meta(bgzf.head(written))[0]
    size = lambda box: sum(s.size for s in bgzf.planned(written, readers.block_regions(meta, box)))
    whole = sum(os.path.getsize(f) for f in bgzf.files_of(written))
    small, half = size(BOX), size((0.0, 500.0, 0.0, 2000.0))
    assert small < 0.25 * whole and 0.4 * whole < half < 0.8 * whole and size((3000.0, 4000.0, 0.0, 9.0)) == 0


def test_whole_file_in_stretches_of_any_size(spark, decoded, written):
    for split in (1, 100_000, bgzf.SPLIT):
        rows = bgzf.lines(spark, written, split=split)
        assert rows.count() == decoded.count()
    assert len(bgzf.planned(written, split=1)) > len(bgzf.planned(written))
    assert readers.blocks_indexed(spark, written, where="K1 = 1")[0].count() == decoded.count()


def test_files_are_plain_gzip_and_rewritten(spark, decoded, written, tmp_path):
    with gzip.open(bgzf.files_of(written)[0], "rt") as f:
        assert f.readline().startswith("##K=4;TOPK=2")
    path = str(tmp_path / "again")
    for n in (500, 7):
        sinks.write_blocks_indexed(decoded.limit(n), path, 4, 2)
        assert bgzf.lines(spark, path).count() == n
    sinks.write_blocks_indexed(decoded.limit(0), path, 4, 2)
    assert bgzf.lines(spark, path).count() == 0


def test_index_as_other_tools_write_it(tmp_path):
    """Positions from 1, wide bins on every level, a bin of totals, and an offset that lies behind."""
    bins = {0: [(0, 10 << 16)], 1: [(10 << 16, 20 << 16)], 4681: [(20 << 16, 30 << 16)], 4682: [(30 << 16, 40 << 16)], 37450: [(0, 99)]}
    index = bgzf.Index(0, (1, 4, 5), 0, {"A": bins}, {"A": [0, 30 << 16]})
    data = index.packed()
    with open(tmp_path / "x.gz.tbi", "wb") as f:
        f.write(data)
    got = bgzf.index_of(str(tmp_path / "x.gz"))
    assert got.columns == (1, 4, 5) and 37450 not in got.bins["A"]
    assert sorted(got.stretches("A", 1, 16384)) == [(0, 10 << 16), (10 << 16, 20 << 16), (20 << 16, 30 << 16)]
    assert got.stretches("A", 16385, 16385) == [(30 << 16, 40 << 16)]
    assert got.stretches("B", 1, 9) == [] and got.stretches("A", 5, 4) == []
    assert bgzf.merged([(0, 5 << 16), (5 << 16, 9 << 16), (3 << 16, 7 << 16), (20 << 16, 21 << 16)]) == [(0, 9 << 16), (20 << 16, 21 << 16)]


def test_minibatches_of_regions(spark, tmp_path):
    """A table by lane: the verb reads the regions that are asked for, in its own units or in micrometres."""
    rng = random.Random(4)
    rows = [("AB"[i % 2], i % 4, rng.randrange(4000), rng.randrange(100_000), f"g{i % 5}", 1 + i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "lane string, tile int, X int, Y int, gene string, Count int")
    df = df.withColumn("value", F.concat_ws("\t", *df.columns))
    bgzf.write(df, str(tmp_path / "in"), "lane", "Y", "value", "#lane\ttile\tX\tY\tgene\tCount\n", (1, 4))
    got = readers.pixels_indexed(spark, str(tmp_path / "in"), [("A", 1000, 30_000), ("B", 99_000, 1e6)])
    want = [r for r in rows if (r[0] == "A" and 1000 <= r[3] <= 30_000) or (r[0] == "B" and r[3] >= 99_000)]
    assert sorted((r.lane, r.X, r.Y, r.gene, r.Count) for r in got.collect()) == sorted((r[0], float(r[2]), float(r[3]), r[4], r[5]) for r in want)
    main(["make_spatial_minibatch", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--region-um", "A:10-50", "--mu-scale", "10", "--min-pixel", "0"], spark)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("X", "Y", "gene").distinct().count() == len({(r[2], r[3], r[4]) for r in rows if r[0] == "A" and 100 <= r[3] <= 500})
