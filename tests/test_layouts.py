"""Layouts, quantiles, stacked models, streams that stop in the middle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.operators import binning, lda, matrix
from tessera.sources import readers, sinks


@pytest.mark.parametrize("buckets", [3, 4096])
@pytest.mark.parametrize("kind", ["even", "skewed", "ties", "one"])
def test_quantiles(spark, monkeypatch, buckets, kind):
    monkeypatch.setattr(matrix, "BUCKETS", buckets)
    r = np.random.default_rng(1)
    v = {"even": r.uniform(-3, 9, 501), "skewed": np.append(np.exp(r.normal(0, 9, 300)), [0, -1e12]), "ties": r.integers(0, 3, 400).astype(float), "one": np.array([7.25])}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "s double")
    for q in (0, 0.5, 0.95, 1):
        assert matrix.quantile(df, "s", q) == pytest.approx(float(np.quantile(v, q)), rel=1e-12)
    assert matrix.quantile(df.limit(0), "s", 0.5) is None


def test_no_global_percentile(spark):
    c = spark.createDataFrame([(i // 3, f"g{i % 5}", 1.0 + i % 7) for i in range(300)], "unit long, gene string, n double")
    plan = matrix.log_normalised(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()


@pytest.mark.parametrize("cells", [(0, 0, 0, 0), (3, 9, 1, 4), (0, 1023, 512, 513), (1000, 1050, 7, 900)])
@pytest.mark.parametrize("most", [8, 64, 10_000])
def test_ranges_cover_the_cells(cells, most):
    ranges = binning.curve_ranges(cells, most)
    number = lambda x, y: sum(((x >> i & 1) << 2 * i + 1) | ((y >> i & 1) << 2 * i) for i in range(binning.CURVE_BITS))
    x, y = np.meshgrid(*(np.unique(np.linspace(a, b, 40).astype(int)) for a, b in (cells[:2], cells[2:])))
    assert all(any(lo <= number(a, b) <= hi for lo, hi in ranges) for a, b in zip(x.ravel().tolist(), y.ravel().tolist()))
    area = (cells[1] - cells[0] + 1) * (cells[3] - cells[2] + 1)
    assert len(ranges) <= most + 4 and (most < 10_000 or sum(hi - lo + 1 for lo, hi in ranges) == area)


def test_a_box_reads_few_files(spark, tmp_path):
    df = spark.range(200_000).select(*((F.rand(i) * 1000).alias(c) for i, c in enumerate("XY")), F.col("id").alias("gene"))
    df = df.persist()
    extent, path = (0.0, 1000.0, 0.0, 1000.0), str(tmp_path / "z")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        sinks.write_curve(df, path, 4.0, extent)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    box = (300.0, 400.0, 610.0, 700.0)
    got = readers.curve(spark, path, box, 4.0, extent)
    want = df.filter(F.col("X").between(300, 400) & F.col("Y").between(610, 700))
    assert sorted(r.gene for r in got.collect()) == sorted(r.gene for r in want.collect()) and got.columns == df.columns
    ranges = binning.curve_ranges((75, 100, 152, 175))
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("curve").alias("lo"), F.max("curve").alias("hi")).collect()
    met = sum(any(lo <= f.hi and f.lo <= hi for lo, hi in ranges) for f in files)
    assert len(files) > 50 and met <= 6 and "curve" in got._jdf.queryExecution().toString()
    outside = readers.curve(spark, path, (-50.0, -1.0, 0.0, 9.0), 4.0, extent)
    assert outside.count() == 0


def units(spark, n=60):
    r = np.random.default_rng(5)
    rows = [(u, [int(i) for i in range(5)], [float(x) for x in r.integers(0, 9, 5)]) for u in range(n)]
    return spark.createDataFrame(rows, "unit long, idx array<int>, cnt array<double>")


@pytest.mark.parametrize("width", [2, 2048])
def test_models_in_one_pass(spark, monkeypatch, width):
    """Sums of several models, by ranges of genes: those of each by itself."""
    monkeypatch.setattr(lda, "RANGE", width)
    genes, u = [f"g{i}" for i in range(5)], units(spark)
    models = [lda.Lda(genes, 3, seed=s) for s in range(3)]
    sums, n = lda.expected_all(models, u)
    assert n == 60 and sums.shape == (3, 3, 5)
    for m, s in zip(models, sums):
        assert np.allclose(m.expected(u)[0], s) and np.allclose(s.sum(), sum(sum(r.cnt) for r in u.collect()))
    alone = [lda.Lda(genes, 3, seed=s).fit(u, 2).lam for s in range(3)]
    lda.fit_all(models, u, 2)  # one batch, so that orders are equal
    assert all(np.allclose(m.lam, a) for m, a in zip(models, alone))


def test_steps_do_not_grow_with_units(spark, monkeypatch):
    monkeypatch.setattr(lda, "STEPS", 4)
    model = lda.Lda([f"g{i}" for i in range(5)], 2).fit(units(spark, 200), 1, batch_size=10)
    assert model.step == 4


def files_of(spark, folder, schema, rows, many):
    for i in range(many):
        spark.createDataFrame(rows[i::many], schema).coalesce(1).write.parquet(f"{folder}/f{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


class Stop(Exception):
    pass


def test_a_model_goes_on_after_a_stop(spark, tmp_path):
    rows = [(u, f"g{(u % 2) * 3 + i % 3}", 1.0 + (u * i) % 4) for u in range(80) for i in range(6)]
    schema = "unit long, gene string, n double"
    index = matrix.features(spark.createDataFrame(rows, schema), 1).persist()
    genes = [r.gene for r in index.orderBy("idx").collect()]
    stream = lambda name: files_of(spark, str(tmp_path / name), schema, rows, 5)
    prepare = lambda b: matrix.units(b, index, 1)
    whole = streaming.online_model(stream("a"), lda.Lda(genes, 2), prepare, 80, str(tmp_path / "ca"))
    again, seen = stream("b"), []

    def stops(batch):
        seen.append(1)
        if len(seen) == 3:
            raise Stop
        return prepare(batch)

    with pytest.raises(Exception, match="Stop"):
        streaming.online_model(again, lda.Lda(genes, 2), stops, 80, str(tmp_path / "cb"))
    got = streaming.online_model(again, lda.Lda(genes, 2), prepare, 80, str(tmp_path / "cb"))
    assert got.step == whole.step == 5 and np.allclose(got.lam, whole.lam)
    done = streaming.online_model(again, lda.Lda(genes, 2), prepare, 80, str(tmp_path / "cb"))  # nothing is left to read
    assert done.step == 5 and np.allclose(done.lam, whole.lam)


def test_totals_go_on_after_a_stop(spark, tmp_path, monkeypatch):
    rows = [(float(i % 37), float(i % 29), 1 + i % 2) for i in range(400)]
    schema = "X double, Y double, Count int"
    counts = streaming.hex_counts(files_of(spark, str(tmp_path / "in"), schema, rows, 4))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    from pyspark.sql import DataFrameWriter

    real, seen = DataFrameWriter.parquet, []

    def parquet(self, path, *a, **k):
        real(self, path, *a, **k)
        seen.append(path)
        if len(seen) == 2:  # the batch is written, and not yet committed
            raise Stop

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(Exception, match="Stop"):
        streaming.keep_totals(counts, out, check).awaitTermination()
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    streaming.keep_totals(counts, out, check).awaitTermination()
    want = binning.hex_units(spark.createDataFrame(rows, schema), 24.0, 1, min_ct=0).select(*binning.HEX, "tot")
    assert sorted(map(tuple, streaming.totals(spark, out).collect())) == sorted(map(tuple, want.collect()))
    assert streaming.merged_totals(spark, out, str(tmp_path / "one")).exceptAll(want).isEmpty()
