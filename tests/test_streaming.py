from pyspark.sql import functions as F

from tessera import streaming
from tessera.operators import binning, matrix
from tessera.operators.lda import Lda


def test_running_counts_equal_batch(spark, tmp_path):
    p = spark.createDataFrame([(float(i % 37), float(i % 29), f"g{i % 3}", 1) for i in range(500)], "X double, Y double, gene string, Count int")
    p.repartition(4).write.parquet(str(tmp_path / "px"))
    got = streaming.drained(streaming.hex_counts(streaming.source(spark, str(tmp_path / "px"), p.schema)))
    want = binning.hex_units(p, 24.0, 1, min_ct=0).select(*binning.HEX, "tot")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hexes = binning.hexed(streaming.source(spark, str(tmp_path / "px"), p.schema, maxFilesPerTrigger=1), 24.0)
    streaming.write_hex_counts(hexes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    again = spark.read.parquet(str(tmp_path / "out")).groupBy(*binning.HEX).agg(F.sum("tot").alias("tot"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_windows_and_sessions(spark, tmp_path):
    e = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id * 20 as int)) AS ts, id % 2 AS user_id, 'a' AS event_type, 1.0D AS value FROM range(12)")
    e.write.parquet(str(tmp_path / "e"))
    stream = lambda: streaming.source(spark, str(tmp_path / "e"), e.schema)
    assert streaming.drained(streaming.windowed(stream(), "1 hour")).agg(F.sum("n"), F.count("*")).first() == (12, 4)
    assert streaming.drained(streaming.windowed(stream(), "1 hour", "30 minutes")).agg(F.sum("n")).first()[0] == 24
    assert streaming.drained(streaming.sessions(stream(), "30 minutes")).agg(F.sum("n")).first()[0] == 12


def test_online_model(spark, tmp_path):
    c = spark.createDataFrame([(u, f"g{(u % 2) * 3 + i % 3}", 1.0 + i) for u in range(40) for i in range(6)], "unit long, gene string, n double")
    c.repartition(3).write.parquet(str(tmp_path / "c"))
    index = matrix.features(c, 1).persist()
    model = Lda([r.gene for r in index.orderBy("idx").collect()], 2)
    first = model.lam.copy()
    streaming.online_model(streaming.source(spark, str(tmp_path / "c"), c.schema), model, lambda b: matrix.units(b, index, 1), 40)
    assert model.step >= 1 and (model.lam != first).any()
