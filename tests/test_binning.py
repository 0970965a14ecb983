import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import hexgrid
from tessera.operators import binning as b
from tessera.operators import spatial as sp
from tessera.schema import factor_columns, normalised, theta, wide


def points(spark, n=400, seed=0, span=100.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(float(x), float(y), f"g{i % 5}", int(i % 3 + 1)) for i, (x, y) in enumerate(rng.uniform(-span, span, (n, 2)))], "X double, Y double, gene string, Count int")


def test_counts_are_kept_for_each_offset(spark):
    p = points(spark)
    total = p.agg(F.sum("Count")).first()[0]
    got = b.hex_units(p, 24.0, 3, min_ct=0).groupBy("ox", "oy").agg(F.sum("tot").alias("t")).collect()
    assert len(got) == 9 and {r.t for r in got} == {total}


def test_centre_is_nearest(spark):
    p = points(spark, 200)
    r = hexgrid.radius_of(24.0)
    u = b.hexed(p, 24.0, 2)
    x, y = hexgrid.hex_to_pixel(F.col("hx"), F.col("hy"), r, F.col("ox") / 2.0, F.col("oy") / 2.0)
    far = u.select(F.hypot(F.col("X") - x, F.col("Y") - y).alias("d")).agg(F.max("d")).first()[0]
    assert far <= r + 1e-9


def test_registered_functions(spark):
    hexgrid.register(spark)
    r = hexgrid.radius_of(24.0)
    p = points(spark, 100)
    p.createOrReplaceTempView("p100")
    got = {(x.X, x.Y): (x.q, x.r) for x in spark.sql(f"SELECT X, Y, hex_q(X, Y, {r}D, 0D, 0D) AS q, hex_r(X, Y, {r}D, 0D, 0D) AS r FROM p100").collect()}
    want = {(x.X, x.Y): (x.hx, x.hy) for x in b.hexed(p, 24.0).collect()}
    assert got == want
    assert spark.sql("SELECT * FROM hex_offsets(3)").count() == 9


@settings(max_examples=60, deadline=None)
@given(st.floats(-50, 50), st.floats(1, 900), st.floats(20, 200), st.floats(0, 0.45))
def test_tile_bounds_cover(lo, span, side, share):
    halo = side * share
    tiles = b.tile_bounds(lo, lo + span, side, side - halo)
    for v in np.linspace(lo, lo + span, 57):
        assert any(a < v <= z for a, z in tiles)


def test_tiles_match_bounds(spark):
    p = points(spark, 600)
    x0, x1, y0, y1 = b.extent(p)
    tx, ty = b.tile_bounds(x0, x1, 60.0, 45.0), b.tile_bounds(y0, y1, 60.0, 45.0)
    want = {(r.X, r.Y, i, j) for r in p.collect() for i, (a, z) in enumerate(tx) if a < r.X <= z for j, (c, d) in enumerate(ty) if c < r.Y <= d}
    t = b.tiled(p, 60.0, 15.0)
    assert {(r.X, r.Y, r.tx, r.ty) for r in t.collect()} == want
    own = t.filter((F.col("tx") == b.owner(F.col("X"), x0, x1, 60.0, 15.0)) & (F.col("ty") == b.owner(F.col("Y"), y0, y1, 60.0, 15.0)))
    assert own.count() == p.count() == own.select("X", "Y").distinct().count()


def test_empty(spark):
    p = points(spark).limit(0)
    assert b.hex_units(p).count() == 0 and b.dge(p).count() == 0 and b.tiled(p, 50, 10).count() == 0
    assert b.edge_trimmed(p, b.hexed(p, 24.0), 24.0).count() == 0


def test_moves():
    assert hexgrid.moves(3, 24) == 3 and hexgrid.moves(30, 24) == 6 and b.moves_for_overlap(0.5) == 2
    assert hexgrid.area_of(24) == pytest.approx(3 * math.sqrt(3) / 2 * hexgrid.radius_of(24) ** 2)


def test_radius_join_is_all_pairs(spark):
    p, q = points(spark, 150, 1), points(spark, 120, 2).select(F.col("X").alias("qx"), F.col("Y").alias("qy"), F.monotonically_increasing_id().alias("id"))
    got = {(r.X, r.Y, r.id) for r in sp.radius_join(p, q, 17.0, rx="qx", ry="qy").collect()}
    want = {(a.X, a.Y, c.id) for a in p.collect() for c in q.collect() if math.hypot(a.X - c.qx, a.Y - c.qy) <= 17}
    assert got == want
    near = {(r.X, r.Y) for r in sp.near_any(p, q, 17.0, rx="qx", ry="qy").collect()}
    assert near == {(x, y) for x, y, _ in want}


def test_polygons(spark):
    from tessera.sources import readers

    ring = [(-50.0, -60.0), (70.0, -40.0), (10.0, 80.0)]
    p = points(spark, 500).withColumn("_row", F.monotonically_increasing_id()).persist()
    a = {r._row for r in p.filter(sp.inside(F.col("X"), F.col("Y"), [ring])).collect()}
    c = {r._row for r in sp.within(p, readers.edges(spark, [ring]), 7.0).collect()}
    assert a == c and 0 < len(a) < 500


def test_schema(spark):
    df = spark.createDataFrame([(1.0, "a", 0.25, 0.75)], "x double, Gene string, Factor_10 double, Factor_2 double")
    assert normalised(df).columns == ["X", "gene", "factor_10", "factor_2"] and normalised(df, "xy").columns[0] == "X"
    assert factor_columns(df.columns) == {"2": "Factor_2", "10": "Factor_10"}
    assert theta(df).first().theta == [0.75, 0.25] and wide(theta(df), 2).columns[-2:] == ["0", "1"]
