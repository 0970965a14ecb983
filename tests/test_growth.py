"""Work that grows with the rows and not with their pairs: crowded tables, against brute force."""

import math
import os
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import binning as b
from tessera.operators import decode, simulation
from tessera.operators import spatial as sp


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_truth_of_crowded_places_without_pairs(spark):
    rng = np.random.default_rng(3)
    at = [(float(x), float(y), i) for i, (x, y) in enumerate(rng.integers(-90, 30, (900, 2)) / 8)]
    true = [(float(x) + 0.25, float(y) + 0.5, f"c{i}", "A") for i, (x, y) in enumerate({tuple(q) for q in (rng.integers(-40, 20, (1200, 2)) / 8).tolist()})]
    results, truth = spark.createDataFrame(at, "X double, Y double, K1 int"), spark.createDataFrame(true, "X double, Y double, cell_label string, cell_shape string")
    want = []
    for x, y, k in at:  # a place found twice has its label twice
        d, _, _, label = min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), a, b, c) for a, b, c, _ in true)
        if d < 2.0:
            want.append((x, y, k, label, "A"))
    for most in (sp.CROWD, 100):
        got = sp.nearest_one(results, truth.withColumnsRenamed({"X": "tx", "Y": "ty"}), 2.0, rx="tx", ry="ty", most=most).select("X", "Y", "K1", "cell_label", "cell_shape")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    df = simulation.matched(results, truth, 2.0)
    assert sorted(map(tuple, df.collect())) == sorted(want) and 0 < len(want) < len(at)
    assert "Window" not in _plan(df)  # which had all pairs within the tolerance
    assert simulation.matched(results.limit(0), truth).count() == simulation.matched(results, truth.limit(0)).count() == 0


def test_words_of_units_are_shuffled_once(spark, sf):
    from tessera.catalogue import models

    units, genes = models._units(spark, sf)
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") <= 1 and len(genes) > 0  # documents by unit, no pairs of unit and word


def test_units_are_held_in_pieces_of_batches(spark):
    from tessera.operators import lda

    name = "spark.sql.inMemoryColumnarStorage.batchSize"
    before = spark.conf.get(name)
    held = lda._by_batch(spark.range(0, 6400, 1, 2).withColumn("_b", F.col("id") % 32), 100)
    scan = held.filter("_b = 5")
    assert spark.conf.get(name) == before and {r.id % 32 for r in scan.collect()} == {5}
    assert held._jdf.queryExecution().withCachedData().cacheBuilder().serializer() is not None
    pieces = held._jdf.queryExecution().withCachedData().cacheBuilder().cachedColumnBuffers().count()
    assert pieces >= 64  # two partitions of 3200 rows: a step reads one piece of each
    held.unpersist()


def test_words_are_counted_in_tasks(spark, sf, monkeypatch):
    from tessera.catalogue import models
    from tessera.operators import matrix

    assert "Generate" not in _plan(models._units(spark, sf)[0])  # a row for each word of each text
    some = ["ab", "Ab", "x", "\u00c9t\u00e9", "\u0131K", "\u212a", "\u0130x", "don't", "b1c", "zz", "", "\n", "\u0391\u03a3"]
    rng = np.random.default_rng(8)
    of, texts = [None, 1, 1, 1, *range(2, 12)], []
    for i in range(400):
        texts.append((of[rng.integers(len(of))], None if i % 19 == 0 else " ".join(rng.choice(some, rng.integers(0, 12)))))
    docs = spark.createDataFrame(texts, "unit long, text string").repartition(5)
    rows = docs.select("unit", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("gene"), F.lit(1).cast("long").alias("n")).filter("gene <> ''")
    index, got = matrix.features(rows, 20), matrix.features(matrix.word_totals(docs), 20)
    by_name = lambda df: df.select("gene", "idx", "total").orderBy("idx").collect()
    assert by_name(index) == by_name(got) and index.dtypes == got.dtypes
    genes = [r.gene for r in by_name(got)]
    for size in (matrix.TEXTS, 3):
        monkeypatch.setattr(matrix, "TEXTS", size)
        for least in (1, 90):
            want, units = matrix.units(rows, index, least), matrix.word_units(docs, genes, least)
            assert want.dtypes == units.dtypes and sorted(map(str, want.collect())) == sorted(map(str, units.collect()))
    assert 0 < units.count() < matrix.word_units(docs, genes, 1).count() == len(set(of))
    assert matrix.word_units(docs, [], 1).count() == matrix.word_units(docs.limit(0), genes, 1).count() == matrix.word_totals(docs.limit(0)).count() == 0


def test_a_step_reads_the_files_of_its_batch_only(spark, monkeypatch):
    from tessera.operators import lda

    rng, m = np.random.default_rng(6), 5000
    rows = [(i, *zip(*((int(g), float(rng.integers(1, 9))) for g in sorted(rng.choice(m, 12, False))))) for i in range(300)]
    units = spark.createDataFrame(rows, "unit long, idx array<int>, cnt array<double>").repartition(3)
    first, read = lda.expected_all, []
    monkeypatch.setattr(lda, "expected_all", lambda models, batch: read.append(batch) or first(models, batch))
    scans = lambda: [re.findall(r"PartitionFilters: \[.*?(_b#\d+ = \d+)", x._jdf.queryExecution().simpleString()) for x in read]
    fitted = lambda: lda.Lda([f"g{i}" for i in range(m)], 3, seed=2).fit(units, 2, 60)
    want = fitted()
    assert not any(scans()) and want.step == 10
    read.clear()
    monkeypatch.setattr(lda, "HELD", 100)
    got = fitted()
    assert got.step == 10 and np.allclose(got.lam, want.lam, rtol=1e-9)
    filters = [x.split("=")[1] for [x] in scans()]
    assert len(filters) == 10 and len(set(filters)) == 5  # the folder of one batch a step
    base = spark.conf.get("spark.checkpoint.dir")
    assert read[0].inputFiles()[0].removeprefix("file://").startswith(base) and not [f for f in os.listdir(base) if f.startswith("tessera-units")]  # they go at the end
    table = got.matrix(spark)
    assert table.dtypes == [("gene", "string"), ("factor", "bigint"), ("lambda", "double")] and table.count() == 3 * m
    sums, n = first([want], units)
    beta, at = want.beta(), {r.unit: r for r in units.select("unit", F.xxhash64(F.lit(2), F.lit(10), "unit").alias("h")).collect()}
    each = [lda.infer(np.zeros(12, int), np.array(g), np.array(c), 1, beta, want.alpha, lda.starts(np.array([at[i].h]), 3))[1] for i, g, c in rows]
    assert n == 300 and np.allclose(sums[0], sum(each), atol=1e-9)


def test_neighbours_are_found_without_rows_of_pairs(spark):
    at = [(float(x), float(y)) for x, y in np.random.default_rng(4).integers(0, 40, (60, 2))]
    left = spark.createDataFrame([(*q, i) for i, q in enumerate(at)], "X double, Y double, key int")
    right = spark.createDataFrame([(*q, j) for j, q in enumerate(at[:30])], "x double, y double, tie int")
    for df, r in ((sp.nearest(left, right, 15.0, "key", "tie", 3), 15.0), (sp.nearest_any(left, right, 5.0, "key", "tie", 3), math.inf)):
        near = lambda q: sorted((math.dist(p, q), j) for j, p in enumerate(at[:30]))[:3]
        want = [(i, n + 1, j) for i, q in enumerate(at) for n, (d, j) in enumerate(near(q)) if d <= r]
        assert sorted((x.key, x["rank"], x.tie) for x in df.collect()) == sorted(want)
        assert "Window" not in _plan(df)  # which had all pairs in reach


def test_one_round_of_decoding_takes_each_place_once(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(y), str(g), int(n)) for x, y, g, n in zip(*rng.integers(0, 160, (2, 3000)), rng.integers(0, 4, 3000), rng.integers(1, 5, 3000))]
    at = [(float(x), float(y), [0.25 + x % 3 / 8, 0.75 - x % 3 / 8]) for x in range(0, 170, 15) for y in range(0, 170, 15)]
    lam = [[30.0, 5.0], [5.0, 30.0], [20.0, 20.0], [1.0, 9.0]]
    pixels, anchors = spark.createDataFrame(rows, "X double, Y double, gene string, Count int"), spark.createDataFrame(at, "x double, y double, theta array<double>")
    model = spark.createDataFrame([(str(g), k, v) for g, vs in enumerate(lam) for k, v in enumerate(vs)], "gene string, factor int, `lambda` double")
    places = sorted({r[:2] for r in rows})
    log_beta, log_theta = decode.expected_log(np.array(lam).T), decode.expected_log(decode.prior(np.array([t for *_, t in at])))
    want = []
    for p in places:
        d = np.array([math.dist(p, a[:2]) for a in at])
        w = np.where(d < 25, np.clip(1 - (d / 25) ** (math.log(0.5) / math.log(0.7)), 0.05, 0.95), 0)
        z = (w / w.sum()) @ log_theta + sum(n * log_beta[:, int(g)] for x, y, g, n in rows if (x, y) == p)
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    for most in (0, 100):
        got = {(r.X, r.Y): r.theta for r in decode.decode(pixels, anchors, model, side=60, halo=50, r=25, rounds=1, least=1, most=most).collect()}
        assert sorted(got) == places and np.allclose([got[p] for p in places], want, atol=1e-9)
    sizes = decode._tiles(pixels, anchors, model, lambda t: decode.pd.DataFrame({"n": [len(t.xy)]}), "n int", 60, 50, 25, 0.7, 0.2, 1, 1, 100, alone=True)
    assert sizes.agg(F.sum("n")).first()[0] == len(places)  # halos had most of them nine times, and genes rows of their own


def test_pixels_are_decoded_without_a_sum_by_gene_before(spark, sf, monkeypatch):
    from tessera.catalogue import models

    taken = []
    monkeypatch.setattr(models, "decode", lambda p, *more, **options: taken.append((p, more, options)) or decode.decode(p, *more, **options))
    got = {(r.X, r.Y): (r.K1, r.P1, r.P2, r.P3) for r in models.decode_pixels(spark, sf).collect()}
    [(p, more, options)] = taken
    assert "Aggregate" not in _plan(p)  # rows were summed by gene and place for the extent, and again for the places
    by_gene = b.collapsed_truncating(models.px(spark, sf), 0.1)
    want = {(r.X, r.Y): (r.K1, r.P1, r.P2, r.P3) for r in models.v.with_top(decode.decode(by_gene, *more, **options), 3).collect()}
    assert got.keys() == want.keys() and len(want) > 1000 and np.allclose([got[q] for q in want], list(want.values()), atol=1e-9)


def test_anchors_are_one_aggregation_without_a_filter_below(spark, sf):
    from tessera.catalogue import models

    a = models._anchor_theta(spark, sf)
    plan = _plan(a.filter(F.col("x").between(0.0, 500.0)))
    assert plan.count("Relation") == 1 and "Filter" not in plan.split("Window", 1)[1]  # cells were asked for nulls by their long expressions, row by row, on both sides of a join
    rows, units = a.collect(), {(r.hx, r.hy): (r.x, r.y) for r in models.anchors(spark, sf).collect()}
    assert len(rows) == len(units) > 0 and {tuple(r.key): (r.x, r.y) for r in rows} == units
    by = b.hexed(models.px(spark, sf), 24.0).groupBy("hx", "hy").agg(*(F.sum(F.when(F.col("gene").cast("int") % 4 == k, F.col("Count")).otherwise(0)).alias(f"n{k}") for k in range(4)))
    counts = {(r.hx, r.hy): np.array(r[2:], float) for r in by.collect()}
    assert all(np.allclose(r.theta, counts[tuple(r.key)] / counts[tuple(r.key)].sum()) for r in rows)


def test_inference_of_a_tile_by_hand_and_within_its_edges_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(9)
    xy, at = rng.uniform(0, 60, (90, 2)), rng.uniform(0, 60, (14, 2))
    px, ax, w = decode.edges(xy, at, 25)
    theta, xb = decode.prior(rng.dirichlet(np.ones(3), 14)), -rng.uniform(0, 9, (90, 3))
    mix = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    gamma, of = theta.copy(), [np.flatnonzero(px == i) for i in range(90)]
    psi, phi, trail = np.concatenate([w[[e]] / w[px == px[e]].sum() for e in range(len(px))]), np.zeros((90, 3)), []
    for _ in range(12):
        log_theta, new, bound = decode.expected_log(gamma), theta.copy(), 0.0
        for i, e in enumerate(of):
            phi[i] = mix(xb[i] + psi[e] @ log_theta[ax[e]])
            score = log_theta[ax[e]] @ phi[i] + np.log(w[e])
            psi[e] = mix(score)
            np.add.at(new, ax[e], psi[e][:, None] * phi[i])
            bound += psi[e] @ (score - np.log(psi[e])) + phi[i] @ (xb[i] - np.log(phi[i]))
        gamma = new
        trail.append(bound)
    for part in (8192, 7):
        monkeypatch.setattr(decode, "PART", part)
        got = decode.couple(px, ax, w, 90, theta, xb, 12, 0.0)
        assert all(np.allclose(g, v, atol=1e-10) for g, v in zip(got, (phi, gamma, psi, trail)))
    monkeypatch.undo()
    n, k = 60_000, 12
    px, ax = np.repeat(np.arange(n), 4), (np.arange(4 * n) * 7 % 101).astype(np.int64)
    tracemalloc.start()
    decode.couple(px, ax, rng.uniform(0.1, 0.9, 4 * n), n, decode.prior(rng.dirichlet(np.ones(k), 101)), -rng.uniform(0, 9, (n, k)), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * n * k * 8 * 2  # several arrays of all edges by all factors were held at once


def test_filters_on_centres_stay_above_the_aggregation(spark):
    p = spark.createDataFrame([(float(i % 97), float(i % 89), 1) for i in range(900)], "X double, Y double, Count int")
    u = b.hex_units(p, 12.0, 3, min_ct=2)
    kept = b.centre_trimmed(u, p, 12.0)
    plan = _plan(kept)
    assert "Aggregate" in plan and "Filter" not in plan.split("Aggregate", 1)[1]  # it was put below, for each pixel and offset
    margin = b.radius_of(12.0) * 3**0.5 / 2
    want = sorted(tuple(r) for r in u.collect() if 0.0 + margin < r.x < 96.0 - margin)
    assert sorted(map(tuple, kept.collect())) == want and 0 < len(want) < u.count()


def test_rows_meet_few_edges_without_a_shuffle(spark):
    from tessera.catalogue.models import HOLED
    from tessera.sources import readers

    at = [(float(x), float(y), i) for i, (x, y) in enumerate(np.random.default_rng(6).integers(-20, 1000, (2000, 2)))]
    at += [(*q[:2], i) for i, q in enumerate(at[:300])] + [(250.0, 250.0, -1), (50.0, 50.0, -2), (None, 1.0, -3)]
    p, e = spark.createDataFrame(at, "X double, Y double, id int"), readers.polygon_edges(spark, [*HOLED, [[(0.0, 0.0), (300.0, 0.0), (300.0, 300.0)]]])
    few, many = sp.within(p, e), sp.within(p, e, most=0)
    assert few.columns == p.columns and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 300
    left = few._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in left and "Exchange" not in left  # pixels were shuffled for their distinct places and for their own
    assert sp.within(p, e.limit(0)).count() == sp.within(p.limit(0), e).count() == 0


def test_a_block_is_sorted_by_several_tasks_as_numbers(spark, tmp_path):
    from tessera.sources import readers, sinks

    df = spark.range(4000).select((F.col("id") % 61 + 0.5).alias("X"), (F.col("id") % 997 / 4).alias("Y"), F.lit(1).alias("K1"), F.lit(2).alias("K2"), F.lit(0.75).alias("P1"), F.lit(0.25).alias("P2"))
    conf, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(conf, "false")
    try:
        sinks.write_blocks(df, str(tmp_path / "b"), 4, 2, block=1000)
    finally:
        spark.conf.set(conf, before)
    assert len(list((tmp_path / "b").glob("part-*.gz"))) > 1  # one block was one task and one file
    got, meta = readers.blocks(spark, str(tmp_path / "b"))
    assert meta["K"] == 4 and sorted((r.X, r.Y) for r in got.collect()) == sorted((r.X, r.Y) for r in df.collect())


def test_an_index_is_made_of_runs_and_not_of_rows(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyspark

    from tessera.sources import bgzf

    context = type("Context", (), {"partitionId": lambda self: 0, "taskAttemptId": lambda self: 0})
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: context()))
    rows = sorted((str(n), int(p), f"{n}\t{p}\t{i}") for i, (n, p) in enumerate(np.random.default_rng(8).integers(0, [3, 70_000], (9000, 2))))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 1000])], ["name", "pos", "value"]) for i in range(0, 9000, 1000)]
    seen, of = [], bgzf.Index.of
    monkeypatch.setattr(bgzf.Index, "of", classmethod(lambda cls, names, name, *more: seen.append(len(name)) or of(names, name, *more)))
    written = bgzf._Writer({"path": str(tmp_path), "head": "#h\n"}, True).write(iter(batches))
    assert seen == [15]  # names by windows of 2 ** 14; there was an entry of three lists for each row
    whole = of(["0", "1", "2"], *_virtual(bgzf, written.name, rows), (1, 2, 2))
    index = bgzf.index_of(written.name)
    assert index.bins == whole.bins and index.windows == whole.windows


def _virtual(bgzf, path, rows):
    """(number of the name, position, virtual start and end) of each line of a file, found by reading it."""
    with open(path, "rb") as f:
        members = list(bgzf.members(f, 0, 1 << 40))
    offsets, ends = np.array([at for at, _ in members]), 3 + np.cumsum([len(v) + 1 for *_, v in rows])
    place = lambda u: (offsets[u // bgzf.MEMBER] << 16) | (u % bgzf.MEMBER)
    return np.array([int(n) for n, *_ in rows]), np.array([p for _, p, _ in rows]), place(np.append(3, ends[:-1])), place(ends)
