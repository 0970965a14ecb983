import edge
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as x


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        goal = {s: rest * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return goal | capped
        capped |= {s: most * sizes[s] for s in over}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("skew", [1, 30])
def test_targets_and_takes(spark, skew):
    rows = [(i, [None, "a", "b", "ä", "Z"][i % 5] if i % skew else "a", " ".join(["w"] * (1 + i * 7 % 90))) for i in range(2000)]
    df = frame(spark, rows)
    got = x.with_plan(x.sized(df), "source", x.stored(x.plan(x.stored(x.sized(df), "t")), "t")).toPandas()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s, part in got.groupby(got.source.fillna("\0null")):
        s = None if s == "\0null" else s
        taken = [(m.base + (h < m.threshold)) * n for m, h, n in zip(part["mix"], part.h, part["size"])]
        assert part["mix"].iloc[0].target == pytest.approx(want[s])
        assert abs(sum(taken) - want[s]) <= 90 and max(a / n for a, n in zip(taken, part["size"])) <= 2


def test_thresholds_are_nested(spark):
    df = frame(spark, [(i, "a", " ".join(["w"] * (1 + i % 13))) for i in range(600)])
    kept = [{r.doc_id for r in x.mix(df, [1], share).collect()} for share in (0.2, 0.5, 0.9)]
    assert kept[0] < kept[1] < kept[2] and kept[2] == {r.doc_id for r in x.mix(df, [1], 0.9).collect()}


def test_edge_rows(spark):
    docs = edge.documents(spark)
    out = x.mix(docs)
    assert out.columns == docs.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n.get(3, 0) % 2 == 0 and max(n.values()) <= 4 and set(n) <= {r.doc_id for r in docs.collect()}
    assert x.mix(edge.empty(spark)).count() == 0
    blank = frame(spark, [(1, "a", None), (2, "b", ""), (None, None, " ")])
    assert x.plan(x.stored(x.sized(blank), "t")).filter("target = 0").count() == 3
    one = frame(spark, [(5, "a", "w " * 50)])
    assert x.mix(one).count() in (1, 2)


def test_many_levels(spark):
    """Equal sizes and one source: the take is within one document of the target."""
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c d e").alias("text"))
    taken = x.mix(df, [1], 0.37).count() * 5
    assert abs(taken - 0.37 * 25_000) <= 5


def test_documents_without_an_id_reach_the_target(spark):
    rows = [(None if i % 3 else i, "ab"[i % 2], f"t{i} " * (1 + i * 7 % 90)) for i in range(1500)] + [(None, "c", f"c{i} " * (1 + i % 50)) for i in range(500)]
    out = x.mix(frame(spark, rows)).collect()
    sizes, taken = {}, {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken[s] - goal) <= 90 for s, goal in targets(sizes).items())
    assert x.mix(frame(spark, [(None, "a", "w " * 50)])).count() in (1, 2)


@pytest.mark.parametrize("buckets", [4, 4096])
@pytest.mark.parametrize("share", [0.3, 1.5, 2.5])
def test_level_of_many_sources(spark, monkeypatch, buckets, share):
    """Thousands of sources of very different sizes, by histograms of a few buckets: the same targets as one after the other."""
    monkeypatch.setattr(x, "BUCKETS", buckets)
    sizes = {f"s{i:05d}": (i * 7919) % 97 * (1 + (i % 50 == 0) * 10_000) for i in range(2000)} | {None: 10**7}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in x.targets(df, [3, 1, 2], share, 2.0).collect()}
    want = targets(sizes, share=share) if share < 2 else {s: 2.0 * n for s, n in sizes.items()}
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for s in got)
