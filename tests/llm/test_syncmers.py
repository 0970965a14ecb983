import hashlib

import edge
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import syncmers as s


def brute(text, k, t):
    """Places of closed syncmers by definition, with the module's hash of an s-mer."""
    points = np.array([ord(c) for c in text], np.uint64)
    if len(points) < k:
        return []
    h = (s._rolled(points, None, t) >> np.uint64(32)).tolist()
    return [i for i in range(len(points) - k + 1) if min(h[i : i + k - t + 1]) in (h[i], h[i + k - t])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é\n", max_size=60), min_size=1, max_size=5), st.sampled_from([(5, 2), (8, 3), (15, 5), (4, 4)]))
def test_syncmers_by_definition(texts, kt):
    doc, at, _ = s.anchors(texts, *kt)
    assert [at[doc == i].tolist() for i in range(len(texts))] == [brute(t, *kt) for t in texts]


def test_context_free():
    passage = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(300))
    for a, b in (("", ""), ("xyz " * 9, "tail"), ("é🙂", "q" * 50)):
        _, at, h = s.anchors([a + passage + b])
        inner = {(int(p) - len(a), int(x)) for p, x in zip(at, h) if len(a) <= p <= len(a) + len(passage) - s.K}
        assert inner == {(int(p), int(x)) for p, x in zip(*s.anchors([passage])[1:])}
    gaps = np.diff(s.anchors([passage])[1])
    assert gaps.max() <= s.K - s.S + 1


def test_chunks_do_not_matter(monkeypatch):
    texts = ["some text to look at in pieces " * 5, "", "another one, with other words " * 4]
    want = [x.tolist() for x in s.anchors(texts)]
    monkeypatch.setattr(s, "CHUNK", 23)
    assert [x.tolist() for x in s.anchors(texts)] == want


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(0)
    a = "".join(map(chr, rng.integers(97, 123, 6000)))
    b = a[:4500] + "".join(map(chr, rng.integers(97, 123, 1500)))
    p, q = s.sketches([a, b])
    assert s.likeness(p, q) == pytest.approx(0.6, abs=0.15) and s.likeness(p, p) == 1
    none, short = s.sketches(["", "abc"])
    assert s.likeness(none, none) == 1 and s.likeness(none, p) == 0 and s.likeness(short, short) == 1 and len(short) == 1


def test_query_by_hand(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in s.op3_syncmers(spark, sf).collect()}
    assert len(got) == len(docs)
    for (i, x), (_, y) in zip(docs, docs[1:] + docs[:1]):
        edited = x[: len(x) - len(x) // 4] + y[: len(x) // 4]
        p, q, n = s.sketches([x]), s.sketches([edited]), s.sketches([y])
        assert got[i][1:] == (len(x), hashlib.sha256(edited.encode()).hexdigest(), s.as_text(p[0]), s.as_text(q[0]), s.likeness(p[0], q[0]), s.likeness(p[0], n[0]))


def test_edge_rows(spark):
    docs = edge.documents(spark)
    got = s.fingerprints(docs)
    assert got.count() == docs.count() and got.columns[-1] == "_fingerprint"
    same = got.filter("text = 'one line of more than twenty characters'").select("_fingerprint").distinct()
    assert same.count() == 1 and {r._fingerprint for r in got.filter("text is null or text = ''").collect()} == {""}
    rows = s.against_next(docs).collect()
    assert len(rows) == docs.count()
    one = s.against_next(edge.documents(spark, [(1, "just one document of some length")])).first()
    assert one.near_next == 1.0


def test_matches(spark):
    passage = "a passage that both of the texts have in common, of some length indeed; "
    a = spark.createDataFrame([(1, "intro " + passage)], "doc_id long, text string")
    b = spark.createDataFrame([(2, "something else " + passage), (3, "no such thing in here at all")], "doc_id long, text string")
    best = s.matches(a, b).orderBy("n", ascending=False).first()
    assert (best.left_id, best.right_id, best["shift"]) == (1, 2, 9) and best.n >= 3


def test_likeness_by_definition():
    """Against sets and a quadratic search for the longest chain, for texts with moved and repeated parts."""
    rng = np.random.default_rng(5)
    parts = ["".join(map(chr, rng.integers(97, 123, 400))) for _ in range(6)]
    texts = ["".join(parts[i] for i in order) for order in ((0, 1, 2, 3), (3, 2, 1, 0), (1, 0, 3, 2), (0, 0, 1), (4, 5), (0, 1, 4, 3), (2,))]
    prints = s.sketches(texts)
    for x, p in zip(texts, prints):
        first = {}
        for at, h in zip(*s.anchors([x])[1:]):
            first.setdefault(int(h), int(at))
        assert s.as_text(p) == "".join(f"{h:08x}{first[h]:08x}" for h in sorted(first)[: s.SIZE])
    for a in prints:
        for b in prints:
            x, y = ({int(v) >> 32: int(v) & 0xFFFFFFFF for v in p} for p in (a, b))
            both = sorted({*x, *y})[: s.SIZE]
            pairs = sorted((x[h], y[h]) for h in both if h in x and h in y)
            best = []
            for i, (_, v) in enumerate(pairs):
                best.append(1 + max((best[j] for j in range(i) if pairs[j][1] < v), default=0))
            assert s.likeness(a, b) == max(best, default=0) / len(both) == s.likeness(b, a)
    same, turned = s.likeness(prints[0], prints[0]), s.likeness(prints[0], prints[1])
    assert same == 1 and turned < 0.45  # the same four parts, but one of them in line at a time


@pytest.mark.parametrize("parts", [2, 8, 30])
def test_hot_ids_are_split(spark, parts):
    """A third of the rows without an id and a third with one id: every row once, in order, and no part with a third of them."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} of the table") for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = s.in_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("*", F.spark_partition_id().alias("at")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    mine = [r for r in got if not r.extra]
    assert sorted((r.doc_id is not None, r.doc_id, r.text) for r in mine if r.doc_id is not None) == sorted((True, i, t) for i, t in rows if i is not None) and len(mine) == 600
    sizes = np.bincount([r.part for r in mine])
    assert sizes.max() < 600 * 3 / parts
    by = {p: [r for r in got if r.part == p] for p in {r.part for r in mine}}
    for a, b in zip(sorted(by), [*sorted(by)[1:], min(by)]):
        assert (by[a][-1].extra, by[a][-1].text) == (True, by[b][0].text)
        assert len({r["at"] for r in by[a]}) == 1


def test_place_is_a_count(spark):
    bounds = s._bounds([3, 5, 5, 5, 9])
    rows = [(d, h) for d in (-(1 << 63), 2, 3, 5, 8, 9, 10) for h in (-(1 << 63), -1, 0, 1 << 62, (1 << 63) - 1)]
    got = spark.createDataFrame(rows, "d long, h long").select("d", "h", s._place(F.col("d"), F.col("h"), bounds).alias("p")).collect()
    assert [r.p for r in got] == [sum(b <= (r.d, r.h) for b in bounds) for r in got] and len(bounds) == 5


def test_copies_of_a_first_row_move_once(spark):
    """Half of all rows without an id and empty: each comes once, and each part has one successor."""
    rows = [(None if i % 2 else i, "" if i % 2 else f"text {i}") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = s.in_order(df).groupBy("part").agg(F.count_if(~F.col("extra")).alias("own"), F.count_if("extra").alias("more")).collect()
    assert sum(r.own for r in got) == 8000 and {r.more for r in got} == {1}
