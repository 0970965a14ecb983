import random
from collections import Counter, defaultdict

import edge
import pytest

from tessera.llm import jaccard_join as x


def brute(rows, k=4, percent=85):
    """(doc_id, n, component) by all overlaps, counted by an inverted list of n-grams that are no hashes."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    different, having, boss = list({s for s in sets if s}), defaultdict(list), {}

    def root(a):
        while boss.get(a, a) != a:
            a = boss[a]
        return a

    for i, s in enumerate(different):
        for j, n in Counter(j for g in s for j in having[g]).items():
            if 100 * n >= percent * (len(s) + len(different[j]) - n) and root(i) != root(j):
                boss[root(i)] = root(j)
        for g in s:
            having[g].append(i)
    at, least = {s: i for i, s in enumerate(different)}, {}
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            least[root(at[s])] = min(d, least.get(root(at[s]), d))
    return sorted(map(str, ((d, len(s), least.get(root(at[s])) if s else d) for (d, _), s in zip(rows, sets))))


def result(spark, rows, **limits):
    out = x.joined(spark.createDataFrame(rows, "doc_id long, text string"), **limits)
    return sorted(str(tuple(r)) for r in out.select("doc_id", "n_shingles", "component_id").collect())


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(str(tuple(r)) for r in x.op13_jaccard_join(spark, sf).collect())
    assert got == brute(rows)


def family(seed, base, copies, edits, tail=()):
    """Copies of some words with edits at random places, so that some copies link only through others and some not at all."""
    r = random.Random(seed)
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        yield " ".join([*w, *tail])


@pytest.mark.parametrize(("crowd", "tile"), [(32, 256), (4, 8), (2, 3)])
def test_crowded_blocks(spark, crowd, tile):
    """One great family, many that share a long passage, exact copies, and documents that are only the passage: by tiles of any size."""
    passage, texts = [f"p{i}" for i in range(120)], []
    texts += family(1, [f"a{i}" for i in range(100)], 160, 9)
    for f in range(25):
        texts += family(f + 2, [f"f{f}w{i}" for i in range(24)], 4, 1, passage)
    texts += [*family(90, passage, 40, 4), "only two", "only two", "ONLY\ttwo", "a b c d", "b c d a"]
    random.Random(5).shuffle(texts)
    rows = [(10_000 - i, t) for i, t in enumerate(texts)]
    want = brute(rows)
    assert result(spark, rows, crowd=crowd, tile=tile) == want
    assert 30 < len({r.split(",")[2] for r in want}) < len(rows)


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_at_the_limit(spark, percent):
    """Sets of every overlap around the limit, and of sizes at the limit."""
    rows = []
    for m in (7, 20, 57):
        for d in range(0, m, max(1, m // 12)):
            name = f"m{m}d{d}"
            rows += [(len(rows), " ".join(f"{name}x{i}" for i in range(m))), (len(rows) + 1, " ".join(f"{name}x{i}" for i in range(m - d))), (len(rows) + 2, " ".join([*(f"{name}x{i}" for i in range(m - d)), *(f"{name}y{i}" for i in range(d))]))]
    assert result(spark, rows, percent=percent) == brute(rows, percent=percent)


def test_edge_rows(spark):
    docs = edge.documents(spark).withColumnsRenamed({"n": "n_shingles", "h": "row", "d": "least"})
    out = x.joined(docs)
    assert out.columns == [*(c for c in docs.columns if c != "text"), "_n_shingles", "component_id"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(str((r.doc_id, r._n_shingles, r.component_id)) for r in out.collect()) == brute(rows)
    assert x.joined(edge.empty(spark)).count() == 0
    none = [(None, "a b c d e"), (None, "a b c d e"), (None, None), (3, None), (4, " ")]
    assert result(spark, none) == brute(none)
