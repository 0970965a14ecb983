from collections import Counter

import edge
import pytest

from tessera.llm import divergence as x


def brute(rows, min_docs=10, top=10):
    """By the definition: dictionaries and integers of any size."""
    counts, docs, groups = {}, {}, {}
    for t, lang, source in rows:
        lang, source = lang or "", source or ""
        got = [w.decode() for part in x.terms((t or "").encode()) for w in part]
        counts.setdefault((lang, source), Counter()).update(got)
        docs.setdefault(lang, Counter()).update(set(got))
        groups.setdefault(lang, set()).add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        every = sum((counts[lang, s] for s in sources), Counter())

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        ps, q = {s: p(counts[lang, s]) for s in sources}, p(every)
        for s in sources:
            pairs = [(-sum((ps[s][t] - ps[o][t]) ** 2 // (ps[s][t] + ps[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            above = [(-((ps[s][t] - q[t]) ** 2 // (ps[s][t] + q[t])), t.encode()) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(above)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.mark.parametrize("block", [2, 256])
def test_like_the_definition(spark, block):
    """Five sources, one without terms, one language without kept terms; ties of terms, and terms with equal vectors."""
    rows = [(f"Alpha beta{'  gamma' * (i % 4)} é{i % 3}ß x{i % 7}y T{'u' * (i % 5)}", "en", f"s{i % 4}") for i in range(80)]
    rows += [("same WORDS same words tie tied", "de", f"ä{i % 3}") for i in range(12)] + [("", "en", "void"), (None, "en", None), ("rare", "fr", "a"), (None, "fr", "b"), ("x", None, None)]
    got = x.audit(frame(spark, rows), block=block)
    assert {tuple(r) for r in got.collect()} == brute(rows) and len(brute(rows)) == got.count()


def test_terms_and_slices(monkeypatch):
    text = "Don't STOP ÄÉ naïve_x 12ab🙂c\x00z".encode()
    want = ["don", "t", "stop", "ÄÉ", "naïve", "x", "ab🙂c", "z"]
    for size in (1, 3, 100):
        monkeypatch.setattr(x, "SLICE", size)
        assert [w.decode() for part in x.terms(text) for w in part] == want


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**11, 3 * 10**11, 7)], "n long, total long, v long")
    assert df.select(x.share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (10**11 + 2) // (3 * 10**11 + 14)


def test_edge_rows(spark):
    rows = [tuple(r) for r in edge.documents(spark).select("text", "lang", "source").collect()]
    assert {tuple(r) for r in x.audit(edge.documents(spark), min_docs=2).collect()} == brute(rows, 2)
    assert x.audit(edge.empty(spark)).count() == 0
