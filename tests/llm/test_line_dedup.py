import re
from collections import defaultdict

import edge
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import line_dedup as d


def brute(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r, (_, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            holders[key(x)].add(r)
    order = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and order(i) < max(order(rows[r][0]) for r in holders[key(x)]))]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    return out


def result(df):
    return sorted(map(str, ((r.doc_id, r[-1].n_lines, r[-1].n_dropped, r[-1].kept) for r in df.collect())))


LINE = st.sampled_from(["a line of at least twenty characters", " A LINE of at least twenty characters\t", "short", "", "another line with enough characters", "ÄÖ a line of at least twenty characters"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.lists(LINE, max_size=4).map("\n".join))), min_size=1, max_size=12))
def test_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(d.deduplicated(df)) == sorted(map(str, brute(rows)))


def test_edge_rows(spark):
    docs = edge.documents(spark)
    out = d.deduplicated(docs)
    assert out.columns[-1] == "_lines" and result(out) == sorted(map(str, brute([(r.doc_id, r.text) for r in docs.collect()])))
    assert d.dedup_lines(docs).columns == docs.columns and d.dedup_lines(docs).count() == docs.count()
    assert d.dedup_lines(edge.empty(spark)).count() == 0


def test_runs(spark):
    runs = d.LineRuns(spark, fan_in=2)
    batch = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), F.lit(1).cast("long").alias("n_docs"), (F.lit(lo) + F.col("id")).alias("last_doc"))
    new = [runs.add(batch(a, b)).count() for a, b in ((0, 100), (50, 150), (120, 130), (0, 10), (0, 160))]
    assert new == [100, 50, 0, 0, 10]
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # five batches, compacted at two levels
    assert sum(x.count() for x in runs.runs()) == 160
    runs.close()
    runs = d.LineRuns(spark, fan_in=3)
    for a, b in ((0, 100), (50, 150), (120, 130), (0, 10)):
        runs.add(batch(a, b))
    twice = runs.frequent(2)
    assert twice.count() == 70 and runs.frequent(3).count() == 0
    assert twice.filter("h1 = 125").first().last_doc == 245 and runs.frequent(1).count() == 150
    runs.close()
    assert not spark.sql("SHOW TABLES").filter("tableName like 'tessera_run%'").count()
