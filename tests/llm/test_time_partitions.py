import calendar
import hashlib
import os
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.llm import time_partitions as x
from tessera.llm.common import scratch_path

CUT = datetime(2024, 4, 1)


def moment(click_id, ts):
    k = 99 if click_id is None else zlib.crc32(str(click_id).encode()) % 128
    if ts is None or 16 <= k <= 111:
        return ts
    return ts - timedelta(days=(k + 6) ** 3) if k < 16 else datetime.combine(ts.date() - timedelta(days=ts.weekday()), datetime.min.time())


def layout(rows, limit):
    """{(leaf, part): rows} of (moment, row) pairs, one node after the other."""
    leaves = {}

    def walk(parents, members):
        run = None
        for name, own in [*members, (None, None)]:
            fits = own is not None and len(own) <= limit
            if run and fits and len(run[2]) + len(own) <= limit:
                run = (run[0], name, run[2] + own)
                continue
            if run and run[2]:
                leaves["/".join([*parents, f"{run[0]}-{run[1]}"])] = run[2]
            run = (name, name, own) if fits else None
            if own is not None and not fits:
                if len(parents) == 3:
                    leaves["/".join([*parents, f"{name}-{name}"])] = own
                else:
                    walk([*parents, name], split([*parents, name], own))

    def split(parents, own):
        name, members = {0: ("year", None), 1: ("month", range(1, 13)), 3: ("hour", range(24))}.get(len(parents), ("day", None))
        if len(parents) == 2:
            members = range(1, calendar.monthrange(int(parents[0]), int(parents[1]))[1] + 1)
        found = defaultdict(list)
        for r in own:
            found[getattr(r[0], name)].append(r)
        members = members or range(min(found), max(found) + 1)
        return [(f"{m:0{4 if name == 'year' else 2}d}", found[m]) for m in members]

    timed = [r for r in rows if r[0] is not None]
    if timed:
        walk([], split([], timed))
    if len(timed) < len(rows):
        leaves["null"] = [r for r in rows if r[0] is None]
    first = lambda v: (v is not None, v)
    out = {}
    for leaf, own in leaves.items():
        own = sorted(own, key=lambda r: (first(r[0]), first(r[1]["arrived_at"]), first(r[1]["click_id"]), *map(first, r[1].values())))
        out |= {(leaf, i // limit + 1): [r for _, r in own[i : i + limit]] for i in range(0, len(own), limit)}
    return out


def brute(rows):
    limit, early = 1 + len(rows) // 800, lambda r: r["arrived_at"] is not None and r["arrived_at"] < CUT
    old, new = (layout([(moment(r["click_id"], r["ts"]), r) for r in part], limit) for part in ([r for r in rows if early(r)], rows))
    sha = lambda own: hashlib.sha256(",".join("" if r["click_id"] is None else str(r["click_id"]) for r in own).encode()).hexdigest()
    return {(leaf, part, sha(own), len(own), sum(not early(r) for r in own), old.get((leaf, part)) != own) for (leaf, part), own in new.items()}, set(new), old


def checked(spark, folder, rows):
    got = x.op12_time_partitions(spark, folder).collect()
    want, _, old = brute(rows)
    assert {(r.leaf, r.part, r.ids_sha256, r.n_rows, r.n_new, r.rewritten) for r in got} == want and len(got) == len(want)
    if got:
        top = got[0].path.removeprefix("file:").split(f"/{x.LEAF}=")[0]
        on_disk = {os.path.join(d, f) for d, _, files in os.walk(top) for f in files if f.endswith(".parquet")}
        assert on_disk == {r.path.removeprefix("file:") for r in got}
        assert {r.columns for r in got} == {",".join(rows[0])}
    return got


def test_like_the_definition(spark, sf):
    import duckdb

    rows = duckdb.sql(f"select * from '{sf}/clicks.parquet'").arrow().read_all().to_pylist()
    got = checked(spark, sf, rows)
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, `a.b` string, hour int, moment int"


@pytest.mark.parametrize("n", [0, 3, 2600])
def test_hot_hours_nulls_and_repeats(spark, tmp_path, n):
    """A third of the rows in one hour, null moments, ids and arrivals, repeated rows, clashing names, empty years between."""
    t = datetime(2024, 2, 5, 7)
    made = [(i if i % 17 else None, None if i % 11 == 0 else t if i % 3 == 0 else t + timedelta(hours=i % 700), None if i % 13 == 0 else t + timedelta(days=i % 80), "x" if i % 2 else None, i % 2, 0) for i in range(n)]
    made += made[: n // 10]
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(str(tmp_path / "clicks.parquet"))
    checked(spark, str(tmp_path), [dict(zip(("click_id", "ts", "arrived_at", "a.b", "hour", "moment"), r)) for r in made])


def test_runs():
    assert x.runs([0, 2, 0, 9, 0, 3, 3, 1], 5) == [(0, 2)] * 3 + [None, (4, 5), (4, 5), (6, 7), (6, 7)]
    assert x.runs([], 1) == [] and x.runs([5, 1, 4], 5) == [(0, 0), (1, 2), (1, 2)]


def test_a_second_rewrite_changes_nothing(spark):
    """Rows written again stay; rows that go take their files with them."""
    rows = spark.range(900).select(F.col("id").alias("k"), F.expr("timestamp_ntz'2023-12-31 20:00:00' + make_interval(0,0,0,0,int(id % 9))").alias("at"), F.lit(0.5).alias("v"))
    folder = scratch_path(spark, "again")
    first = x.rewrite(rows, folder, F.col("at"), ["k"], 90, standing=False)
    assert {r.rewritten for r in first.collect()} == {True}
    before = {r.path for r in x.files_of(spark, folder, rows.schema, "k", F.lit(False)).collect()}
    again = x.rewrite(rows, folder, F.col("at"), ["k"], 90).collect()
    assert len(again) == 18 and not any(r.rewritten for r in again) and before == {r.path for r in x.files_of(spark, folder, rows.schema, "k", F.lit(False)).collect()}
    few = rows.filter("k % 9 = 0")
    assert [tuple(r) for r in x.rewrite(few, folder, F.col("at"), ["k"], 100).collect()] == [("2023-2023", 1, True)]
    assert spark.read.parquet(folder).select("k", "at", "v").exceptAll(few).isEmpty() and spark.read.parquet(folder).count() == few.count()
