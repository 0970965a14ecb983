"""The queries that SQL can express, and all of them on tables without rows."""

import pytest

from tessera.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(name, same):
    same(q.queries()[name], q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(name, spark, sf, tmp_path):
    for t in ("documents", "pages", "conversations", "labels", "clicks"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = q.queries()[name](spark, str(tmp_path)).collect()
    assert [r.conv_id for r in rows] == [-1] if name.startswith("op6") else rows == []


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_partitions_do_not_matter(name, spark, sf):
    """The same rows with other shuffle partitions; files have other names each time."""
    rows = lambda: sorted(str(r.asDict() | {"path": None}) for r in q.queries()[name](spark, sf).collect())
    one = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
