"""Every named query with SQL gives what that SQL gives; the others give rows."""

import pytest

from tessera.catalogue import bins, models, pieces

Q, S = bins.Q | models.Q | pieces.Q, bins.S | models.S | pieces.S


@pytest.mark.parametrize("name", sorted(S))
def test_same_as_sql(name, same):
    same(Q[name], S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_has_rows(name, spark, sf):
    df = Q[name](spark, sf)
    assert df.columns and df.limit(1).count() == 1


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(Q) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
