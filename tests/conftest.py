import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    scratch = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[*]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(scratch / "warehouse")).config("spark.checkpoint.dir", str(scratch / "checkpoints"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("set enable_progress_bar=false")
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compare a query with its SQL: names, number of rows, and values in any order."""

    def rows(table):
        cols = sorted(table.column_names)
        return cols, sorted(str([_plain(r[c]) for c in cols]) for r in table.to_pylist())

    def run(query, sql):
        got = rows(query(spark, sf).toArrow())
        r = duck.execute(sql)
        want = rows(r.to_arrow_table() if hasattr(r, "to_arrow_table") else r.fetch_arrow_table())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        wrong = [x for x in zip(got[1], want[1]) if x[0] != x[1]]
        assert not wrong, wrong[:3]

    return run


def _plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v
