"""Every registered query against its DuckDB oracle at sf0.001 (the driver
runs the same comparison at sf0.01); rows-only queries must run."""

import os
import sys
import tempfile

import duckdb
import pytest

import __spark_entry__ as E

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"SET temp_directory='{tempfile.mkdtemp(prefix='duck-', dir='/tmp')}'")
    con.execute("SET max_temp_directory_size='2GB'")
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["prompt", "chosen", "rejected", "chosen_score", "rejected_score"]


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, name):
    spd = E.queries()[name](spark, SF).toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    dpd = duck.execute(sql).fetchdf()
    sc, sr = rows_of(spd)
    dc, dr = rows_of(dpd)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
