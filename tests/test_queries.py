import duckdb
import pytest

import __spark_entry__ as entry_module
from catalog.views import TABLES
from tools_check import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query_equals_its_sql(spark, con, name):
    result, detail, _ = compare(spark, con, SF, name, entry_module.queries()[name], entry_module.oracle_sql().get(name))
    assert result != "FAIL", detail


def test_entry_returns_rows(spark):
    assert entry_module.entry(spark).count() > 0
