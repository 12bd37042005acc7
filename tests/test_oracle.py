"""Every registered query with an oracle must equal its DuckDB SQL on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
import oracle_check as OC  # noqa: E402

SF = os.environ.get("TILLSIGHT_TEST_SF", "/root/testdata/sf0.001")
sys.path.insert(0, ROOT)
import __spark_entry__ as E  # noqa: E402

SQL = E.oracle_sql()
# model fits, tuning and streaming runs are checked by the row / invariant tests instead
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in OC.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF).toPandas()
    od = duck.execute(SQL[name]).df()
    assert sorted(sp.columns) == sorted(od.columns)
    assert len(sp) == len(od)
    _, a = OC.frame_rows(sp)
    _, b = OC.frame_rows(od)
    assert OC.digest(a) == OC.digest(b), [(x, y) for x, y in zip(a, b) if x != y][:3]
