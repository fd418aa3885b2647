"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from tidelake.plans import backtest_catalog, catalog, lake_catalog  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 4)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_backtests_run(spark, sf_dir):
    runs = catalog.QUERIES["backtest_runs"](spark, sf_dir).collect()
    assert {r.run_id for r in runs} == {"averages-2-5", "averages-3-8", "rotation-3", "limits-98"} and all(r.error is None and r.value > 0 for r in runs)
    trades = catalog.QUERIES["backtest_trades"](spark, sf_dir).collect()
    assert {t.side for t in trades} == {"buy", "sell"} and all(t.amount % 100 == 0 for t in trades)
    assert catalog.QUERIES["backtest_metrics"](spark, sf_dir).count() == 4 and catalog.QUERIES["fifo_lot_stats"](spark, sf_dir).count() >= 1
