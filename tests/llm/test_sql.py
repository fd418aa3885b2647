"""The registered queries that SQL can tell give DuckDB's rows."""

import duckdb
import pytest

from tests.test_catalog import TABLES, plain
from tidelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
