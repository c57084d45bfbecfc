"""The queries that SQL can express give the rows that DuckDB gives, on whole tables."""

import duckdb
import pytest

from rankweave.llm import registry
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(registry.ORACLE_SQL[name]).fetchdf(), registry.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(want) == len(got)
    want, got = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    assert all((want[c] == got[c]).all() for c in cols)
