"""Corpus queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lectern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    key = lambda df: sorted(repr([plain(v) for v in r]) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None))
    assert key(got) == key(want)
