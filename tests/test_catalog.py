"""Every catalog query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from lectern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") and not isinstance(v, pd.Timestamp) else v
    return round(v, 5) if isinstance(v, float) else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, db, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    if name in catalog.oracle_sql():
        assert rows(got) == rows(db.sql(catalog.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_only_listed_sql():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_core_does_not_need_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['lectern.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'hybrid_fusion' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    from pathlib import Path

    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
