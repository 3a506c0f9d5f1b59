"""Every query with SQL against DuckDB."""

import duckdb
import pandas as pd
import pytest

from pixelrel.plans import queries as registry

SF = "/root/testdata/sf0.001"


def plain(value):
    """Missing values as None, whole numbers as such, whatever type a column with gaps was given."""
    if value is None or value is pd.NA or value != value:
        return None
    return int(value) if isinstance(value, float) and value == int(value) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(plain, row))) for row in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "documents", "pages", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(registry.SQL[name]).df())


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
