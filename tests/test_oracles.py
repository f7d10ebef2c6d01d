"""Every registered core query against DuckDB on the same files."""

import duckdb
import pandas as pd
import pytest

from graintide import registry, views

SF = "/root/testdata/sf0.001"


def cells(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    def text(x):
        if pd.isna(x):
            return ""
        if isinstance(x, float):
            return f"{x:.4f}"
        return str(pd.Timestamp(x).date()) if hasattr(x, "year") else str(x)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(map(text, row)) for row in ordered.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in views.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, key):
    assert cells(registry.queries()[key](spark, SF).toPandas()) == cells(duck.sql(registry.oracle_sql()[key]).df())
