"""Every registered query against its SQL twin, run by DuckDB over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from lamella.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]
QUERIES, SQL = registry.queries(), registry.oracle_sql()
# Some kernels run for seconds; pytest takes those without a twin at the smallest scale as well.


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, str):
            return v
        try:
            return f"{round(float(v), 4) + 0.0:.4f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(value(v) for v in row) for row in df.itertuples(index=False))


def close(a: str, b: str) -> bool:
    try:
        return abs(float(a) - float(b)) <= 2e-4 * max(1.0, abs(float(a)))
    except ValueError:
        return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    expected = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = comparable(got), comparable(expected)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if x != y and not all(close(p, q) for p, q in zip(x, y))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).toPandas().shape[1] > 0
