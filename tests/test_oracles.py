"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import duckdb
import pytest

from loregraph.plans.oracles import ORACLES
from loregraph.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        path = os.path.join(DIR, f)
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def rows(df):
    def plain(x):
        if x is None or str(x) in ("<NA>", "nan", "NaT"):
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return bool(x)
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or "int" in type(x).__name__ or "float" in type(x).__name__ else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_a_statement_run(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, DIR).count() >= 0
