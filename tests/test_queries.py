"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from sedimark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = [tuple(None if x is None or x is pd.NaT or x != x else round(float(x), 6) if isinstance(x, float) else x for x in r) for r in frame.itertuples(index=False)]
    return sorted(plain, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    assert not any(t.startswith(("array", "map", "struct")) for _, t in got.dtypes)
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.toPandas()) == rows(want)
    else:
        got.count()


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
