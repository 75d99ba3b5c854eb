"""Every query with oracle SQL gives the same rows in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from foliant.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def spelled(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, name):
    df, sql = registry.queries()[name](spark, DATA), registry.oracle_sql()[name]
    names = sorted(df.columns)
    assert spelled(df.select(*names).collect()) == spelled(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
