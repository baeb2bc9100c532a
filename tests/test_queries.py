"""Every query of the core that has SQL, against DuckDB on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from graphloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(SQL[name])
    order = [list(rel.columns).index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    df = registry.queries()[name](spark, str(DATA))
    assert df.columns and df.count() >= 0
