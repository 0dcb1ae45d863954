"""Every registered query with SQL gives the rows that DuckDB gives for it on the same tables."""

import decimal
import os

import duckdb
import pytest

from tesserae import catalog

from tests.conftest import SF


def shown(v):
    return f"{float(v):.6g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    wanted = [tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    got = [tuple(map(shown, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted(got) == sorted(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0
