"""Every query against its SQL in DuckDB, and properties of those that SQL cannot express."""

import math
from pathlib import Path

import duckdb
import pytest

from orbweave import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(table, columns):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in table)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    made = QUERIES[name](spark, sf)
    expected = duck.sql(ORACLES[name])
    assert sorted(made.columns) == sorted(expected.columns)
    assert rows([tuple(r) for r in made.collect()], made.columns) == rows(expected.fetchall(), list(expected.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_twice_alike(spark, sf, name):
    a, b = (sorted(map(str, QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert a == b
