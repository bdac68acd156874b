"""Every query with SQL against DuckDB, row for row, on the smallest tables."""

import math
import os

import duckdb
import pytest

from framewright.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def compared(a, b):
    """Rows match, floats to 2e-5 of each other: the smallest tables hold ties that rounding may split."""
    key = lambda r: tuple((x is None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0) for x in r if not isinstance(x, float)) + tuple(round(x, 3) for x in r if isinstance(x, float))
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=2e-5, abs_tol=2e-4)), (x, y)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLES[name])
    assert set(ours.columns) == set(theirs.columns)
    columns = sorted(ours.columns)
    at = [theirs.columns.index(c) for c in columns]
    compared([tuple(plain(r[c]) for c in columns) for r in ours.collect()], [tuple(plain(r[i]) for i in at) for r in theirs.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() > 0 and len(out.columns) == len(set(out.columns))
