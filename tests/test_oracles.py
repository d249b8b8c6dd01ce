"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from folioframe.jobs.registry import ORACLES, QUERIES, STUDY, _grid_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


#: SQL that takes too long on larger tables.
SMALL_ONLY = {"grid_momentum_240": _grid_sql(STUDY)}


@pytest.mark.parametrize("name", sorted(ORACLES | SMALL_ONLY))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute((ORACLES | SMALL_ONLY)[name])
    names = [d[0] for d in cursor.description]
    want = _sorted(cursor.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert _sorted(tuple(r[c] for c in names) for r in got.collect()) == want
    assert want or name.startswith(("part_sort",))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - set(SMALL_ONLY)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
