"""Every registered engine query against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from plumbline.plans import registry

TABLES = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if v == v else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{TABLES}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, TABLES)
    rows, cols = df.collect(), sorted(df.columns)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr) == want
