"""Every registered query against its SQL twin on the smallest tables; those without one must run and return rows."""

import math
import os

import duckdb
import pytest

from deskloom import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in plans.SQL:
        assert df.columns
        return
    result = duck.execute(plans.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    pick = lambda rows, names: sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    assert pick(got, df.columns) == pick(result.fetchall(), columns)
