"""Every query against its SQL twin."""

import duckdb
import pytest
from conftest import DATA

from keyferry.plans.catalogue import QUERIES
from keyferry.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("events", "documents"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    out = QUERIES[name](spark, data)
    columns = sorted(out.columns)
    got = sorted((tuple(r) for r in out.select(*columns).collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert got == want
