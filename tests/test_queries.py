"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from framelake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def clean(v):
        if v is None or isinstance(v, (str, bool)):
            return v
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0

    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    assert name in SQL
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
