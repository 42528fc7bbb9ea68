"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from graphtables.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def shown(rows):
    def cell(v):
        if isinstance(v, float):
            return f"{v:.4f}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert shown(got.select(*columns).collect()) == shown(con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


