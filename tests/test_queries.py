"""Every core query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from quillspan.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    out = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in out.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(out.columns) == sorted(rel.columns)
    assert rows(out.columns, got) == rows(rel.columns, rel.fetchall())
