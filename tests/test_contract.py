"""The catalogue against its SQL, at the smallest size."""

import os

import pytest

from parley import catalogue

SF = "/root/testdata/sf0.001"
KINDS = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLES[name])
    assert {c: KINDS[t] for c, t in ours.dtypes} == dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    names = sorted(ours.columns)
    at = [theirs.columns.index(c) for c in names]
    assert plain(tuple(r) for r in ours.select(*names).collect()) == plain(tuple(r[i] for i in at) for r in theirs.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
