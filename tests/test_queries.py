"""Every registered query against its oracle in DuckDB over the same Parquet files, values compared after rounding."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, decimal.Decimal):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    query = registry.QUERIES[name]
    found = query.run(spark, DIR)
    rows = [tuple(r[c] for c in sorted(found.columns)) for r in found.collect()]
    if query.oracle is None:
        assert len(found.columns) and rows is not None
        return
    answer = duck.execute(query.oracle)
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(found.columns)
    order = [names.index(c) for c in sorted(names)]
    wanted = [tuple(r[i] for i in order) for r in answer.fetchall()]
    assert sorted(map(plain, rows)) == sorted(map(plain, wanted))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
