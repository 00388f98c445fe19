"""Every registered query against its DuckDB oracle on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows, cols = df.collect(), df.columns
    rel = con.sql(E.oracle_sql()[name])
    dcols, drows = rel.columns, rel.fetchall()
    assert sorted(cols) == sorted(dcols)
    types = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
             "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}
    dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        assert types.get(repr(f.dataType), repr(f.dataType)) == dtypes[f.name], f.name
    assert len(rows) == len(drows)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = [dcols.index(cols[i]) for i in order]
    a = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=repr)
    assert a == b


def test_entry_and_registry(spark):
    assert E.entry(spark).count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
