"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tablelens.plans import oracles
from tablelens.plans import queries as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = registry.registered(), oracles.statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and not math.isnan(v) and v.is_integer():
        return str(int(v))
    return "NULL" if v is None else str(v)


def test_names():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 11


def test_scratch_folder_is_the_named_one(spark):
    from tablelens.session import scratch_dir

    assert scratch_dir(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert os.path.isabs(scratch_dir(spark, "x"))
