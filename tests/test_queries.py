"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from corpusloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(int(value) if isinstance(value, bool) else value)


def rows(names, tuples):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(t[i]) for i in order) for t in tuples)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    got.collect()
    assert got.columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_hashing_embed_takes_every_document(spark):
    got = __spark_entry__.queries()["hashing_embed"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
