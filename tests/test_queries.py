"""Every query with SQL gives DuckDB's result on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline"))))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    said = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in said.description]
    assert sorted(theirs) == columns
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in said.fetchall()), key=repr)


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith(("op", "pipeline"))))
def test_training_data_query(spark, duck, name):
    test_query(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() == 4096
