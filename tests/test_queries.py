"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e
from lexforge.operators import ordering
from lexforge.operators import relational as R
from lexforge.plans import queries as plans

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, D)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    sql = plans.oracles().get(name)
    if sql:
        want = db.sql(sql)
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(want.columns) == sorted(df.columns)
        assert rows == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_order_over_partitions(spark):
    df = spark.range(0, 1000, 3).repartition(7)
    assert [r.n for r in ordering.numbered(df, ["id"], "n").orderBy("id").collect()] == list(range(1, 335))
    assert [r.t for r in ordering.running_total(df, ["id"], "id", "t").orderBy("id").limit(4).collect()] == [0, 0, 3, 9]
    assert [r.x for r in ordering.following(df, "id", "x").orderBy("id").collect()] == [*range(3, 1000, 3), None]


def test_first_of_overlapping_ranges(spark):
    ranges = spark.createDataFrame([("a", 0, 300, 2), ("b", 100, 200, 1), ("c", 7, 7, 0)], "file string, first int, last int, ord int")
    rows = spark.createDataFrame([(7,), (150,), (199,), (200,), (300,), (None,)], "off int")
    got = {r.off: r.file for r in R.range_lookup(rows, ranges, "off", "first", "last", "ord").select("off", "range.file").collect()}
    assert got == {7: "a", 150: "b", 199: "b", 200: "a", 300: None, None: None}
