"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from sealane.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def tidy(v):
    return (None if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=str)
    spark.catalog.clearCache()
    result = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(tidy(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
