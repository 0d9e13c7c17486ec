"""Every core query against its SQL on the smallest tables, and the driver's entry points."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillmatch.plans import profile_queries
from quillmatch.plans.catalog import QUERIES, SQL, Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def normal(df):
    cell = lambda v: "NULL" if not isinstance(v, list) and pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_train_weights_balance_the_train_part(spark):
    """Priors of the part that is fitted are equal, as nb_predict's SQL has it."""
    train, _ = profile_queries._split(Tables(spark, FOLDER))
    a, b = [r[0] for r in train.groupBy("label").agg({"weight": "sum"}).select("sum(weight)").collect()]
    assert abs(a - b) < 1e-6
