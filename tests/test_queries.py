"""Every registered query against its SQL, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from hearthlens.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
FITS = ("forest", "stacked", "svm", "boosting", "cross_validated")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows_of(records, columns):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    rows = [tuple(plain(v) for v in record) for record in records]
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v) if not isinstance(v, (int, float)) else float), v if v is not None else 0) for v in row))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = rows_of([[r[c] for c in columns] for r in df.collect()], columns)
    cursor = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == rows_of([[r[i] for i in order] for r in cursor.fetchall()], columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["city", "mean_price"] and df.count() > 0


def test_every_query_without_sql_fits_a_model():
    own = set(QUERIES) - set(SQL)
    assert all(any(word in name for word in FITS) for name in own)
