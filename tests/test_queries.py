"""Every registered query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanveil.plans import oracles, queries as registered


def _rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(
        round(r[i], 6) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i]
        for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def twins(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sf, twins, name):
    df = registered.queries()[name](spark, sf)
    cursor = twins.execute(oracles.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows(
        [d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.queries().keys() >= registered.queries().keys()
    assert entry.oracle_sql().keys() >= oracles.oracle_sql().keys()
    assert entry.entry(spark).count() > 0
