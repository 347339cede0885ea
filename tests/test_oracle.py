"""Every registered query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "\0" if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_rows_as_sql(spark, duck, key):
    ours = QUERIES[key](spark, SF_DIR)
    theirs = duck.execute(SQL[key])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    expected = _rows(names, theirs.fetchall())
    assert expected, "the check compares nothing"
    assert _rows(ours.columns, ours.collect()) == expected


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, key):
    assert QUERIES[key](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
