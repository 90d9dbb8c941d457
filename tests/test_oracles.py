"""Every registered query against its SQL form in another engine."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from postloom.plans import queries, settings

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
OPTIONAL = {name for name in entry.queries() if name == "pipeline" or name.startswith("op")}  # tested with their subpackage


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
        return repr(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(set(SQL) - OPTIONAL))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    result = db.execute(SQL[name])
    columns = [part[0] for part in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(result.fetchall(), columns)


def test_all_queries_have_sql():
    assert set(entry.queries()) - OPTIONAL <= set(SQL)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"label_post", "posts", "words"}


@pytest.mark.parametrize("kind, grid", [("svm", settings.MACHINE), ("rf", settings.FOREST)])
def test_trained_models_beat_the_largest_class(spark, kind, grid):
    rows = queries._held_out(spark, FOLDER, kind, grid).collect()
    largest = max(sum(row.label == label for row in rows) for label in {row.label for row in rows})
    assert sum(row.label == row.prediction for row in rows) >= largest
