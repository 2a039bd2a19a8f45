"""Every registered cube query against its SQL on the smallest tables, or those that CUBE_TABLES names."""

import glob
import os

import pytest

from cubelark import queries

FOLDER = os.environ.get("CUBE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda v: None if v is None else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(map(value, row)) for row in frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(queries.ORACLE_SQL) >= len(queries.QUERIES) - 1
