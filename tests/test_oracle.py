"""Every query equals its SQL counterpart on the smallest data set."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import canonical
from vacantia.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in pathlib.Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.QUERIES) - catalog.APPROXIMATE <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - catalog.APPROXIMATE))
def test_query(spark, engine, name):
    ours = entry.queries()[name](spark, FOLDER).toArrow()
    theirs = engine.sql(entry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    a, b = (canonical(zip(*[t.column(c).to_pylist() for c in columns])) for t in (ours, theirs))
    assert a == b
