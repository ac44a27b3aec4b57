"""Every registered query against its SQL equivalent, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from wardcast.plans import catalog, oracles

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def as_rows(table):
    names = sorted(table.column_names)
    columns = [table[n].to_pylist() for n in names]
    return names, sorted(zip(*columns), key=lambda r: tuple((v is None, str(v)) for v in r))


def types(table):
    return {f.name: str(f.type) for f in table.schema}


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracles.all_sql())
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours = entry.queries()[name](spark, SF_DIR).toArrow()
    theirs = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert types(ours) == types(theirs)
    assert as_rows(ours) == as_rows(theirs)
    assert ours.num_rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "horizon" and df.count() == 20
