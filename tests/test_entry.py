"""Registered queries: schemas, rows, and equality with their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from versomill.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["doc_index", "n_segments", "n_headings", "n_chars"] and rows.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    got = catalog.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({catalog.oracle_sql()[name]})").fetchall()

    def plain(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)

    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)
