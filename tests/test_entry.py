"""The driver's contract, the command line, and the reference tables by SQL at the smallest size."""

import glob
import os

import pytest

import __spark_entry__ as entry
from pairloom import cli, queries

SF = "/root/testdata/sf0.001"


def test_entry_has_a_row(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(queries.queries()) > 80 and len(queries.oracle_sql()) > 80


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    found = c.execute(queries.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    want = sorted(str([r[at.index(x)] for x in names]) for r in found.fetchall())
    assert sorted(str([r[x] for x in names]) for r in got.collect()) == want


def test_command_line(spark, capsys):
    assert cli.main(["queries"]) == 0 and "bm25" in capsys.readouterr().out
    assert cli.main(["usecases"]) == 0
