"""Every query with SQL must agree with DuckDB on the smallest data set; the others must run."""

import os

import pytest
from compare import compare

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# whole runs and long fits are exercised by their own tests or by tools/compare.py
LONG = ("pipe", "mdl3", "mdl5", "mdl8", "mdl10", "mdl15", "fsl3", "sco", "src10", "tun6", "tun7", "sel6")

# covered by brute force or by the run tests; FULL_CATALOG=1 runs them here too
SLOW = () if os.environ.get("FULL_CATALOG") else ("sel6", "joi5", "mdl14", "tun4", "tun6", "tun7", "tun8", "sco2", "pipe1_balanced")


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith(SLOW)))
def test_query_agrees_with_sql(spark, duck, data, name):
    line = compare(spark, duck, data, name, QUERIES[name], SQL[name])
    assert line.startswith("ok") and "TYPES" not in line, line


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith(LONG + SLOW)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 10


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
