"""Every registered query against its SQL on the smallest data, and rules for all of them."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SMALL = "/root/testdata/sf0.001"

# Queries that may have no SQL, and those that have no rows on the smallest data.
NO_SQL: set[str] = set()
EMPTY = {"title_repair"}
# The optional training-data queries have brute-force tests of their own.
CHECKED_ELSEWHERE = tuple(f"op{n}_" for n in (3, 6, 7, 8, 9, 10, 11)) + ("pipeline",)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    outcome = compare(spark, con, SMALL, entry.queries()[name], entry.oracle_sql().get(name))
    wanted = ("same", "EMPTY") if name in EMPTY else ("rows only",) if name in NO_SQL or name.startswith(CHECKED_ELSEWHERE) else ("same",)
    assert outcome.startswith(wanted), outcome


def test_entry(spark):
    assert entry.entry(spark).count() == 25
