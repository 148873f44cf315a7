"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, oracle

SQL = entry.oracle_sql()
CORE = sorted(n for m in entry._MODULES if not m.__name__.startswith("skein.llm") for n in m.queries())


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_same_as_sql(spark, sf, con, name):
    assert differences(spark, name, entry.queries()[name], SQL[name], sf, con) == ""


#: Queries whose results SQL can't give: hash families and iterative ones; other tests hold them
#: against brute force or round trips.
WITHOUT_SQL = {"s_minhash", "s_ri", "fn_random_index", "g_leiden", "g_clusters", "cap_dual", "p7_bridge", "p7_objects"}


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_without_sql_has_rows_and_says_the_same_again(spark, sf, name):
    assert name in WITHOUT_SQL
    first, again = ([tuple(map(str, r)) for r in entry.queries()[name](spark, sf).collect()] for _ in range(2))
    assert first and sorted(first) == sorted(again)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(entry.queries())
