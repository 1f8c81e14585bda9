"""Every registered query against its SQL text, and the contract's shape."""

import re

import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as contract

# The queries of the llm subpackage have tests of their own.
QUERIES = {n: q for n, q in contract.queries().items() if re.match(r"[a-f]\d\d_", n)}
ORACLES = {n: s for n, s in contract.oracle_sql().items() if n in QUERIES}
INVENTORY = [f"{s}{i:02d}" for s, n in zip("abcdef", (11, 21, 24, 7, 21, 14))
             for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_inventory_is_covered():
    have = {re.match(r"[a-f]\d\d", name).group() for name in QUERIES}
    assert have == set(INVENTORY)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        n, problem = differences(df, con, ORACLES[name])
        assert problem == ""
    else:
        n = len(df.collect())
    assert n > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 150
