"""Every registered query against its SQL, on the driver's tables."""

import os

import pytest

from harness import compare, connect
from risklens.plans.oracle import ORACLE
from risklens.plans.queries import QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# the small documents hold no match of any rule
NEEDS_LARGER = {"rule_scan"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def cons():
    return {d: connect(d) for d in (SMALL, LARGER)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, cons, name):
    folder = LARGER if name in NEEDS_LARGER else SMALL
    assert compare(QUERIES[name](spark, folder), cons[folder], ORACLE[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()
