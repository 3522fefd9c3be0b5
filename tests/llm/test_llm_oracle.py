"""Queries against their SQL on the driver's tables."""

import os

import pytest

from harness import compare, connect
from risklens.llm.oracle import ORACLE
from risklens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) == ""


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_entry_registers_them():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
