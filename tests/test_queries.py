"""Every query of the library against its SQL, by value."""

import pytest
from oracle import same

from lectern.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_arrow_scorer_equals_expression(spark):
    a = QUERIES["flat_search_topk"](spark, SF).collect()
    assert a == QUERIES["flat_search_arrow"](spark, SF).collect()
