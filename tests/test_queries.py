"""Every registered query of the operators against its SQL, on the smallest tables."""

import pytest

from larkspan import plans
from tests.oracle import run_spark, run_sql


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, name):
    got = run_spark(plans.QUERIES[name](spark, small))
    if name in plans.ORACLES:
        assert got == run_sql(small, plans.ORACLES[name])
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
