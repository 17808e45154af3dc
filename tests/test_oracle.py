"""Every query that SQL can express, against DuckDB on the smallest tables; the others give rows."""

import pytest

from tests import oracle
from tickloom.plans import registry


@pytest.fixture(scope="module")
def db(small):
    return oracle.database(small)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_matches_sql(spark, small, db, name):
    assert oracle.difference(registry.queries()[name](spark, small), db, registry.oracle_sql()[name]) is None


#: Presets that take minutes: test_operators.py fits each of their kinds small, and asks that the queries run the presets.
SLOW = {"boosting_deep_predictions", "boosting_leafwise_predictions", "boosting_symmetric_predictions", "network_gated_3_predictions", "network_gated_2_predictions", "model_zoo_leaderboard",
        "second_order_boosting_predictions", "leafwise_boosting_predictions", "symmetric_boosting_predictions"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_gives_rows(spark, small, name):
    df = registry.queries()[name](spark, small)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
