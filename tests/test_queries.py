import pytest
from compare import SF, same

from snapfold.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).schema.fields


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).schema.fields
    assert set(e.oracle_sql()) <= set(e.queries())
