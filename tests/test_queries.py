import pytest

from quern.queries import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    assert name in ORACLES
    assert same(df, ORACLES[name], data_dir) > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["field0"]
    assert set(e.oracle_sql()) <= set(e.queries())
