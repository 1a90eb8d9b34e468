import pytest

from quern.llm.queries import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data_dir, name):
    assert same(QUERIES[name](spark, data_dir), ORACLES[name], data_dir) > 0
