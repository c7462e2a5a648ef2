import pytest

from runeloom.llm.queries import ORACLES, QUERIES
from tests.compare import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, tmp_path):
    assert_same(spark, QUERIES[name], ORACLES[name], SF, tmp_path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
