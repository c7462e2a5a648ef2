import pytest

import __spark_entry__ as entry
from runeloom.plans.oracles import ORACLES
from runeloom.plans.queries import QUERIES
from tests.compare import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, tmp_path):
    assert_same(spark, QUERIES[name], ORACLES[name], SF, tmp_path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert {r.pack_split for r in entry.entry(spark).collect()} <= {"train", "val"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
