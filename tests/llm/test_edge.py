"""Every query on empty tables and on tables with nulls, repeated rows and clashing columns."""

import pytest

from runeloom.llm.queries import QUERIES
from tests.edge import make


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(request, spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    if "empty" in folder and name not in ("p5_report",):
        assert rows == []
