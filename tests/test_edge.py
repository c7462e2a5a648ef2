"""Every query on empty tables and on tables with nulls, repeated rows and clashing columns."""

import pytest

from runeloom.plans.queries import QUERIES
from tests.edge import make

#: These make words from a lexicon; without one there is nothing to make them from.
NEED_WORDS = {"new_roots", "root_scores", "review_batch"}


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(request, spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NEED_WORDS))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).collect() is not None
