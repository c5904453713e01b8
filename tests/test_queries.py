"""Every query gives the rows of its SQL on the smallest data set."""

import pytest

from __spark_entry__ import entry
from leafstack.plans import all_oracles, all_queries
from tests.conftest import SMALL
from tools.compare import connect, difference

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, SMALL).toArrow()
    assert ours.num_rows > 0
    if name in ORACLES:
        assert difference(ours, con.execute(ORACLES[name]).to_arrow_table()) == ""


def test_oracles_have_all_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"d7_ann_topk"}


def test_entry(spark):
    assert entry(spark).count() > 0
