"""Every registered query with an oracle agrees with it on the smallest data set."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, FOLDER, queries()[name], oracle_sql()[name]) is None


def test_whole_way_gives_labelled_splits(spark):
    rows = queries()["cohort_to_supervised"](spark, FOLDER).collect()
    assert rows and all(r.n_features > 20 and 0 < r.n_ids <= r.n_rows for r in rows)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
