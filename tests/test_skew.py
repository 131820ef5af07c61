"""A third of all events belong to one user, and many of them fall on one moment."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.oracle import connect, differences

NAMES = [
    "events_in_window", "prior_positive", "stage_series", "pivot_labs", "pivot_vitals",
    "renal_intervals", "fuse_measure", "align_series", "iqr_fences", "mask_outliers",
    "collapse_duplicates", "resample_6h", "flag_intervals", "attach_flags_static", "shift_label",
    "pad_sequences", "supervised_set", "los_filter", "info_integrity", "undersample", "roc_auc",
    "evaluate", "roc_auc_by_group", "permutation_importance", "exact_quantiles", "build_series",
    "build_series_repeated", "flag_intervals_open", "events_in_window_unmatched",
    "pivot_labs_unmatched",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    duckdb.sql(
        f"""COPY (SELECT * REPLACE (
            CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,
            CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE ts END AS ts,
            CASE WHEN event_id % 6 = 0 THEN 55.5 ELSE value END AS value)
          FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet'"""
    )
    duckdb.sql(
        f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 17.0 ELSE l_quantity END
              AS l_quantity) FROM '/root/testdata/sf0.001/lineitem.parquet')
          TO '{folder}/lineitem.parquet'"""
    )
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_results_hold_under_skew(spark, skewed, name):
    found = differences(spark, connect(skewed), skewed, queries()[name], oracle_sql()[name])
    assert found is None
