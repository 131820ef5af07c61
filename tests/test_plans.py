"""Physical plans keep the shapes the operators promise."""

import re

import pytest

from __spark_entry__ import queries
from slotwise.operators import events as e
from slotwise.operators import series as s
from slotwise.plans import inputs as src
from slotwise.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
FITTING = {"step_classifier", "neighbour_classifier", "select_by_auc", "cohort_to_supervised"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+partitioning\([^\n]*?), \d+\)", plan)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTING))
def test_no_nested_loops_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    for bad in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert bad not in plan


def test_scan_reads_only_what_is_needed_and_gets_the_filter(spark):
    plan = plan_of(queries()["valid_orders"](spark, FOLDER))
    assert "In(o_orderpriority, [1-URGENT,2-HIGH])" in plan.replace(", 2-HIGH", ",2-HIGH")
    assert "o_totalprice" not in plan and "Not(EqualTo(o_orderstatus,P))" in plan
    assert shuffles(plan) == []


def test_code_dictionary_is_a_broadcast_of_a_local_table(spark):
    plan = plan_of(queries()["code_map_limits"](spark, FOLDER))
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan and shuffles(plan) == []


def test_small_cohort_is_broadcast_by_its_size(spark, tmp_path):
    src.windows(spark, FOLDER).write.parquet(str(tmp_path / "w"))
    stays = spark.read.parquet(str(tmp_path / "w"))
    joined = e.events_in_window(stays, src.events(spark, FOLDER), "user_id", "ts")
    assert shuffles(plan_of(joined)) == []


def test_large_cohort_is_merged_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = e.events_in_window(
            src.windows(spark, FOLDER), src.events(spark, FOLDER), "user_id", "ts"
        )
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pivot_is_one_shuffle_with_partial_aggregation(spark):
    plan = plan_of(queries()["pivot_mean"](spark, FOLDER))
    assert len(shuffles(plan)) == 1 and "partial_avg" in plan


def test_alignment_is_one_shuffle(spark):
    keys = ["id", "time"]
    frames = [
        spark.range(10).selectExpr("id", f"timestamp_ntz'2024-01-01' as time", f"1.0D as {c}")
        for c in "abcd"
    ]
    assert len(shuffles(plan_of(s.align_series(frames, keys)))) == 1


def windows_of(plan: str) -> list[str]:
    """Partition columns of each window of a plan, without the numbers of expressions."""
    return [re.sub(r"#\d+L?", "", w) for w in re.findall(r"Window \[.*\], \[([^\]]*)\], \[[^\]]*\]", plan)]


def test_no_window_by_the_id_alone(spark):
    grid = s.resample(src.series(spark, FOLDER), "id", "time", numeric=["click"], discrete=["stage"])
    assert windows_of(plan_of(grid)) == []
    labelled = s.shift_label(grid, "id", "slot", "stage", width="6 hours")
    wide = s.neighbour_features(labelled, "id", "slot", ["click"], width="6 hours")
    assert windows_of(plan_of(wide)) == ["id, _block"] * 2
    whole = s.shift_label(grid, "id", "slot", "stage")
    assert windows_of(plan_of(whole)) == ["id"]


def test_label_and_neighbours_shuffle_once_each(spark):
    grid = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("user_id AS id", "ts AS slot", "value AS stage")
    assert len(shuffles(plan_of(s.shift_label(grid, "id", "slot", "stage", width="6 hours")))) == 1
    assert len(shuffles(plan_of(s.neighbour_features(grid, "id", "slot", ["stage"], width="6 hours")))) == 1


def test_last_steps_are_cut_before_the_shuffle(spark):
    from slotwise.operators.encode import last_steps

    rows = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "ts", "value")
    plan = plan_of(last_steps(rows, "user_id", "ts", 5))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_split_needs_no_shuffle(spark):
    assert shuffles(plan_of(queries()["get_split"](spark, FOLDER))) == []
