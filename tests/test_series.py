"""Edge cases of fusing, masking, resampling, interval flags and shifts."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from slotwise.functions.columns import first_nonnull, nonzero_mean
from slotwise.operators import cleaning as c
from slotwise.operators import quality as q
from slotwise.operators import series as s
from slotwise.operators.intervals import flag_intervals
from slotwise.plans.features import build_series
from tests.helpers import at, rows_of

SERIES = "id bigint, time timestamp_ntz, a double, stage int"


def test_fused_sources_agree_or_differ(spark):
    one = spark.createDataFrame([(1, at(), 5.0), (1, at(1), 6.0), (1, at(2), None)],
                                "id bigint, time timestamp_ntz, x double")
    two = spark.createDataFrame([(1, at(), 5.0), (1, at(1), 8.0)],
                                "id bigint, time timestamp_ntz, y double")
    fused = s.fuse_measure([(one, "x"), (two, "y")], ["id", "time"], "m")
    assert rows_of(fused) == [(1, at(), 5.0), (1, at(1), 6.0), (1, at(1), 8.0)]
    merged = s.collapse_duplicates(fused, ["id", "time"], ["m"])
    assert rows_of(merged) == [(1, at(), 5.0), (1, at(1), 7.0)]


def test_aligned_series_equals_chained_outer_joins(spark):
    rng = random.Random(3)
    keys = ["id", "time"]

    def unique(name):
        rows = {(rng.randint(1, 3), at(rng.randint(0, 5))): rng.random() for _ in range(10)}
        return spark.createDataFrame(
            [(*k, v) for k, v in rows.items()], f"id bigint, time timestamp_ntz, {name} double"
        )

    def many(name):
        rows = {(rng.randint(1, 3), at(rng.randint(0, 5)), float(rng.randint(0, 9)))
                for _ in range(14)}
        return spark.createDataFrame(sorted(rows), f"id bigint, time timestamp_ntz, {name} double")

    a, b, m, n = unique("a"), unique("b"), many("m"), many("n")
    chained = a
    for other in (b, m, n):
        chained = chained.join(other, keys, "full_outer")
    stacked = s.align_series([a, b], keys, repeated=[m, n])
    assert sorted(map(repr, chained.collect())) == sorted(map(repr, stacked.collect()))


def test_rows_of_one_key_are_never_gathered(spark, monkeypatch):
    for name in ("collect_list", "collect_set"):
        monkeypatch.setattr(F, name, lambda *_: pytest.fail("rows of a key gathered in one value"))
    keys = ["id", "time"]
    a = spark.createDataFrame([(1, at(), 1.0)], "id bigint, time timestamp_ntz, a double")
    hot = spark.range(2000).selectExpr(
        "id % 2 AS id", "timestamp_ntz'2024-01-01' AS time", "id * 1.0D AS m", "id % 5 * 1.0D AS x"
    )
    out = s.align_series([a], keys, {"f": ["x"]}, [hot])
    # each key has its repeated rows times its distinct fused values
    assert out.count() == 2 * 1000 * 5
    assert set(map(tuple, out.select("id", "a").distinct().collect())) == {(0, None), (1, 1.0)}


def test_build_series_drops_empty_rows_and_fuses(spark):
    key = "subject_id bigint, hadm_id bigint, stay_id bigint, charttime timestamp_ntz"
    vitals = spark.createDataFrame(
        [(1, 1, 1, at(), 80.0, 100.0), (1, 1, 1, at(1), None, None), (1, 1, 1, at(2), None, 90.0)],
        f"{key}, heartrate_mean double, glucose_mean double",
    )
    labs = spark.createDataFrame(
        [(1, 1, 1, at(), 100.0, 1.5, 4.0), (1, 1, 1, at(2), 95.0, None, None)],
        f"{key}, glucose_mean double, creatinine_mean double, potassium_mean double",
    )
    stages = spark.createDataFrame(
        [(1, 1, 1, at(), 1.6, 0), (1, 1, 1, at(3), None, 1)], f"{key}, creat double, aki_stage int"
    )
    wide = build_series(vitals, labs, stages).drop("hadm_id", "stay_id")
    assert wide.columns == [
        "charttime", "heartrate", "potassium", "aki_stage", "glucose", "creatinine"
    ]
    assert rows_of(wide, "charttime", "glucose", "creatinine") == [
        (at(), 80.0, 4.0, 0, 100.0, 1.5),
        (at(), 80.0, 4.0, 0, 100.0, 1.6),
        (at(2), None, None, None, 90.0, None),
        (at(2), None, None, None, 95.0, None),
        (at(3), None, None, 1, None, None),
    ]


def test_value_on_the_fence_is_kept(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 7.0, 7.1)], "a double")
    fences = spark.createDataFrame([("a", 1.0, 7.0)], "feature string, low double, up double")
    kept = c.mask_outliers(rows, fences, ["a"])
    assert [r.a for r in kept.orderBy("a").collect()] == [None, 1.0, 2.0, 3.0, 4.0, 7.0]


def test_single_row_and_empty_features_survive_masking(spark):
    rows = spark.createDataFrame([(5.0, None), (None, None)], "a double, b double")
    fences = q.iqr_fences(rows, ["a", "b"])
    assert rows_of(fences) == [("a", 5.0, 5.0), ("b", None, None)]
    assert rows_of(c.mask_outliers(rows, fences, ["a", "b"])) == [(None, None), (5.0, None)]


def test_resample_slots_and_gaps(spark):
    rows = spark.createDataFrame(
        [
            (1, at(5, minutes=59, seconds=59, microseconds=999999), 1.0, 1),
            (1, at(5), 3.0, 2),
            (1, at(6), 5.0, None),
            (1, at(18), 7.0, 3),
            (2, at(7), None, 0),
        ],
        SERIES,
    )
    grid = s.resample(rows, "id", "time", numeric=["a"], discrete=["stage"])
    assert rows_of(grid) == [
        (1, at(0), 2.0, 2), (1, at(6), 5.0, None), (1, at(12), None, None), (1, at(18), 7.0, 3),
        (2, at(6), None, 0),
    ]


def test_resample_fills_a_gap_of_a_thousand_years(spark):
    slots = 1000 * 365 * 4
    rows = spark.createDataFrame([(1, at(), 1.0, 0), (1, at(6 * slots), 2.0, 0)], SERIES)
    grid = s.resample(rows, "id", "time", numeric=["a"])
    got = grid.agg(F.count("*"), F.countDistinct("slot"), F.sum("a"), F.max("slot")).first()
    assert tuple(got) == (slots + 1, slots + 1, 3.0, at(6 * slots))
    assert [r["n_slots"] for r in s.long_gaps(rows, "id", "time", 1000).collect()] == [slots]


def grid_of(spark, n, id=1):
    return spark.createDataFrame([(id, at(6 * i)) for i in range(n)],
                                 "id bigint, slot timestamp_ntz")


def flagged(spark, grid, *intervals):
    table = spark.createDataFrame(
        [(1, a, b) for a, b in intervals],
        "id bigint, starttime timestamp_ntz, endtime timestamp_ntz",
    )
    return [r.f for r in flag_intervals(grid, table, "f").orderBy("id", "slot").collect()]


def test_interval_flags(spark):
    grid = grid_of(spark, 5)
    half = timedelta(milliseconds=500)
    # end exactly at a slot start
    assert flagged(spark, grid, (at(1), at(6))) == [1, 1, 0, 0, 0]
    # start in the last half second of a slot does not count for that slot
    assert flagged(spark, grid, (at(6) - half, at(7))) == [0, 1, 0, 0, 0]
    # wholly inside that last half second: no slot at all
    assert flagged(spark, grid, (at(6) - half, at(6) - half / 2)) == [0, 0, 0, 0, 0]
    # exactly one second before the next slot still counts
    assert flagged(spark, grid, (at(6, seconds=-1), at(6, seconds=-1))) == [1, 0, 0, 0, 0]
    # reversed: only the two ends
    assert flagged(spark, grid, (at(25), at(1))) == [1, 0, 0, 0, 1]
    # reversed with an end in the last half second
    assert flagged(spark, grid, (at(25), at(6) - half)) == [0, 0, 0, 0, 1]
    # zero length, and two that overlap
    assert flagged(spark, grid, (at(7), at(7))) == [0, 1, 0, 0, 0]
    assert flagged(spark, grid, (at(1), at(8)), (at(2), at(9))) == [1, 1, 0, 0, 0]
    # open ended, and outside the grid
    assert flagged(spark, grid, (at(13), at(24 * 365 * 900))) == [0, 0, 1, 1, 1]
    assert flagged(spark, grid, (at(-50), at(-40)), (None, at(1))) == [0, 0, 0, 0, 0]


def test_interval_flags_equal_the_two_literal_rules(spark):
    rng = random.Random(11)
    grid = grid_of(spark, 20).unionByName(grid_of(spark, 7, id=2))
    intervals = []
    for _ in range(300):
        start = at(rng.uniform(-10, 130))
        if rng.random() < 0.3:  # near a slot border
            start = at(6 * rng.randint(0, 20), microseconds=rng.choice([-1500000, -1000000, -1, 0, 1]))
        length = rng.choice([0, 0.0001, 0.5, 5.9, 6, 13, -4, -7])
        intervals.append((rng.choice([1, 2, 3]), start, start + timedelta(hours=length)))
    for chunk in range(0, 300, 60):
        some = intervals[chunk : chunk + 6]
        table = spark.createDataFrame(
            some, "id bigint, starttime timestamp_ntz, endtime timestamp_ntz"
        )
        for id, slot, flag in rows_of(flag_intervals(grid, table, "f")):
            last = slot + timedelta(hours=6) - timedelta(seconds=1)
            want = any(
                i == id and (a <= slot <= b or slot <= a <= last or slot <= b <= last)
                for i, a, b in some
            )
            assert flag == int(want), (id, slot, some)


def labels(spark, n, id=1):
    return spark.createDataFrame([(id, at(6 * i), float(i), i % 4) for i in range(n)], SERIES)


def test_label_lead_drops_the_last_rows(spark):
    assert s.shift_label(labels(spark, 8), "id", "time", "stage").count() == 0
    nine = s.shift_label(labels(spark, 9), "id", "time", "stage")
    assert rows_of(nine) == [(1, at(), 0.0, 0)]
    ten = s.shift_label(labels(spark, 10), "id", "time", "stage", binary=False)
    assert rows_of(ten) == [(1, at(), 0.0, 0), (1, at(6), 1.0, 1)]


def test_label_at_an_exact_time_needs_that_slot(spark):
    rows = labels(spark, 12).filter(F.col("time") != at(6 * 9))
    shifted = s.shift_label(rows, "id", "time", "stage", binary=False, horizon="48 hours")
    assert rows_of(shifted) == [(1, at(), 0.0, 0), (1, at(12), 2.0, 2), (1, at(18), 3.0, 3)]


def test_missing_labels_count_as_zero(spark):
    rows = labels(spark, 10).withColumn("stage", F.lit(None).cast("int"))
    assert [r.stage for r in s.shift_label(rows, "id", "time", "stage").collect()] == [0, 0]


def test_neighbours_keep_nulls_inside_and_default_outside(spark):
    rows = spark.createDataFrame([(1, at(), 1.0, 0), (1, at(6), None, 0), (1, at(12), 3.0, 0)], SERIES)
    out = s.neighbour_features(rows, "id", "time", ["a"]).select("time", "a_lag1", "a_lead1")
    assert rows_of(out) == [(at(), 0.0, None), (at(6), 1.0, 3.0), (at(12), None, 0.0)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_of_slots_give_what_whole_series_give(spark, monkeypatch, block):
    monkeypatch.setattr(s, "SLOT_BLOCK", block)
    rng = random.Random(block)
    rows = [
        (id, at(6 * (i - 9)), rng.choice([None, float(i)]), rng.choice([None, 0, 1, 2]))
        for id, n in ((1, 40), (2, 1), (3, 8), (None, 12)) for i in range(n)
    ]
    df = spark.createDataFrame(rows, SERIES).repartition(4)
    whole = s.shift_label(df, "id", "time", "stage", binary=False)
    cut = s.shift_label(df, "id", "time", "stage", binary=False, width="6 hours")
    assert rows_of(cut.na.fill(-1)) == rows_of(whole.na.fill(-1)) and cut.columns == whole.columns
    lags = (2, 1, 0, -1, -11)
    whole = s.neighbour_features(df, "id", "time", ["a", "stage"], lags)
    cut = s.neighbour_features(df, "id", "time", ["a", "stage"], lags, width="6 hours")
    assert rows_of(cut.na.fill(-1)) == rows_of(whole.na.fill(-1)) and cut.columns == whole.columns
    assert cut.dtypes == whole.dtypes


def test_steps_are_slots_when_the_width_is_known(spark):
    rows = [(1, at(), 1.0, 1), (1, at(12), 3.0, 3), (1, at(18), 4.0, 0), (1, None, 9.0, 2)]
    df = spark.createDataFrame(rows, SERIES)
    shifted = s.shift_label(df, "id", "time", "stage", 2, binary=False, width="6 hours")
    assert rows_of(shifted) == [(1, at(), 1.0, 3)]
    near = s.neighbour_features(df, "id", "time", ["a"], width="6 hours").filter("time IS NOT NULL")
    assert rows_of(near.select("time", "a_lag1", "a_lead1")) == [
        (at(), 0.0, 0.0), (at(12), 0.0, 4.0), (at(18), 3.0, 0.0),
    ]
    empty = df.limit(0)
    assert s.shift_label(empty, "id", "time", "stage", width="6 hours").count() == 0
    assert s.resample(empty, "id", "time", numeric=["a"]).count() == 0


def test_aggregates(spark):
    rows = spark.createDataFrame(
        [(1, at(2), 4.0, 0), (1, at(1), None, 0), (1, at(3), 0.0, 2), (2, at(), 0.0, 0)], SERIES
    )
    out = rows.groupBy("id").agg(
        nonzero_mean("a").alias("m"), first_nonnull("a", "time").alias("f")
    )
    assert rows_of(out) == [(1, 4.0, 4.0), (2, 0.0, 0.0)]


def test_null_guard_modes(spark):
    rows = spark.createDataFrame([(1, 2), (None, 3)], "a int, b int")
    assert rows_of(c.null_guard(rows, ["a"])) == [(1, 2)]
    assert c.null_guard(rows, ["a"], "skip_feature").count() == 0
    assert c.null_guard(rows, ["b"], "skip_feature").count() == 2
    with pytest.raises(Exception, match="null in one of a"):
        c.null_guard(rows, ["a"], "error").collect()
    assert c.null_guard(rows, ["b"], "error").count() == 2


def test_presented_rows_are_sorted_inside_files(spark):
    rows = labels(spark, 50).unionByName(labels(spark, 50, id=2))
    parts = (
        s.presented(rows, "id", "time")
        .select(F.spark_partition_id().alias("p"), "id", "time")
        .collect()
    )
    for p in {r.p for r in parts}:
        keys = [(r.id, r.time) for r in parts if r.p == p]
        assert keys == sorted(keys)
