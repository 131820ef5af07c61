"""Edge cases of cohort selection, windows, code limits and interval sources."""

import math

from pyspark.sql import functions as F

from slotwise import dictionaries as d
from slotwise.operators import cleaning as c
from slotwise.operators import events as e
from slotwise.plans import cohort as p
from slotwise.plans import features as f
from tests.helpers import at, rows_of

DETAIL = (
    "subject_id bigint, hadm_id bigint, stay_id bigint, admission_age double, los_icu double, "
    "icu_intime timestamp_ntz, icu_outtime timestamp_ntz, first_icu_stay boolean"
)
STAGES = "stay_id bigint, charttime timestamp_ntz, creat double, aki_stage int"


def detail(spark, *stays):
    """Each stay is (id, age, los, intime)."""
    rows = [(i, i, i, age, los, start, at(100), True) for i, age, los, start in stays]
    return spark.createDataFrame(rows, DETAIL)


def no_stages(spark):
    return spark.createDataFrame([], STAGES)


def test_age_and_length_bounds_are_inclusive(spark):
    stays = detail(
        spark, (1, 17.9, 3.0, at()), (2, 18.0, 3.0, at()), (3, 89.0, 2.0, at()),
        (4, 89.1, 3.0, at()), (5, 40.0, 1.99, at()), (6, 40.0, 3.0, None), (7, None, 3.0, at()),
    )
    prior = p.prior_positive(stays, no_stages(spark))
    assert [r.stay_id for r in p.select_cohort(stays, prior).orderBy("stay_id").collect()] == [2, 3]


def test_earlier_positive_stage_excludes(spark):
    stays = detail(
        spark, (1, 40.0, 3.0, at(10)), (2, 40.0, 3.0, at(10)), (3, 40.0, 3.0, at(10)),
        (4, 40.0, 3.0, at(10)),
    )
    stages = spark.createDataFrame(
        [
            (1, at(10, seconds=-1), 1.0, 1),
            (2, at(10), 1.0, 1),
            (3, at(1), 1.0, None),
            (4, at(1), 1.0, 0),
        ],
        STAGES,
    )
    kept = p.select_cohort(stays, p.prior_positive(stays, stages))
    assert [r.stay_id for r in kept.orderBy("stay_id").collect()] == [2, 3, 4]


def test_stay_with_a_null_stage_or_without_stages_is_dropped(spark):
    stays = detail(
        spark, (1, 40.0, 3.0, at()), (2, 40.0, 3.0, at()), (3, 40.0, 3.0, at()),
        (4, 40.0, 3.0, at()),
    )
    stages = spark.createDataFrame(
        [
            (1, at(1), 1.0, 0), (1, at(2), 1.0, 2),
            (2, at(1), 1.0, 1), (2, at(2), 1.0, None),
            (4, at(1), 1.0, 0), (4, at(101), 1.0, None),
        ],
        STAGES,
    )
    cohort = p.select_cohort(stays, p.prior_positive(stays, no_stages(spark)))
    kept = p.staged_stays(cohort, stages)
    assert [r.stay_id for r in kept.orderBy("stay_id").collect()] == [1, 4]
    series = p.stage_series(cohort, stages).select("stay_id", "charttime", "aki_stage")
    assert rows_of(series) == [(1, at(1), 0), (1, at(2), 2), (2, at(1), 1), (4, at(1), 0)]


def test_window_ends_are_included(spark):
    stays = spark.createDataFrame(
        [(1, at(10), at(20)), (2, at(10), at(20))],
        "id bigint, start timestamp_ntz, end timestamp_ntz",
    )
    events = spark.createDataFrame(
        [
            (1, at(10)), (1, at(20)), (1, at(10, seconds=-1)), (1, at(20, seconds=1)),
            (None, at(15)), (1, None),
        ],
        "id bigint, time timestamp_ntz",
    )
    inside = e.events_in_window(stays, events, "id").select("id", "time")
    assert rows_of(inside) == [(1, at(10)), (1, at(20))]
    unmatched = e.events_in_window(stays, events, "id", keep_unmatched=True).select("id", "time")
    assert rows_of(unmatched) == [(1, at(10)), (1, at(20)), (2, None)]
    before = e.events_before(stays, events, "id").select("id", "time")
    assert rows_of(before) == [(1, at(10, seconds=-1))]


def lab_means(spark, values):
    stay = [(7, 8, 9, at(), at(50))]
    stays = spark.createDataFrame(
        stay,
        "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp_ntz, "
        "outtime timestamp_ntz",
    )
    labs = spark.createDataFrame(
        [(8, at(i + 1), code, v) for i, (code, v) in enumerate(values)],
        "hadm_id bigint, charttime timestamp_ntz, itemid bigint, valuenum double",
    )
    return f.pivot_labs(stays, stays, labs)


def test_lab_limits(spark):
    wide = lab_means(spark, [(50912, 0.0), (50912, 150.0), (50912, 150.1), (50912, None), (1, 5.0)])
    assert rows_of(wide.select("charttime", "creatinine_mean")) == [(at(2), 150.0), (at(3), None)]
    assert len([x for x in wide.columns if x.endswith("_mean")]) == 19


def test_codes_of_one_concept_are_averaged(spark):
    stays = spark.createDataFrame(
        [(7, 8, 9, at(), at(50))],
        "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp_ntz, "
        "outtime timestamp_ntz",
    )
    labs = spark.createDataFrame(
        [(8, at(1), 50806, 100.0), (8, at(1), 50902, 110.0)],
        "hadm_id bigint, charttime timestamp_ntz, itemid bigint, valuenum double",
    )
    for fn, want in (("mean", 105.0), ("min", 100.0), ("max", 110.0)):
        wide = f.pivot_labs(stays, stays, labs, fn=fn)
        assert rows_of(wide.select(f"chloride_{fn}")) == [(want,)]


def vital(spark, code, value):
    cohort = spark.createDataFrame(
        [(7, 8, 9, at(), at(50))],
        "subject_id bigint, hadm_id bigint, stay_id bigint, icu_intime timestamp_ntz, "
        "icu_outtime timestamp_ntz",
    )
    chart = spark.createDataFrame(
        [(9, at(1), code, value)],
        "stay_id bigint, charttime timestamp_ntz, itemid bigint, valuenum double",
    )
    return f.pivot_vitals(cohort, chart).first().asDict()


def test_vital_limits_and_units(spark):
    assert vital(spark, 223761, 70.0)["tempc_mean"] is None
    assert math.isclose(vital(spark, 223761, 98.6)["tempc_mean"], 37.0)
    assert vital(spark, 678, 120.0)["tempc_mean"] is None
    assert vital(spark, 223762, 37.5)["tempc_mean"] == 37.5
    assert vital(spark, 646, 100.0)["spo2_mean"] == 100.0
    assert vital(spark, 646, 100.1)["spo2_mean"] is None
    assert vital(spark, 220045, 300.0)["heartrate_mean"] is None
    assert vital(spark, 807, 9999.0)["glucose_mean"] == 9999.0


def test_dictionaries_are_consistent(spark):
    assert len(d.concepts(d.lab_rules())) == 19
    assert len(d.lab_rules()) == 26
    assert sorted(d.concepts(d.vital_rules())) == sorted(d.VITAL_ORDER)
    assert d.dictionary_frame(spark, d.lab_rules()).count() == 26
    assert len(d.DIALYSIS_POSITIVE_CODES) == 25


def test_renal_intervals(spark):
    cohort = spark.createDataFrame([(1, 10), (1, 11)], "hadm_id bigint, stay_id bigint")
    chart = spark.createDataFrame(
        [
            (1, at(1), 152, "x", None), (1, at(2), 152, None, None),
            (1, at(3), 229, "Dialysis Line", None), (1, at(4), 229, "Other", None),
            (1, at(5), 582, "CVVHD Start", None), (1, at(6), 226499, None, 1.0),
            (1, at(7), 226499, None, 0.0), (2, at(8), 152, "x", None),
        ],
        "hadm_id bigint, charttime timestamp_ntz, itemid bigint, value string, valuenum double",
    )
    span = "hadm_id bigint, itemid bigint, starttime timestamp_ntz, endtime timestamp_ntz"
    inputs = spark.createDataFrame(
        [(1, 227536, at(1), at(2), 1.0), (1, 227536, at(3), at(4), 0.0)], f"{span}, amount double"
    )
    dates = spark.createDataFrame(
        [(1, 225318, at(1))], "hadm_id bigint, itemid bigint, charttime timestamp_ntz"
    )
    processes = spark.createDataFrame([(1, 225441, at(1), at(2))], span)
    found = f.renal_intervals(cohort, chart, inputs, dates, processes)
    one_stay = found.filter("stay_id = 10").select("starttime", "endtime", "rrt")
    assert rows_of(one_stay) == [
        (at(1), at(1), 1), (at(1), at(2), 1), (at(3), at(3), 1), (at(5), at(5), 1),
        (at(6), at(6), 1),
    ]
    assert found.filter("stay_id = 11").count() == 5


def test_orders_without_status_are_not_valid(spark):
    orders = spark.createDataFrame(
        [(1, 221668, "Rewritten"), (2, 221668, "Stopped"), (3, 221668, None), (4, 1, "Stopped")],
        "stay_id bigint, itemid bigint, statusdescription string",
    ).withColumns(
        {
            "linkorderid": F.lit(1), "starttime": F.lit(at()), "endtime": F.lit(at()),
            "amount": F.lit(1.0),
        }
    )
    assert [r.stay_id for r in f.order_intervals(orders).collect()] == [2]


def test_exclusion_keeps_rows_unless_listed(spark):
    rows = spark.createDataFrame([(1, 1), (2, None), (3, 1), (None, 1)], "id bigint, t int")
    ids = spark.createDataFrame([(3,), (None,)], "id bigint")
    kept = c.exclude_ids(rows, ids, "id", not_null=["t"])
    assert rows_of(kept) == [(None, 1), (1, 1)]
