"""Queries over coded events, cohorts and interval sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise import dictionaries as d
from slotwise.operators import cleaning as c
from slotwise.operators import events as e
from slotwise.plans import cohort as p
from slotwise.plans import features as f
from slotwise.plans import inputs as src
from slotwise.plans.catalog.registry import (
    ADMISSIONS,
    CHARTEVENTS,
    COHORT,
    DETAIL,
    FIRST_COHORT,
    LAB_NAMES,
    LABELLED_LABS,
    LABELLED_VITALS,
    LABEVENTS,
    MEASURED,
    PRIOR,
    STAGES,
    WINDOWS,
    pivot_columns,
    query,
    rounded,
    sql_in,
    sql_pick,
)
from slotwise.session import stored

KINDS = ["click", "view", "purchase"]


def cohort_of(spark, sf) -> DataFrame:
    """Eligible stays, before their stages inside the window are looked at."""
    detail = src.stay_detail(spark, sf)
    return p.select_cohort(detail, p.prior_positive(detail, src.stages(spark, sf)))


def staged_cohort(spark, sf) -> DataFrame:
    """The stays that later steps read, stored: eligible, staged in the window, and nowhere without a stage."""
    return stored(p.staged_stays(stored(cohort_of(spark, sf)), src.stages(spark, sf)))


@query(
    "events_in_window",
    f"""WITH {WINDOWS} SELECT w.user_id, e.event_id, e.ts, e.event_type, e.value
    FROM windows w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN w.s AND w.e""",
)
def events_in_window(spark, sf):
    rows = e.events_in_window(src.windows(spark, sf), src.events(spark, sf), "user_id", "ts")
    return rows.select("user_id", "event_id", "ts", "event_type", "value")


@query(
    "events_in_window_unmatched",
    f"""WITH {WINDOWS} SELECT w.user_id, e.event_id, e.ts
    FROM windows w LEFT JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN w.s AND w.e
      AND e.event_type = 'error' AND e.value > 100""",
)
def events_in_window_unmatched(spark, sf):
    high = src.events(spark, sf, "error").filter(F.col("value") > 100)
    rows = e.events_in_window(
        src.windows(spark, sf), high, "user_id", "ts", keep_unmatched=True
    )
    return rows.select("user_id", "event_id", "ts")


@query(
    "events_before_window",
    f"""WITH {WINDOWS} SELECT w.user_id, e.event_id, e.ts
    FROM windows w JOIN events e ON e.user_id = w.user_id AND e.ts < w.s""",
)
def events_before_window(spark, sf):
    rows = e.events_before(src.windows(spark, sf), src.events(spark, sf), "user_id", "ts")
    return rows.select("user_id", "event_id", "ts")


@query(
    "events_for_entity",
    f"""WITH {WINDOWS} SELECT w.user_id, w.s AS start, e.event_id
    FROM windows w JOIN events e ON e.user_id = w.user_id AND e.event_type = 'signup'""",
)
def events_for_entity(spark, sf):
    rows = e.events_for_entity(
        src.windows(spark, sf), src.events(spark, sf), "user_id", F.col("event_type") == "signup"
    )
    return rows.select("user_id", "start", "event_id")


@query("prior_positive", f"WITH {DETAIL}, {STAGES}, {PRIOR} SELECT * FROM prior")
def prior_positive(spark, sf):
    return p.prior_positive(src.stay_detail(spark, sf), src.stages(spark, sf))


@query("cohort_select", f"WITH {FIRST_COHORT} SELECT * FROM first_cohort")
def cohort_select(spark, sf):
    return cohort_of(spark, sf)


@query(
    "stage_series",
    f"""WITH {FIRST_COHORT} SELECT c.*, k.charttime, round(creat, 6) AS creat,
      round(uo_rt_6hr, 6) AS uo_rt_6hr, round(uo_rt_12hr, 6) AS uo_rt_12hr,
      round(uo_rt_24hr, 6) AS uo_rt_24hr, aki_stage
    FROM first_cohort c JOIN stages k ON k.stay_id = c.stay_id
      AND k.charttime BETWEEN c.icu_intime AND c.icu_outtime
    WHERE aki_stage IS NOT NULL""",
)
def stage_series(spark, sf):
    rows = p.stage_series(cohort_of(spark, sf), src.stages(spark, sf))
    return rounded(rows, "creat", "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr")


IN_WINDOW = """FROM stages k WHERE k.stay_id = c.stay_id
      AND k.charttime BETWEEN c.icu_intime AND c.icu_outtime"""


@query(
    "staged_stays",
    f"""WITH {FIRST_COHORT} SELECT c.* FROM first_cohort c
    WHERE EXISTS (SELECT 1 {IN_WINDOW})
      AND NOT EXISTS (SELECT 1 {IN_WINDOW} AND k.aki_stage IS NULL)""",
)
def staged_stays(spark, sf):
    return p.staged_stays(stored(cohort_of(spark, sf)), src.stages(spark, sf))


@query(
    "static_detail",
    f"""WITH {COHORT}, {ADMISSIONS}
    SELECT d.subject_id, d.hadm_id, d.stay_id, gender, admittime, dischtime, admission_age, race,
      admission_type
    FROM detail d LEFT JOIN admissions a ON a.hadm_id = d.hadm_id
    WHERE d.stay_id IN (SELECT stay_id FROM cohort)""",
)
def static_detail(spark, sf):
    return p.static_detail(
        src.stay_detail(spark, sf), src.admissions(spark, sf), staged_cohort(spark, sf)
    )


RACE_GROUPS_SHOWN = ["ASIAN", "BLACK", "PORTUGUESE", "UNKNOWN", "WHITE"]
CATEGORIES = {
    "gender": ["F", "M"], "race": RACE_GROUPS_SHOWN, "admission_type": sorted(src.ADMISSION_TYPES),
}


def _dummies(col: str, values) -> str:
    return ", ".join(
        f"(CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END)::INT AS \"{col}_{v}\"" for v in values
    )


@query(
    "encode_static",
    f"""WITH {DETAIL}, {ADMISSIONS}, r AS (
      SELECT stay_id, admission_age, gender, admission_type,
        CASE race WHEN 'WHITE - RUSSIAN' THEN 'WHITE' WHEN 'ASIAN - CHINESE' THEN 'ASIAN'
          WHEN 'BLACK/AFRICAN' THEN 'BLACK' WHEN 'OTHER' THEN 'UNKNOWN' ELSE race END AS race
      FROM detail LEFT JOIN admissions USING (hadm_id))
    SELECT stay_id, admission_age, {_dummies('gender', ['F', 'M'])},
      {_dummies('race', RACE_GROUPS_SHOWN)},
      {_dummies('admission_type', src.ADMISSION_TYPES)} FROM r""",
)
def encode_static(spark, sf):
    detail = e.enrich(src.stay_detail(spark, sf), src.admissions(spark, sf), "hadm_id")
    return f.encode_static(detail, CATEGORIES)


MEASURE_RULES = [
    d.CodeRule(0, "warm", 70.0, 120.0, shift=32.0, scale=1.8),
    d.CodeRule(1, "share", 0.0, 100.0, high_open=False),
    d.CodeRule(2, "share", 0.0, 300.0),
    d.CodeRule(3, "free"),
]


@query(
    "code_map_limits",
    """WITH m AS (SELECT event_id, event_id % 5 AS code, value FROM events)
    SELECT event_id, code, CASE code WHEN 0 THEN 'warm' WHEN 3 THEN 'free' ELSE 'share' END
        AS concept,
      round(CASE code
        WHEN 0 THEN CASE WHEN value > 70 AND value < 120 THEN (value - 32) / 1.8::DOUBLE END
        WHEN 1 THEN CASE WHEN value > 0 AND value <= 100 THEN value END
        WHEN 2 THEN CASE WHEN value > 0 AND value < 300 THEN value END
        ELSE value END, 6) AS value
    FROM m WHERE code IN (0, 1, 2, 3)""",
)
def code_map_limits(spark, sf):
    coded = src.events(spark, sf).select(
        "event_id", (F.col("event_id") % 5).alias("code"), "value"
    )
    mapped = c.convert_units(c.apply_limits(c.map_codes(coded, MEASURE_RULES)))
    return rounded(mapped.select("event_id", "code", "concept", "value"), "value")


def _pivot_sql(fn: str, suffix: str) -> str:
    cols = ", ".join(
        f"round({fn}(value) FILTER (WHERE event_type = '{k}'), 6) AS {k}{suffix}" for k in KINDS
    )
    return f"""SELECT user_id, date_trunc('day', ts) AS day, {cols} FROM events GROUP BY 1, 2"""


def _daily(spark, sf):
    return src.events(spark, sf).withColumn(
        "day", F.date_trunc("day", "ts").cast("timestamp_ntz")
    )


@query("pivot_mean", _pivot_sql("avg", "_mean"))
def pivot_mean(spark, sf):
    wide = e.pivot_mean(_daily(spark, sf), ["user_id", "day"], "event_type", "value", KINDS)
    return rounded(wide, *[f"{k}_mean" for k in KINDS])


@query("pivot_min", _pivot_sql("min", "_min"))
def pivot_min(spark, sf):
    wide = e.pivot_agg(_daily(spark, sf), ["user_id", "day"], "event_type", "value", KINDS, "min")
    return rounded(wide, *[f"{k}_min" for k in KINDS])


@query("pivot_max", _pivot_sql("max", "_max"))
def pivot_max(spark, sf):
    wide = e.pivot_agg(_daily(spark, sf), ["user_id", "day"], "event_type", "value", KINDS, "max")
    return rounded(wide, *[f"{k}_max" for k in KINDS])


LAB_PIVOT = f"""SELECT c.subject_id, c.hadm_id, c.stay_id, l.charttime,
      {pivot_columns(LAB_NAMES)}
    FROM cohort c JOIN labs l ON l.hadm_id = c.hadm_id
      AND l.charttime BETWEEN c.icu_intime AND c.icu_outtime
    GROUP BY 1, 2, 3, 4"""

VITAL_PIVOT = f"""SELECT c.subject_id, c.hadm_id, c.stay_id, v.charttime,
      {pivot_columns(d.VITAL_ORDER)}
    FROM cohort c JOIN vitals v ON v.stay_id = c.stay_id
      AND v.charttime BETWEEN c.icu_intime AND c.icu_outtime
    GROUP BY 1, 2, 3, 4"""


def lab_pivot(spark, sf, keep_unmatched=False, cohort=None):
    stays = src.unit_stays(src.stay_detail(spark, sf))
    cohort = cohort or staged_cohort(spark, sf)
    return f.pivot_labs(cohort, stays, src.labevents(spark, sf), keep_unmatched=keep_unmatched)


@query("pivot_labs", f"WITH {COHORT}, {LABEVENTS}, {LABELLED_LABS} {LAB_PIVOT}")
def pivot_labs(spark, sf):
    return rounded(lab_pivot(spark, sf), *[f"{n}_mean" for n in LAB_NAMES])


@query(
    "pivot_labs_unmatched",
    f"""WITH {COHORT}, {LABEVENTS}, {LABELLED_LABS}
    {LAB_PIVOT.replace("JOIN labs l", "LEFT JOIN labs l")}""",
)
def pivot_labs_unmatched(spark, sf):
    return rounded(lab_pivot(spark, sf, keep_unmatched=True), *[f"{n}_mean" for n in LAB_NAMES])


def vital_pivot(spark, sf, cohort=None):
    return f.pivot_vitals(cohort or staged_cohort(spark, sf), src.chartevents(spark, sf))


@query("pivot_vitals", f"WITH {COHORT}, {CHARTEVENTS}, {LABELLED_VITALS} {VITAL_PIVOT}")
def pivot_vitals(spark, sf):
    return rounded(vital_pivot(spark, sf), *[f"{n}_mean" for n in d.VITAL_ORDER])


HOURS = "INTERVAL 1 HOUR"
RENAL = f"""chart AS (
  SELECT user_id // 2 AS hadm_id, date_trunc('hour', ts) AS charttime,
    {sql_pick(src.RENAL_CHART_CODES + [1], 'event_id')} AS itemid, {MEASURED} AS valuenum,
    CASE WHEN event_id % 7 <> 0 THEN {sql_pick(src.RENAL_CHART_VALUES, 'event_id')} END AS value
  FROM events WHERE event_type IN ('click', 'purchase')),
inputs AS (
  SELECT user_id // 2 AS hadm_id, user_id AS stay_id,
    {sql_pick(src.RENAL_INPUT_CODES + [1], 'event_id')} AS itemid, ts AS starttime,
    ts + (event_id % 30)::INT * {HOURS} AS endtime, {MEASURED} AS amount,
    event_id AS linkorderid,
    CASE WHEN event_id % 13 <> 0 THEN {sql_pick(src.ORDER_STATUSES, 'event_id')} END
      AS statusdescription
  FROM events WHERE event_type = 'signup'),
dates AS (
  SELECT user_id // 2 AS hadm_id, ts AS charttime,
    {sql_pick(d.DIALYSIS_DATE_CODES + [1, 2, 3], 'event_id')} AS itemid
  FROM events WHERE event_type = 'view'),
procedures AS (
  SELECT user_id // 2 AS hadm_id, ts AS starttime,
    ts + (event_id % 12)::INT * {HOURS} AS endtime,
    {sql_pick(d.DIALYSIS_PROCESS_CODES + [1, 2, 3], 'event_id')} AS itemid
  FROM events WHERE event_type = 'error')"""

CHART_FLAG = f"""CASE
        WHEN itemid IN {sql_in(d.DIALYSIS_ANY_VALUE_CODES)} AND value IS NOT NULL THEN 1
        WHEN itemid IN {sql_in(d.DIALYSIS_LINE_CODES)} AND value = 'Dialysis Line' THEN 1
        WHEN itemid = 582 AND value IN {sql_in(d.DIALYSIS_PROCEDURE_VALUES)} THEN 1
        ELSE 0 END"""


@query(
    "renal_intervals",
    f"""WITH {COHORT}, {RENAL}, flagged AS (
      SELECT c.hadm_id, c.stay_id, charttime AS starttime, charttime AS endtime,
        max({CHART_FLAG}) AS rrt
      FROM cohort c JOIN chart ON chart.hadm_id = c.hadm_id GROUP BY 1, 2, 3, 4
      UNION ALL
      SELECT c.hadm_id, c.stay_id, charttime, charttime, 1 FROM cohort c
      JOIN chart ON chart.hadm_id = c.hadm_id
      WHERE itemid IN {sql_in(d.DIALYSIS_POSITIVE_CODES)} AND valuenum > 0
      UNION ALL
      SELECT c.hadm_id, c.stay_id, starttime, endtime, 1 FROM cohort c
      JOIN inputs i ON i.hadm_id = c.hadm_id
      WHERE itemid IN {sql_in(d.DIALYSIS_INPUT_CODES)} AND amount > 0
      UNION ALL
      SELECT c.hadm_id, c.stay_id, charttime, charttime, 1 FROM cohort c
      JOIN dates ON dates.hadm_id = c.hadm_id WHERE itemid IN {sql_in(d.DIALYSIS_DATE_CODES)}
      UNION ALL
      SELECT c.hadm_id, c.stay_id, starttime, endtime, 1 FROM cohort c
      JOIN procedures p ON p.hadm_id = c.hadm_id
      WHERE itemid IN {sql_in(d.DIALYSIS_PROCESS_CODES)})
    SELECT hadm_id, stay_id, starttime, endtime, max(rrt)::INT AS rrt FROM flagged
    WHERE rrt = 1 GROUP BY 1, 2, 3, 4""",
)
def renal_intervals(spark, sf):
    return f.renal_intervals(
        staged_cohort(spark, sf),
        src.renal_chartevents(spark, sf),
        src.inputevents(spark, sf),
        src.datetimeevents(spark, sf),
        src.procedureevents(spark, sf),
    )


@query(
    "flag_events",
    f"""WITH {RENAL} SELECT hadm_id, charttime, max({CHART_FLAG})::INT AS rrt
    FROM chart GROUP BY 1, 2""",
)
def flag_events(spark, sf):
    rules = e.value_rules(
        "itemid",
        "value",
        {
            "any": (d.DIALYSIS_ANY_VALUE_CODES, None),
            "line": (d.DIALYSIS_LINE_CODES, [d.DIALYSIS_LINE_VALUE]),
            "procedure": ([d.DIALYSIS_PROCEDURE_CODE], d.DIALYSIS_PROCEDURE_VALUES),
        },
    )
    return e.flag_events(src.renal_chartevents(spark, sf), ["hadm_id", "charttime"], rules, "rrt")


@query(
    "collapse_flags",
    """SELECT user_id, date_trunc('day', ts) AS day, max((value > 60)::INT) AS flag
    FROM events GROUP BY 1, 2""",
)
def collapse_flags(spark, sf):
    flags = _daily(spark, sf).select(
        "user_id", "day", (F.col("value") > 60).cast("int").alias("flag")
    )
    return e.collapse_flags(flags, ["user_id", "day"])


@query(
    "order_intervals",
    f"""WITH {RENAL} SELECT stay_id, linkorderid, starttime, endtime,
      round(amount, 6) AS sedative_amount FROM inputs
    WHERE itemid IN {sql_in(d.SEDATION_CODES)} AND statusdescription <> 'Rewritten'""",
)
def order_intervals(spark, sf):
    return rounded(f.order_intervals(src.inputevents(spark, sf)), "sedative_amount")


@query(
    "valid_orders",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'""",
)
def valid_orders(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    urgent = c.filter_codes(orders, ["1-URGENT", "2-HIGH"], "o_orderpriority")
    return urgent.filter(F.col("o_orderstatus") != "P").select(
        "o_orderkey", "o_custkey", "o_orderdate"
    )


@query(
    "keep_ids",
    """SELECT event_id, user_id FROM events WHERE user_id IN (
      SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)""",
)
def keep_ids(spark, sf):
    high = src.events(spark, sf, "error").filter(F.col("value") > 200)
    return c.keep_ids(src.events(spark, sf), high, "user_id").select("event_id", "user_id")


@query(
    "exclude_ids",
    f"""WITH {DETAIL} SELECT stay_id, icu_intime FROM detail d
    WHERE icu_intime IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM events e
      WHERE e.user_id = d.stay_id AND e.event_type = 'error' AND e.value > 200)""",
)
def exclude_ids(spark, sf):
    high = src.events(spark, sf, "error").filter(F.col("value") > 200)
    detail = src.stay_detail(spark, sf).select("stay_id", "icu_intime")
    ids = high.select(F.col("user_id").alias("stay_id"))
    return c.exclude_ids(detail, ids, "stay_id", not_null=["icu_intime"])


@query(
    "points_to_intervals",
    """SELECT user_id, ts AS starttime, ts AS endtime FROM events WHERE event_type = 'error'""",
)
def points_to_intervals(spark, sf):
    points = src.events(spark, sf, "error").select("user_id", "ts")
    return c.points_to_intervals(points, "ts")


@query(
    "recode",
    f"""WITH {DETAIL} SELECT CASE race WHEN 'WHITE - RUSSIAN' THEN 'WHITE'
      WHEN 'ASIAN - CHINESE' THEN 'ASIAN' WHEN 'BLACK/AFRICAN' THEN 'BLACK'
      WHEN 'OTHER' THEN 'UNKNOWN' ELSE race END AS race, count(*) AS n FROM detail GROUP BY 1""",
)
def recode(spark, sf):
    return c.recode(src.stay_detail(spark, sf), "race", d.RACE_GROUPS).groupBy("race").agg(
        F.count("*").alias("n")
    )
