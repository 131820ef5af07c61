"""Inputs of the registered queries, derived from the given tables.

``events`` has the shape of a clinical record: ``user_id`` is the stay, ``ts`` the charting time,
``event_type`` and ``event_id`` choose the item, ``value`` is the measured value.  Everything here
is a projection or a per-user minimum of the whole table, so the inputs grow with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise import dictionaries as d
from slotwise.sources.tables import read_table

RACES = ["WHITE - RUSSIAN", "ASIAN - CHINESE", "BLACK/AFRICAN", "OTHER", "PORTUGUESE"]
ADMISSION_TYPES = ["URGENT", "ELECTIVE", "EW EMER."]
LAB_CODES = [code for _, codes, _ in d.LAB_CONCEPTS for code in codes]
VITAL_CODES = [rule.code for rule in d.vital_rules()]
RENAL_CHART_CODES = (
    d.DIALYSIS_ANY_VALUE_CODES
    + d.DIALYSIS_LINE_CODES
    + [d.DIALYSIS_PROCEDURE_CODE]
    + d.DIALYSIS_POSITIVE_CODES
)
RENAL_CHART_VALUES = ["Dialysis Line", "CVVHD Start", "CAVH D/C", "Other"]
RENAL_INPUT_CODES = d.DIALYSIS_INPUT_CODES + d.SEDATION_CODES
ORDER_STATUSES = ["FinishedRunning", "Rewritten", "Stopped"]


EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"


def pick(values: list, index: Column) -> Column:
    """The value at ``index`` modulo the length of a literal list."""
    listed = F.expr(f"array({', '.join(repr(v) for v in values)})")
    return F.element_at(listed, (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def events(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    df = read_table(spark, "events", base=sf, schema=EVENTS)
    return df.filter(F.col("event_type").isin(*kinds)) if kinds else df


def _hadm(user: str = "user_id") -> Column:
    return F.floor(F.col(user) / 2).cast("bigint")


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Per user a window from one day to 21 days after the first event."""
    first = F.min("ts")
    return (
        events(spark, sf)
        .groupBy("user_id")
        .agg(
            (first + F.expr("INTERVAL 1 day")).alias("start"),
            (first + F.expr("INTERVAL 21 days")).alias("end"),
        )
    )


def stay_detail(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return windows(spark, sf).select(
        (user + 1_000_000).alias("subject_id"),
        _hadm().alias("hadm_id"),
        user.alias("stay_id"),
        F.when(user % 11 != 0, pick(["F", "M"], user)).alias("gender"),
        (F.col("start") - F.expr("INTERVAL 1 day")).alias("admittime"),
        F.col("end").alias("dischtime"),
        (F.lit(10) + user % 85).cast("double").alias("admission_age"),
        pick(RACES, user).alias("race"),
        ((user % 40).cast("double") / F.lit(2.0)).alias("los_icu"),
        F.when(user % 37 != 0, F.col("start")).alias("icu_intime"),
        F.col("end").alias("icu_outtime"),
        (user % 3 == 0).alias("first_icu_stay"),
    )


def admissions(spark: SparkSession, sf: str) -> DataFrame:
    users = events(spark, sf).select(_hadm().alias("hadm_id")).distinct()
    return users.select("hadm_id", pick(ADMISSION_TYPES, F.col("hadm_id")).alias("admission_type"))


def unit_stays(detail: DataFrame) -> DataFrame:
    return detail.select(
        "subject_id", "hadm_id", "stay_id",
        F.col("icu_intime").alias("intime"), F.col("icu_outtime").alias("outtime"),
    )


def stage(value: str = "value") -> Column:
    return F.least(F.floor(F.col(value) / 40), F.lit(3)).cast("int")


def stages(spark: SparkSession, sf: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return events(spark, sf, "error").select(
        F.col("user_id").alias("stay_id"),
        F.col("ts").alias("charttime"),
        F.when(i % 5 != 0, v / F.lit(40.0)).alias("creat"),
        F.when(i % 3 != 0, v * F.lit(0.5)).alias("uo_rt_6hr"),
        (v * F.lit(0.25)).alias("uo_rt_12hr"),
        (v * F.lit(0.125)).alias("uo_rt_24hr"),
        F.when(i % 97 != 0, stage()).alias("aki_stage"),
    )


def _measured() -> Column:
    i, v = F.col("event_id"), F.col("value")
    return F.when(i % 53 == 0, F.lit(None)).when(i % 59 == 0, -v).otherwise(v)


def labevents(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "view", "signup").select(
        _hadm().alias("hadm_id"),
        F.col("ts").alias("charttime"),
        pick(LAB_CODES + [1], F.col("event_id")).alias("itemid"),
        _measured().alias("valuenum"),
    )


def chartevents(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "click", "purchase").select(
        _hadm().alias("hadm_id"),
        F.col("user_id").alias("stay_id"),
        F.col("ts").alias("charttime"),
        pick(VITAL_CODES + [1], F.col("event_id")).alias("itemid"),
        _measured().alias("valuenum"),
    )


def renal_chartevents(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, sf, "click", "purchase").select(
        _hadm().alias("hadm_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("charttime"),
        pick(RENAL_CHART_CODES + [1], i).alias("itemid"),
        F.when(i % 7 != 0, pick(RENAL_CHART_VALUES, i)).alias("value"),
        _measured().alias("valuenum"),
    )


def inputevents(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, sf, "signup").select(
        _hadm().alias("hadm_id"),
        F.col("user_id").alias("stay_id"),
        pick(RENAL_INPUT_CODES + [1], i).alias("itemid"),
        F.col("ts").alias("starttime"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), (i % 30).cast("int"))).alias("endtime"),
        _measured().alias("amount"),
        i.alias("linkorderid"),
        F.when(i % 13 != 0, pick(ORDER_STATUSES, i)).alias("statusdescription"),
    )


def datetimeevents(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "view").select(
        _hadm().alias("hadm_id"),
        F.col("ts").alias("charttime"),
        pick(d.DIALYSIS_DATE_CODES + [1, 2, 3], F.col("event_id")).alias("itemid"),
    )


def procedureevents(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, sf, "error").select(
        _hadm().alias("hadm_id"),
        F.col("ts").alias("starttime"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), (i % 12).cast("int"))).alias("endtime"),
        pick(d.DIALYSIS_PROCESS_CODES + [1, 2, 3], i).alias("itemid"),
    )


def intervals(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """Treatment intervals of up to 29 hours; every 50th is reversed."""
    i, ts = F.col("event_id"), F.col("ts")
    later = ts + F.make_dt_interval(F.lit(0), (i % 30).cast("int"))
    reversed_ = i % 50 == 0
    return events(spark, sf, *(kinds or ("signup",))).select(
        F.col("user_id").alias("id"),
        F.when(reversed_, later).otherwise(ts).alias("starttime"),
        F.when(reversed_, ts).otherwise(later).alias("endtime"),
    )


def vasopressors(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of vasopressors by stay."""
    return intervals(spark, sf, "purchase").withColumnRenamed("id", "stay_id")


def continuous_renal(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of continuous renal replacement (crrt) by stay."""
    return intervals(spark, sf, "view").withColumnRenamed("id", "stay_id")


def hourly_series(spark: SparkSession, sf: str) -> DataFrame:
    """Wide series with repeated (id, time) rows: one row per event, time cut to the hour."""
    kind, v = F.col("event_type"), F.col("value")
    return events(spark, sf).select(
        F.col("user_id").alias("id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"),
        *[F.when(kind == k, v).alias(k) for k in ("click", "view", "purchase")],
        F.when(kind == "error", stage()).alias("stage"),
    )


def series(spark: SparkSession, sf: str) -> DataFrame:
    """As ``hourly_series`` at full time resolution; ``rare`` is measured for few users only."""
    kind, v = F.col("event_type"), F.col("value")
    return events(spark, sf).select(
        F.col("user_id").alias("id"),
        F.col("ts").alias("time"),
        *[F.when(kind == k, v).alias(k) for k in ("click", "view", "purchase")],
        F.when((kind == "signup") & (F.col("user_id") % 3 == 0), v).alias("rare"),
        F.when(kind == "error", stage()).alias("stage"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score in tied steps of 1/1000 and a label, with a group column."""
    i = F.col("event_id")
    return events(spark, sf).select(
        F.col("user_id").alias("id"),
        F.col("ts").alias("time"),
        (F.pmod(i * F.lit(7919), F.lit(1000)).cast("double") / F.lit(1000.0)).alias("p"),
        (F.col("value") > 50).cast("int").alias("y"),
        F.col("event_type").alias("kind"),
    )
