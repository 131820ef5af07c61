"""Selecting stays: earlier positives, the cohort, its stage series, its static detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.operators.cleaning import exclude_ids, keep_ids
from slotwise.operators.events import enrich, events_before, events_in_window

STAY_KEYS = ["subject_id", "hadm_id", "stay_id"]
STAGE_VALUES = ["creat", "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr", "aki_stage"]


def prior_positive(detail: DataFrame, stages: DataFrame) -> DataFrame:
    """Staged rows other than stage 0 from before the stay's admission to the unit."""
    positive = stages.filter(F.col("aki_stage") != 0).select("stay_id", "charttime", "aki_stage")
    stays = detail.select("stay_id", "icu_intime", "icu_outtime", "first_icu_stay")
    return events_before(stays, positive, "stay_id", "charttime", "icu_intime")


def select_cohort(
    detail: DataFrame,
    prior: DataFrame,
    age: tuple[float, float] = (18, 89),
    min_los: float = 2,
) -> DataFrame:
    """Stays of the accepted age and length, with known times and no earlier positive stage."""
    eligible = detail.filter(
        F.col("admission_age").between(*age) & (F.col("los_icu") >= min_los)
    ).select(*STAY_KEYS, "icu_intime", "icu_outtime")
    return exclude_ids(eligible, prior, "stay_id", not_null=["icu_intime", "icu_outtime"])


def _staged(cohort: DataFrame, stages: DataFrame) -> DataFrame:
    values = [c for c in STAGE_VALUES if c in stages.columns]
    return events_in_window(
        cohort, stages.select("stay_id", "charttime", *values), "stay_id", "charttime",
        "icu_intime", "icu_outtime",
    )


def stage_series(cohort: DataFrame, stages: DataFrame) -> DataFrame:
    """Staged rows inside each stay's window; rows without a stage are left out."""
    return _staged(cohort, stages.filter(F.col("aki_stage").isNotNull()))


def staged_stays(cohort: DataFrame, stages: DataFrame) -> DataFrame:
    """Stays with at least one row in the window and no row whose stage is null.

    The two questions are one aggregation per stay, so the stage table is read once.
    """
    seen = (
        _staged(cohort, stages)
        .groupBy("stay_id")
        .agg(F.bool_or(F.col("aki_stage").isNull()).alias("_incomplete"))
        .filter(~F.col("_incomplete"))
    )
    return keep_ids(cohort, seen, "stay_id")


def static_detail(detail: DataFrame, admissions: DataFrame, cohort: DataFrame) -> DataFrame:
    """Demographic and admission attributes of the cohort's stays."""
    rows = keep_ids(detail, cohort, "stay_id").select(
        *STAY_KEYS, "gender", "admittime", "dischtime", "admission_age", "race"
    )
    return enrich(rows, admissions.select("hadm_id", "admission_type"), "hadm_id")
