"""From raw measurements to the slot grid with treatment flags and static attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise import dictionaries as d
from slotwise.functions.columns import any_of
from slotwise.operators.cleaning import (
    accepted,
    apply_limits,
    convert_units,
    drop_empty,
    filter_codes,
    keep_ids,
    map_codes,
    mask_outliers,
    null_guard,
    recode,
)
from slotwise.operators.encode import one_hot
from slotwise.operators.events import (
    events_for_entity,
    events_in_window,
    pivot_agg,
    value_rules,
)
from slotwise.operators.intervals import flag_treatments, union_intervals
from slotwise.operators.quality import (
    iqr_fences,
    keep_complete,
    keep_covered,
    los_filter,
)
from slotwise.operators.series import (
    align_series,
    attach_static,
    collapse_duplicates,
    resample,
)
from slotwise.plans.cohort import STAY_KEYS
from slotwise.session import stored

SERIES_KEYS = ["hadm_id", "stay_id", "charttime"]


def pivot_labs(
    cohort: DataFrame,
    stays: DataFrame,
    labevents: DataFrame,
    rules: Sequence[d.CodeRule] | None = None,
    fn: str = "mean",
    keep_unmatched: bool = False,
) -> DataFrame:
    """Laboratory values inside each stay, one aggregated column per concept.

    Values that are missing or not positive do not count as measurements; values above the limit
    of their code become null.  Labs belong to the admission, so they join by ``hadm_id``.
    """
    rules = rules or d.lab_rules()
    measured = filter_codes(labevents, [r.code for r in rules], "itemid").filter(
        F.col("valuenum") > 0
    )
    labelled = apply_limits(map_codes(measured, rules, "itemid"), "valuenum")
    window = keep_ids(stays, cohort, "stay_id").select(*STAY_KEYS, "intime", "outtime")
    rows = events_in_window(
        window, labelled.select("hadm_id", "charttime", "concept", "valuenum"), "hadm_id",
        "charttime", "intime", "outtime", keep_unmatched,
    )
    return pivot_agg(
        rows, [*STAY_KEYS, "charttime"], "concept", "valuenum", d.concepts(rules), fn
    )


def pivot_vitals(
    cohort: DataFrame,
    chartevents: DataFrame,
    rules: Sequence[d.CodeRule] | None = None,
    fn: str = "mean",
    keep_unmatched: bool = False,
) -> DataFrame:
    """Vital signs inside each stay, one aggregated column per concept.

    Limits concern the raw value; a value outside them has no concept.  Fahrenheit codes are
    converted after that test.
    """
    rules = rules or d.vital_rules()
    labelled = map_codes(chartevents, rules, "itemid").withColumn(
        "concept", F.when(accepted("valuenum"), F.col("concept"))
    )
    labelled = convert_units(labelled, "valuenum")
    rows = events_in_window(
        cohort, labelled.select("stay_id", "charttime", "concept", "valuenum"), "stay_id",
        "charttime", "icu_intime", "icu_outtime", keep_unmatched,
    )
    names = [c for c in d.VITAL_ORDER if c in d.concepts(rules)] or d.concepts(rules)
    return pivot_agg(rows, [*STAY_KEYS, "charttime"], "concept", "valuenum", names, fn)


class IntervalSource(NamedTuple):
    """A table of treatment records: which rows count and which columns bound them."""

    rows: DataFrame
    condition: Column
    start: str
    end: str


def multi_source_intervals(
    cohort: DataFrame, sources: Sequence[IntervalSource], flag: str = "rrt"
) -> DataFrame:
    """Distinct treatment intervals of the cohort's admissions from several tables.

    There is no time bound: every stay of an admission inherits its intervals.  Each source is
    filtered and stripped of repeats before the join.
    """
    parts = [
        s.rows.filter(s.condition).select(
            "hadm_id", F.col(s.start).alias("starttime"), F.col(s.end).alias("endtime")
        )
        for s in sources
    ]
    intervals = union_intervals(parts).distinct()
    stays = cohort.select("hadm_id", "stay_id").distinct()
    return events_for_entity(stays, intervals, "hadm_id").withColumn(flag, F.lit(1))


def renal_sources(
    chartevents: DataFrame,
    inputevents: DataFrame,
    datetimeevents: DataFrame,
    procedureevents: DataFrame,
) -> list[IntervalSource]:
    """The renal-replacement records of four tables; the chart table is read once."""
    chart = value_rules(
        "itemid",
        "value",
        {
            "any": (d.DIALYSIS_ANY_VALUE_CODES, None),
            "line": (d.DIALYSIS_LINE_CODES, [d.DIALYSIS_LINE_VALUE]),
            "procedure": ([d.DIALYSIS_PROCEDURE_CODE], d.DIALYSIS_PROCEDURE_VALUES),
        },
    )
    chart.append(F.col("itemid").isin(d.DIALYSIS_POSITIVE_CODES) & (F.col("valuenum") > 0))
    item = F.col("itemid")
    return [
        IntervalSource(chartevents, any_of(chart), "charttime", "charttime"),
        IntervalSource(
            inputevents, item.isin(d.DIALYSIS_INPUT_CODES) & (F.col("amount") > 0),
            "starttime", "endtime",
        ),
        IntervalSource(datetimeevents, item.isin(d.DIALYSIS_DATE_CODES), "charttime", "charttime"),
        IntervalSource(
            procedureevents, item.isin(d.DIALYSIS_PROCESS_CODES), "starttime", "endtime"
        ),
    ]


def renal_intervals(
    cohort: DataFrame,
    chartevents: DataFrame,
    inputevents: DataFrame,
    datetimeevents: DataFrame,
    procedureevents: DataFrame,
) -> DataFrame:
    sources = renal_sources(chartevents, inputevents, datetimeevents, procedureevents)
    return multi_source_intervals(cohort, sources)


def order_intervals(inputevents: DataFrame, codes: Sequence[int] | None = None) -> DataFrame:
    """Valid medication orders (sedation by default) as intervals; rewritten orders are out,
    and so are orders without a status."""
    valid = filter_codes(inputevents, codes or d.SEDATION_CODES, "itemid").filter(
        F.col("statusdescription") != d.REWRITTEN_ORDER
    )
    return valid.select(
        "stay_id", "linkorderid", "starttime", "endtime", F.col("amount").alias("sedative_amount")
    )


def build_series(vitals: DataFrame, labs: DataFrame, stages: DataFrame) -> DataFrame:
    """One wide irregular series from vitals and labs, unique per stay and time, and stages.

    A time may have several stage rows; each gives a row of the series, as in an outer merge.

    Glucose is fused from vitals and labs, creatinine from stages and labs.  Rows without any
    value are left out.  Each input is read once and all meet in one shuffle.
    """

    def prepared(df: DataFrame, renamed: Mapping[str, str]) -> DataFrame:
        names = {c: c.removesuffix("_mean") for c in df.columns}
        names = {c: renamed.get(n, n) for c, n in names.items()}
        named = df.withColumnsRenamed(names).drop("subject_id", "icu_intime", "icu_outtime")
        return drop_empty(named, [c for c in named.columns if c not in SERIES_KEYS])

    frames = [
        prepared(vitals, {"glucose": "_chart_glucose"}),
        prepared(labs, {"glucose": "_lab_glucose", "creatinine": "_lab_creatinine"}),
    ]
    staged = prepared(stages, {"creat": "_stage_creatinine"})
    fused = {
        "glucose": ["_chart_glucose", "_lab_glucose"],
        "creatinine": ["_stage_creatinine", "_lab_creatinine"],
    }
    return align_series(frames, SERIES_KEYS, fused, [staged])


def clean_resample(
    series: DataFrame,
    id: str = "stay_id",
    time: str = "charttime",
    label: str = "aki_stage",
    features: Sequence[str] | None = None,
    width: str = "6 hours",
    fence: float = 1.5,
    min_los: float = 2.0,
    los_percentile: float = 0.95,
    min_coverage: float = 0.8,
    min_integrity: float = 0.8,
) -> tuple[DataFrame, list[str]]:
    """Mask outliers, merge equal times, keep well-covered features and ids, resample.

    Returns the grid (the slot start is named ``time``) and the features that were kept.  The
    merged series is stored, because lengths, coverage, completeness and the grid all read it.
    """
    feats = list(features or [c for c in series.columns if c not in (id, time, label, "hadm_id")])
    masked = mask_outliers(series, iqr_fences(series, feats, fence), feats)
    merged = stored(collapse_duplicates(masked, [id, time], feats, [label]))
    stays = los_filter(merged, id, time, min_los, los_percentile)
    covered, kept = keep_covered(stays, id, feats, min_coverage)
    complete = keep_complete(covered, id, kept, min_integrity)
    grid = resample(complete, id, time, width, numeric=kept, discrete=[label], slot="_slot")
    return grid.withColumnRenamed("_slot", time), kept


def encode_static(
    detail: DataFrame, categories: Mapping[str, Sequence[Any]] | None = None
) -> DataFrame:
    """One encoded row per stay: age, and 0/1 columns of gender, race group, admission type."""
    rows = recode(
        detail.select("stay_id", "admission_age", "gender", "race", "admission_type"),
        "race",
        d.RACE_GROUPS,
    )
    return one_hot(rows, ["gender", "race", "admission_type"], categories)


def attach_flags_static(
    grid: DataFrame,
    treatments: Mapping[str, DataFrame],
    static: DataFrame,
    id: str = "stay_id",
    time: str = "charttime",
    width: str = "6 hours",
    on_null: str = "drop_rows",
) -> DataFrame:
    """Add one 0/1 column per treatment and the static attributes to the grid.

    The grid is stored, because it is read for its time range and for the join.  Only the ids of
    the grid matter when nulls in a treatment table are judged.
    """
    grid = stored(grid)
    guarded = {}
    for name, table in treatments.items():
        if on_null != "drop_rows":
            table = keep_ids(table, grid.select(id).distinct(), id)
        guarded[name] = null_guard(table, ["starttime", "endtime"], on_null)
    flagged = flag_treatments(grid, guarded, id=id, slot=time, width=width)
    return attach_static(flagged, static, id)


__all__ = [
    "IntervalSource", "attach_flags_static", "build_series", "clean_resample", "encode_static",
    "multi_source_intervals", "order_intervals", "pivot_labs", "pivot_vitals",
    "renal_intervals", "renal_sources",
]
