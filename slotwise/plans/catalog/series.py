"""Queries over wide series: fusing, aligning, cleaning, resampling, flags, shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise import dictionaries as d
from slotwise.functions.columns import first_nonnull, nonzero_mean
from slotwise.operators import cleaning as c
from slotwise.operators import series as s
from slotwise.operators.intervals import flag_intervals, union_intervals
from slotwise.operators.quality import iqr_fences
from slotwise.plans import features as f
from slotwise.plans import inputs as src
from slotwise.plans.catalog.events import (
    LAB_PIVOT,
    VITAL_PIVOT,
    lab_pivot,
    staged_cohort,
    vital_pivot,
)
from slotwise.plans.catalog.registry import (
    CHARTEVENTS,
    COHORT,
    GRID,
    HOURLY,
    INTERVALS,
    LAB_NAMES,
    LABELLED_LABS,
    LABELLED_VITALS,
    LABEVENTS,
    SERIES,
    avg,
    grid_sql,
    query,
    rounded,
)
from slotwise.plans.cohort import stage_series
from slotwise.session import stored

MEASURES = ["click", "view", "purchase"]


def grid_of(spark, sf):
    return s.resample(
        src.series(spark, sf), "id", "time", numeric=MEASURES, discrete=["stage"]
    )


@query(
    "fuse_measure",
    f"""WITH {HOURLY} SELECT id, time, click AS measure FROM hourly WHERE click IS NOT NULL
    UNION SELECT id, time, view FROM hourly WHERE view IS NOT NULL""",
)
def fuse_measure(spark, sf):
    rows = src.hourly_series(spark, sf)
    return s.fuse_measure([(rows, "click"), (rows, "view")], ["id", "time"], "measure")


def _hourly_mean(spark, sf, col):
    rows = src.hourly_series(spark, sf).dropna(subset=[col])
    return rows.groupBy("id", "time").agg(F.avg(col).alias(col))


@query(
    "align_series",
    f"""WITH {HOURLY},
      a AS (SELECT id, time, avg(click) AS click FROM hourly WHERE click IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT id, time, avg(view) AS view FROM hourly WHERE view IS NOT NULL GROUP BY 1, 2),
      m AS (SELECT DISTINCT id, time, purchase FROM hourly WHERE purchase IS NOT NULL),
      g AS (SELECT DISTINCT id, time, stage FROM hourly WHERE stage IS NOT NULL)
    SELECT id, time, round(click, 6) AS click, round(view, 6) AS view, purchase, stage
    FROM a FULL JOIN b USING (id, time) FULL JOIN m USING (id, time)
      FULL JOIN g USING (id, time)""",
)
def align_series(spark, sf):
    rows = src.hourly_series(spark, sf)
    keys = ["id", "time"]
    aligned = s.align_series(
        [_hourly_mean(spark, sf, "click"), _hourly_mean(spark, sf, "view")],
        keys,
        repeated=[
            s.fuse_measure([(rows, "purchase")], keys, "purchase"),
            s.fuse_measure([(rows, "stage")], keys, "stage"),
        ],
    )
    return rounded(aligned, "click", "view")


VITALS_LEFT = ["heartrate", "sysbp", "diasbp", "meanbp", "resprate", "tempc", "spo2"]
LABS_LEFT = [n for n in LAB_NAMES if n not in ("glucose", "creatinine")]


def _some(names, suffix="_mean"):
    return " OR ".join(f"{n}{suffix} IS NOT NULL" for n in names)


def _renamed(names):
    return ", ".join(f"{n}_mean AS {n}" for n in names)


def build_ctes(time: str) -> str:
    """The frames that make up the wide series of the cohort."""
    return f"""{COHORT}, {LABEVENTS}, {LABELLED_LABS}, {CHARTEVENTS}, {LABELLED_VITALS},
    lp AS ({LAB_PIVOT}), vp AS ({VITAL_PIVOT}),
    v AS (SELECT hadm_id, stay_id, charttime, {_renamed(VITALS_LEFT)} FROM vp
      WHERE {_some(VITALS_LEFT)}),
    l AS (SELECT hadm_id, stay_id, charttime, {_renamed(LABS_LEFT)} FROM lp
      WHERE {_some(LABS_LEFT)}),
    st AS (SELECT c.hadm_id, c.stay_id, {time} AS charttime, round(creat, 6) AS creat, uo_rt_6hr,
        uo_rt_12hr, uo_rt_24hr, aki_stage
      FROM cohort c JOIN stages k ON k.stay_id = c.stay_id
        AND k.charttime BETWEEN c.icu_intime AND c.icu_outtime WHERE aki_stage IS NOT NULL),
    glu AS (SELECT hadm_id, stay_id, charttime, glucose_mean AS glucose FROM vp
      WHERE glucose_mean IS NOT NULL
      UNION SELECT hadm_id, stay_id, charttime, glucose_mean FROM lp
      WHERE glucose_mean IS NOT NULL),
    cre AS (SELECT hadm_id, stay_id, charttime, creat AS creatinine FROM st
      WHERE creat IS NOT NULL
      UNION SELECT hadm_id, stay_id, charttime, creatinine_mean FROM lp
      WHERE creatinine_mean IS NOT NULL),
    k AS (SELECT hadm_id, stay_id, charttime, uo_rt_6hr, uo_rt_12hr, uo_rt_24hr, aki_stage
      FROM st)"""


BUILT = f"""SELECT hadm_id, stay_id, charttime, {", ".join(VITALS_LEFT + LABS_LEFT)},
      glucose, creatinine, round(uo_rt_6hr, 6) AS uo_rt_6hr, round(uo_rt_12hr, 6) AS uo_rt_12hr,
      round(uo_rt_24hr, 6) AS uo_rt_24hr, aki_stage
    FROM v FULL JOIN l USING (hadm_id, stay_id, charttime)
      FULL JOIN glu USING (hadm_id, stay_id, charttime)
      FULL JOIN cre USING (hadm_id, stay_id, charttime)
      FULL JOIN k USING (hadm_id, stay_id, charttime)"""


def _build_sql(time: str) -> str:
    return f"WITH {build_ctes(time)} {BUILT}"


@query("build_series", _build_sql("k.charttime"))
def build_series(spark, sf):
    return _built(spark, sf, "charttime")


@query("build_series_repeated", _build_sql("date_trunc('day', k.charttime)"))
def build_series_repeated(spark, sf):
    """Stages by the day, so that one time has several stage rows."""
    return _built(spark, sf, F.date_trunc("day", "charttime").cast("timestamp_ntz"))


def _built(spark, sf, time):
    cohort = staged_cohort(spark, sf)
    stages = stage_series(cohort, src.stages(spark, sf)).withColumn("charttime", F.col(time) if isinstance(time, str) else time)
    wide = f.build_series(
        vital_pivot(spark, sf, cohort), lab_pivot(spark, sf, cohort=cohort), stages
    )
    return rounded(wide, *[x for x in wide.columns if x not in (*f.SERIES_KEYS, "aki_stage")])


def _fence_sql(cols, source="series"):
    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 "
        f"FROM {source}"
        for x in cols
    )


FENCES = f"""fences AS (SELECT feature, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS up
  FROM ({_fence_sql(MEASURES)}))"""


def _masked_sql(x):
    bound = "(SELECT {0} FROM fences WHERE feature = '" + x + "')"
    return (
        f"CASE WHEN {x} < {bound.format('low')} OR {x} > {bound.format('up')} THEN NULL "
        f"ELSE {x} END AS {x}"
    )


MASKED = f"""masked AS (SELECT id, time, {", ".join(_masked_sql(x) for x in MEASURES)}, rare, stage
  FROM series)"""


@query(
    "iqr_fences",
    f"""WITH {SERIES}, {FENCES}
    SELECT feature, round(low, 6) AS low, round(up, 6) AS up FROM fences""",
)
def fences(spark, sf):
    return rounded(iqr_fences(src.series(spark, sf), MEASURES), "low", "up")


@query(
    "mask_outliers",
    f"WITH {SERIES}, {FENCES}, {MASKED} SELECT id, time, click, view, purchase FROM masked",
)
def mask_outliers(spark, sf):
    rows = src.series(spark, sf).select("id", "time", *MEASURES)
    return c.mask_outliers(rows, iqr_fences(rows, MEASURES), MEASURES)


@query(
    "collapse_duplicates",
    f"""WITH {HOURLY} SELECT id, time, {avg("click")}, {avg("view")}, {avg("purchase")},
      max(stage) AS stage
    FROM hourly GROUP BY 1, 2
    HAVING coalesce(max(click), max(view), max(purchase), max(stage)) IS NOT NULL""",
)
def collapse_duplicates(spark, sf):
    out = s.collapse_duplicates(src.hourly_series(spark, sf), ["id", "time"], MEASURES, ["stage"])
    return rounded(out, *MEASURES)


@query(
    "nonzero_mean",
    f"""WITH {HOURLY} SELECT id,
      round(coalesce(avg(stage) FILTER (WHERE stage <> 0), 0), 6) AS stage_mean
    FROM hourly GROUP BY 1""",
)
def nonzero(spark, sf):
    rows = src.hourly_series(spark, sf)
    return rounded(rows.groupBy("id").agg(nonzero_mean("stage").alias("stage_mean")), "stage_mean")


@query(
    "first_nonnull",
    f"""WITH {SERIES} SELECT id, arg_min(click, time) FILTER (WHERE click IS NOT NULL) AS click,
      arg_min(stage, time) FILTER (WHERE stage IS NOT NULL) AS stage FROM series GROUP BY 1""",
)
def first_value(spark, sf):
    rows = src.series(spark, sf)
    return rows.groupBy("id").agg(
        first_nonnull("click", "time").alias("click"), first_nonnull("stage", "time").alias("stage")
    )


@query(
    "drop_empty",
    f"""WITH {HOURLY} SELECT id, time, click, view FROM hourly
    WHERE click IS NOT NULL OR view IS NOT NULL""",
)
def drop_empty(spark, sf):
    rows = src.hourly_series(spark, sf).select("id", "time", "click", "view")
    return c.drop_empty(rows, ["click", "view"])


@query(
    "impute_constant",
    f"""WITH {HOURLY} SELECT id, time, coalesce(click, 0) AS click, coalesce(stage, 0) AS stage
    FROM hourly""",
)
def impute_constant(spark, sf):
    rows = src.hourly_series(spark, sf).select("id", "time", "click", "stage")
    return c.impute_constant(rows, 0, ["click", "stage"])


@query(
    "stage_recode",
    f"""WITH {SERIES} SELECT id, time,
      (CASE WHEN stage IN (2, 3) THEN 1 ELSE stage END)::INT AS stage
    FROM series WHERE stage IS NOT NULL""",
)
def stage_recode(spark, sf):
    rows = src.series(spark, sf).select("id", "time", "stage").dropna(subset=["stage"])
    return c.recode(rows, "stage", d.STAGE_RECODE)


GRID_COLS = f"""id, slot, round(click, 6) AS click, round(view, 6) AS view,
      round(purchase, 6) AS purchase, stage"""


@query("resample_6h", f"WITH {GRID} SELECT {GRID_COLS} FROM grid")
def resample_6h(spark, sf):
    return rounded(grid_of(spark, sf), *MEASURES)


@query("resample_occupied", f"WITH {GRID} SELECT {GRID_COLS} FROM occupied")
def resample_occupied(spark, sf):
    out = s.resample(
        src.series(spark, sf), "id", "time", numeric=MEASURES, discrete=["stage"], fill_gaps=False
    )
    return rounded(out, *MEASURES)


def flag_sql(kind: str) -> str:
    """The two literal rules, as correlated EXISTS."""
    return f"""(EXISTS (SELECT 1 FROM intervals i WHERE i.id = grid.id AND i.kind = '{kind}'
        AND grid.slot BETWEEN i.starttime AND i.endtime)
      OR EXISTS (SELECT 1 FROM intervals i WHERE i.id = grid.id AND i.kind = '{kind}'
        AND (i.starttime BETWEEN grid.slot AND grid.slot + INTERVAL 6 HOUR - INTERVAL 1 SECOND
          OR i.endtime BETWEEN grid.slot AND grid.slot + INTERVAL 6 HOUR - INTERVAL 1 SECOND)
      ))::INT"""


@query(
    "flag_intervals",
    f"WITH {GRID}, {INTERVALS} SELECT id, slot, {flag_sql('signup')} AS treated FROM grid",
)
def flags(spark, sf):
    grid = stored(grid_of(spark, sf).select("id", "slot"))
    return flag_intervals(grid, src.intervals(spark, sf), "treated")


#: A third of the ids lives a century later, another one two; every second id's intervals have no end.
APART = "(id % 3)::INT * INTERVAL 36500 DAY"


@query(
    "flag_intervals_open",
    f"""WITH {GRID}, {INTERVALS}, far AS (SELECT id, slot + {APART} AS slot FROM grid),
    open AS (SELECT id, kind, starttime + {APART} AS starttime,
      CASE WHEN id % 2 = 0 AND starttime <= endtime THEN TIMESTAMP '9999-01-01'
        ELSE endtime + {APART} END AS endtime FROM intervals)
    SELECT id, slot, {flag_sql('signup').replace('FROM intervals i', 'FROM open i').replace('grid.', 'far.')} AS treated FROM far""",
)
def flags_open(spark, sf):
    apart = F.make_dt_interval((F.col("id") % 3 * 36500).cast("int"))
    grid = grid_of(spark, sf).select("id", (F.col("slot") + apart).alias("slot"))
    endless = (F.col("id") % 2 == 0) & (F.col("starttime") <= F.col("endtime"))
    end = F.when(endless, F.lit("9999-01-01").cast("timestamp_ntz")).otherwise(F.col("endtime") + apart)
    rows = src.intervals(spark, sf).select("id", (F.col("starttime") + apart).alias("starttime"), end.alias("endtime"))
    return flag_intervals(stored(grid), rows, "treated")


@query(
    "union_intervals",
    f"""WITH {INTERVALS} SELECT id, starttime, endtime FROM intervals WHERE kind = 'signup'
    UNION ALL SELECT id, starttime, endtime FROM intervals WHERE kind = 'error'""",
)
def unioned(spark, sf):
    return union_intervals(
        [src.intervals(spark, sf, "signup"), src.intervals(spark, sf, "error")]
    )


@query(
    "attach_static",
    f"""WITH {GRID} SELECT grid.id, slot, stage, (10 + id % 85)::DOUBLE AS age, id % 2 AS grp
    FROM grid""",
)
def attach_static(spark, sf):
    static = src.stay_detail(spark, sf).select(
        F.col("stay_id").alias("id"),
        F.col("admission_age").alias("age"),
        (F.col("stay_id") % 2).alias("grp"),
    )
    return s.attach_static(grid_of(spark, sf).select("id", "slot", "stage"), static, "id")


@query(
    "attach_flags_static",
    f"""WITH {GRID}, {INTERVALS} SELECT id, slot, stage, {flag_sql('signup')} AS ventilation,
      {flag_sql('error')} AS vasopressor, (10 + id % 85)::DOUBLE AS age FROM grid""",
)
def attach_flags_static(spark, sf):
    static = src.stay_detail(spark, sf).select(
        F.col("stay_id").alias("id"), F.col("admission_age").alias("age")
    )
    treatments = {
        "ventilation": src.intervals(spark, sf, "signup"),
        "vasopressor": src.intervals(spark, sf, "error"),
    }
    grid = grid_of(spark, sf).select("id", "slot", "stage")
    return f.attach_flags_static(grid, treatments, static, id="id", time="slot")


LABELLED = """labelled AS (
  SELECT * EXCLUDE (stage, future), (future > 0)::INT AS stage FROM (
    SELECT *, lead(coalesce(stage, 0), 8) OVER (PARTITION BY id ORDER BY slot) AS future
    FROM grid) WHERE future IS NOT NULL)"""


@query("shift_label", f"WITH {GRID}, {LABELLED} SELECT {GRID_COLS} FROM labelled")
def shift_label(spark, sf):
    return rounded(s.shift_label(grid_of(spark, sf), "id", "slot", "stage", 8, width="6 hours"), *MEASURES)


@query(
    "shift_label_by_time",
    f"""WITH {GRID} SELECT a.id, a.slot, coalesce(b.stage, 0) AS stage
    FROM occupied a JOIN occupied b ON b.id = a.id AND b.slot = a.slot + INTERVAL 48 HOUR""",
)
def shift_label_by_time(spark, sf):
    occupied = s.resample(
        src.series(spark, sf), "id", "time", discrete=["stage"], fill_gaps=False
    )
    return s.shift_label(occupied, "id", "slot", "stage", binary=False, horizon="48 hours")


@query(
    "neighbour_features",
    f"""WITH {GRID} SELECT id, slot, round(click, 6) AS click,
      round(lag(click, 1, 0) OVER w, 6) AS click_lag1,
      round(lead(click, 1, 0) OVER w, 6) AS click_lead1
    FROM grid WINDOW w AS (PARTITION BY id ORDER BY slot)""",
)
def neighbour_features(spark, sf):
    grid = grid_of(spark, sf).select("id", "slot", "click")
    out = s.neighbour_features(grid, "id", "slot", ["click"], width="6 hours")
    return rounded(out, "click", "click_lag1", "click_lead1")


@query(
    "neighbour_features_causal",
    f"""WITH {GRID} SELECT id, slot, round(click, 6) AS click,
      round(lag(click, 1, 0) OVER w, 6) AS click_lag1,
      round(lag(click, 2, 0) OVER w, 6) AS click_lag2
    FROM grid WINDOW w AS (PARTITION BY id ORDER BY slot)""",
)
def neighbour_features_causal(spark, sf):
    grid = grid_of(spark, sf).select("id", "slot", "click")
    out = s.neighbour_features(grid, "id", "slot", ["click"], lags=(0, 1, 2), width="6 hours")
    return rounded(out, "click", "click_lag1", "click_lag2")


CLEANED = f"""merged AS (
  SELECT id, time, avg(click) AS click, avg(view) AS view, avg(purchase) AS purchase,
    avg(rare) AS rare, max(stage) AS stage FROM masked GROUP BY 1, 2
  HAVING coalesce(max(click), max(view), max(purchase), max(rare), max(stage)) IS NOT NULL),
los AS (SELECT id, epoch_us(max(time) - min(time)) / 86400000000 AS los FROM merged GROUP BY 1),
inside AS (SELECT id FROM los WHERE los > 2 AND los <= (SELECT quantile_cont(los, 0.95) FROM los)),
complete AS (SELECT id FROM merged WHERE id IN (SELECT id FROM inside) GROUP BY 1
  HAVING ((count(click) > 0)::INT + (count(view) > 0)::INT + (count(purchase) > 0)::INT) / 3 >= 0.8),
kept AS (SELECT * FROM merged WHERE id IN (SELECT id FROM complete))"""

FENCES_ALL = FENCES.replace(_fence_sql(MEASURES), _fence_sql([*MEASURES, "rare"]))
MASKED_ALL = MASKED.replace(", rare,", f", {_masked_sql('rare')},")


@query(
    "clean_resample",
    f"""WITH {SERIES}, {FENCES_ALL}, {MASKED_ALL}, {CLEANED}, {grid_sql("kept")}
    SELECT {GRID_COLS.replace("slot,", "slot AS time,")} FROM grid""",
)
def clean_resample(spark, sf):
    grid, kept = f.clean_resample(src.series(spark, sf), "id", "time", "stage")
    return rounded(grid, *kept)
