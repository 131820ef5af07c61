"""Queries that split, sample, scale and shape series, and the classifiers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from slotwise.dictionaries import RACE_GROUPS
from slotwise.functions.ranking import shuffled_rank
from slotwise.operators import encode as n
from slotwise.operators import model as m
from slotwise.operators.quality import max_group_size, positive_ratio
from slotwise.operators.series import neighbour_features, shift_label
from slotwise.plans import inputs as src
from slotwise.plans import features as f
from slotwise.plans.catalog.events import lab_pivot, staged_cohort, vital_pivot
from slotwise.plans.catalog.registry import ADMISSIONS, COHORT, GRID, SERIES, query, rounded
from slotwise.plans.catalog.series import (
    BUILT,
    LABELLED,
    LABS_LEFT,
    MEASURES,
    VITALS_LEFT,
    build_ctes,
    grid_of,
)
from slotwise.plans.cohort import stage_series, static_detail
from slotwise.plans.learning import supervised_set
from slotwise.session import stored

BUCKET = "((id * 7919 + 8888) % 1000)"
SPLIT = f"CASE WHEN {BUCKET} < 800 THEN 'train' WHEN {BUCKET} < 900 THEN 'val' ELSE 'test' END"
FILLED = f"""{GRID}, {LABELLED}, filled AS (
  SELECT id, slot, stage, coalesce(click, 0) AS click, coalesce(view, 0) AS view,
    coalesce(purchase, 0) AS purchase, {SPLIT} AS split FROM labelled)"""


def labelled_of(spark, sf):
    return shift_label(grid_of(spark, sf), "id", "slot", "stage", 8, width="6 hours")


@query(
    "split_by_id",
    f"WITH {SERIES} SELECT id, {SPLIT} AS split, count(*) AS n FROM series GROUP BY 1, 2",
)
def split_by_id(spark, sf):
    split = n.split_by_id(src.series(spark, sf), "id", fn="arithmetic")
    return split.groupBy("id", "split").agg(F.count("*").alias("n"))


@query("get_split", f"WITH {SERIES} SELECT id, time FROM series WHERE {SPLIT} = 'val'")
def get_split(spark, sf):
    split = n.split_by_id(src.series(spark, sf).select("id", "time"), "id", fn="arithmetic")
    return n.get_split(split, "val")


@query(
    "positive_ratio_by_split",
    f"""WITH {FILLED}, e AS (SELECT id, split, max(stage) AS y FROM filled GROUP BY 1, 2)
    SELECT split, count(*) AS n_entities, sum(y)::BIGINT AS n_positive,
      round(avg(y::DOUBLE), 6) AS positive_ratio FROM e GROUP BY 1""",
)
def positive_ratio_by_split(spark, sf):
    split = n.split_by_id(labelled_of(spark, sf), "id", fn="arithmetic")
    return rounded(positive_ratio(split, "id", "stage", by="split"), "positive_ratio")


EVENT_ORDER = "(event_id * 7919 + 42) % 1000, event_id"


@query(
    "undersample",
    f"""WITH l AS (SELECT event_id, user_id, (value > 100)::INT AS y FROM events)
    SELECT * FROM l WHERE y = 1
    UNION ALL SELECT * EXCLUDE (r) FROM (
      SELECT *, row_number() OVER (ORDER BY {EVENT_ORDER}) AS r FROM l WHERE y = 0)
      WHERE r <= 100""",
)
def undersample(spark, sf):
    rows = src.events(spark, sf).select(
        "event_id", "user_id", (F.col("value") > 100).cast("int").alias("y")
    )
    return n.undersample(rows, "y", 100, ["event_id"], fn="arithmetic")


@query(
    "undersample_by_hash",
    """WITH l AS (SELECT event_id, user_id, (value > 100)::INT AS y, (event_id * 2654435761 + 42) % 4294967296 AS h FROM events)
    SELECT event_id, user_id, y FROM l WHERE y = 1
    UNION ALL SELECT event_id, user_id, y FROM (
      SELECT *, row_number() OVER (ORDER BY h, event_id) AS r FROM l WHERE y = 0)
      WHERE r <= 500""",
)
def undersample_by_hash(spark, sf):
    rows = src.events(spark, sf).select(
        "event_id", "user_id", (F.col("value") > 100).cast("int").alias("y")
    )
    return n.undersample(rows, "y", 500, ["event_id"], fn="multiplicative")


@query(
    "undersample_fraction",
    """WITH l AS (SELECT event_id, user_id, (value > 100)::INT AS y FROM events)
    SELECT * FROM l WHERE y = 1 OR (event_id * 7919 + 42) % 1000 < 50""",
)
def undersample_fraction(spark, sf):
    rows = src.events(spark, sf).select(
        "event_id", "user_id", (F.col("value") > 100).cast("int").alias("y")
    )
    return n.undersample_fraction(rows, "y", 0.05, ["event_id"], fn="arithmetic")


@query(
    "undersample_cohort",
    f"""WITH l AS (SELECT event_id, user_id, (value > 100)::INT AS y FROM events), u AS (
      SELECT user_id, y FROM l WHERE y = 1
      UNION ALL SELECT user_id, y FROM (
        SELECT *, row_number() OVER (ORDER BY {EVENT_ORDER}) AS r FROM l WHERE y = 0)
      WHERE r <= 1000), e AS (SELECT user_id, max(y) AS y FROM u GROUP BY 1)
    SELECT count(*) AS n_entities, sum(y)::BIGINT AS n_positive,
      round(avg(y::DOUBLE), 6) AS positive_ratio FROM e""",
)
def undersample_cohort(spark, sf):
    rows = src.events(spark, sf).select(
        "event_id", "user_id", (F.col("value") > 100).cast("int").alias("y")
    )
    sampled = n.undersample(rows, "y", 1000, ["event_id"], fn="arithmetic")
    return rounded(positive_ratio(sampled, "user_id", "y"), "positive_ratio")


@query("shuffle_rows", "SELECT event_id, user_id FROM events")
def shuffle_rows(spark, sf):
    return n.shuffle_rows(src.events(spark, sf).select("event_id", "user_id"), ["event_id"])


@query(
    "shuffled_rank",
    f"SELECT event_id, row_number() OVER (ORDER BY {EVENT_ORDER}) - 1 AS rank FROM events",
)
def ranked(spark, sf):
    rows = src.events(spark, sf).select("event_id")
    return shuffled_rank(rows, ["event_id"], 42, fn="arithmetic")


@query(
    "one_hot",
    """SELECT event_id, """
    + ", ".join(
        f"(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END)::INT AS event_type_{k}"
        for k in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events",
)
def one_hot(spark, sf):
    return n.one_hot(src.events(spark, sf).select("event_id", "event_type"))


@query(
    "static_features",
    f"""WITH {COHORT}, {ADMISSIONS}
    SELECT d.stay_id, admission_age,
      (CASE WHEN gender = 'F' THEN 1 ELSE 0 END)::INT AS gender_F,
      (CASE WHEN gender = 'M' THEN 1 ELSE 0 END)::INT AS gender_M,
      (CASE WHEN race = 'OTHER' THEN 1 ELSE 0 END)::INT AS race_UNKNOWN,
      (CASE WHEN race = 'PORTUGUESE' THEN 1 ELSE 0 END)::INT AS race_PORTUGUESE,
      (CASE WHEN admission_type = 'URGENT' THEN 1 ELSE 0 END)::INT AS admission_type_URGENT
    FROM detail d LEFT JOIN admissions a ON a.hadm_id = d.hadm_id
    WHERE d.stay_id IN (SELECT stay_id FROM cohort)""",
)
def static_features(spark, sf):
    return n.static_features(
        src.stay_detail(spark, sf),
        src.admissions(spark, sf),
        staged_cohort(spark, sf),
        "stay_id",
        "hadm_id",
        groups={"race": RACE_GROUPS},
        columns=["admission_age", "gender", "race", "admission_type"],
        categories={
            "gender": ["F", "M"], "race": ["UNKNOWN", "PORTUGUESE"], "admission_type": ["URGENT"],
        },
    )


def _stat_sql(col: str) -> str:
    return f"""SELECT '{col}' AS feature, sum({col}) / any_value(n) AS mean,
      sqrt(greatest((sum({col} * {col}) / any_value(n)) - (sum({col}) / any_value(n)) ** 2, 0))
        AS scale FROM train, padded"""


SCALER = f"""train AS (SELECT * FROM filled WHERE split = 'train'),
padded AS (SELECT (count(*) * max(k))::DOUBLE AS n FROM (
  SELECT count(*) AS k FROM train GROUP BY id)),
stats AS ({" UNION ALL ".join(_stat_sql(x) for x in MEASURES)})"""


@query(
    "scale_features",
    f"""WITH {FILLED}, {SCALER}
    SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM stats""",
)
def scale_features(spark, sf):
    rows = n.split_by_id(labelled_of(spark, sf), "id", fn="arithmetic")
    stats = n.fit_scaler(n.get_split(rows, "train"), MEASURES, "id")
    return rounded(stats, "mean", "scale")


def _scaled(col: str) -> str:
    return (
        f"round(({col} - (SELECT mean FROM stats WHERE feature = '{col}'))"
        f" / (SELECT scale FROM stats WHERE feature = '{col}'), 6) AS {col}"
    )


@query(
    "supervised_set",
    f"""WITH {FILLED}, {SCALER}
    SELECT id, slot, stage, split, {", ".join(_scaled(x) for x in MEASURES)} FROM filled""",
)
def supervised(spark, sf):
    data = supervised_set(
        grid_of(spark, sf), "id", "slot", "stage", MEASURES, fn="arithmetic", width="6 hours"
    )
    return rounded(data.rows, *MEASURES)


#: The longest series of the training part: the length that all sequences get.
LONGEST = """longest AS (SELECT max(n)::INT AS maxlen FROM (
  SELECT count(*) AS n FROM filled WHERE split = 'train' GROUP BY id))"""
PADDED = f"""{LONGEST}, steps AS (
  SELECT id, maxlen - row_number() OVER (PARTITION BY id ORDER BY slot DESC) AS step,
    click, view, purchase, stage FROM filled, longest),
padded_steps AS (
  SELECT i.id, p.step::INT AS step, coalesce(click, 0) AS click, coalesce(view, 0) AS view,
    coalesce(purchase, 0) AS purchase, coalesce(stage, 0)::INT AS label
  FROM (SELECT DISTINCT id FROM filled) i CROSS JOIN (SELECT unnest(range(0, maxlen)) AS step FROM longest) p
  LEFT JOIN steps s ON s.id = i.id AND s.step = p.step)"""


def longest_train(labelled) -> int:
    """Steps of the longest training series."""
    train = n.get_split(n.split_by_id(labelled, "id", fn="arithmetic"), "train")
    return max_group_size(train, "id").first()["max_size"] or 0


def _padded(spark, sf):
    labelled = stored(labelled_of(spark, sf))
    return n.pad_sequences(labelled, "id", "slot", MEASURES, longest_train(labelled), "stage")


@query(
    "pad_sequences",
    f"""WITH {FILLED}, {PADDED} SELECT id, step, round(click, 6) AS click, round(view, 6) AS view,
      round(purchase, 6) AS purchase, label FROM padded_steps""",
)
def pad_sequences(spark, sf):
    padded = _padded(spark, sf)
    steps = padded.select("id", F.posexplode(F.arrays_zip("features", "labels")).alias("step", "z"))
    out = steps.select(
        "id",
        "step",
        *[F.col("z.features")[i].alias(c) for i, c in enumerate(MEASURES)],
        F.col("z.labels").alias("label"),
    )
    return rounded(out, *MEASURES)


@query(
    "one_hot_label",
    f"""WITH {FILLED}, {PADDED}
    SELECT id, step, (1 - label)::INT AS class_0, label AS class_1 FROM padded_steps""",
)
def one_hot_label(spark, sf):
    padded = _padded(spark, sf)
    pairs = padded.select("id", F.posexplode(n.one_hot_labels("labels")).alias("step", "pair"))
    return pairs.select(
        "id", "step", F.col("pair")[0].alias("class_0"), F.col("pair")[1].alias("class_1")
    )


@query(
    "sequence_shapes",
    f"""WITH {FILLED}, longest AS (SELECT max(n)::INT AS steps FROM (
      SELECT count(*) AS n FROM filled WHERE split = 'train' GROUP BY id))
    SELECT split, steps, 3::INT AS channels, steps AS label_steps,
      count(DISTINCT id) AS n_ids FROM filled, longest GROUP BY 1, 2, 3, 4""",
)
def sequence_shapes(spark, sf):
    data = supervised_set(
        grid_of(spark, sf), "id", "slot", "stage", MEASURES, fn="arithmetic", width="6 hours"
    )
    parts = [
        data.sequences(name).select(
            F.lit(name).alias("split"),
            F.size("features").alias("steps"),
            F.size(F.col("features")[0]).alias("channels"),
            F.size("labels").alias("label_steps"),
        )
        for name in ("train", "val", "test")
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("split", "steps", "channels", "label_steps").agg(
        F.count("*").alias("n_ids")
    )


def _fit_sql(name: str, source: str, feats: list[str], l2: float = 1.0, sweeps: int = 60) -> str:
    """Weights of the logistic optimum by Newton steps in one coordinate after the other."""
    d = len(feats) + 1
    return f"""{name}_x AS (SELECT [1.0::DOUBLE, {", ".join(f"{c}::DOUBLE" for c in feats)}] AS x, stage AS y FROM {source}),
{name} AS (
  SELECT 0 AS k, list_transform(range(0, {d}), lambda i: 0.0::DOUBLE) AS w
  UNION ALL SELECT k + 1, list_transform(range(0, {d}), lambda i: w[i + 1] - CASE WHEN i = k % {d} THEN step ELSE 0 END)
  FROM (
    SELECT k, any_value(w) AS w, (sum((p - y) * x[k % {d} + 1]) + any_value(ridge * w[k % {d} + 1]))
      / (sum(p * (1 - p) * x[k % {d} + 1] ** 2) + any_value(ridge)) AS step
    FROM (SELECT k, w, x, y, 1 / (1 + exp(-list_dot_product(w, x))) AS p,
        CASE WHEN k % {d} = 0 THEN 0 ELSE {l2} END AS ridge
      FROM {name}, {name}_x WHERE k < {d * sweeps}) GROUP BY k)),
{name}_w AS (SELECT w FROM {name} WHERE k = {d * sweeps})"""


def _scored_sql(name: str, feats: list[str]) -> str:
    return f"1 / (1 + exp(-list_dot_product((SELECT w FROM {name}_w), [1.0::DOUBLE, {', '.join(feats)}])))"


def _scaled_exact(col: str) -> str:
    stat = f"FROM stats WHERE feature = '{col}'"
    return f"({col} - (SELECT mean {stat})) / (SELECT CASE WHEN scale > 0 THEN scale ELSE 1 END {stat}) AS {col}"


STEPS = f"""{FILLED}, {SCALER}, scaled AS (
  SELECT id, slot, stage, split, {", ".join(_scaled_exact(x) for x in MEASURES)} FROM filled)"""
NEAR = m.neighbour_names(MEASURES, (1, 0, -1))
AROUND = ", ".join(f"lag({x}, 1, 0) OVER o AS {x}_lag1, lead({x}, 1, 0) OVER o AS {x}_lead1" for x in MEASURES)
NEIGHBOURS = f"wide AS (SELECT *, {AROUND} FROM scaled WINDOW o AS (PARTITION BY id ORDER BY slot))"
FIT_STEP = f"step_train AS (SELECT * FROM scaled WHERE split = 'train'), {_fit_sql('step_fit', 'step_train', MEASURES)}"
FIT_NEAR = f"near_train AS (SELECT * FROM wide WHERE split = 'train'), {_fit_sql('near_fit', 'near_train', NEAR)}"


def _fitted(spark, sf, fit):
    data = supervised_set(
        grid_of(spark, sf), "id", "slot", "stage", MEASURES, fn="arithmetic", width="6 hours"
    )
    return data, fit(data.split("train"))


def _fit_step(train):
    return m.fit_step_classifier(train, MEASURES, "stage", hidden=None)


def _fit_near(train):
    return m.fit_neighbour_classifier(train, "id", "slot", MEASURES, "stage", width="6 hours")


@query(
    "step_classifier",
    f"""WITH RECURSIVE {STEPS}, {FIT_STEP}
    SELECT id, slot, stage, round({_scored_sql('step_fit', MEASURES)}, 6) AS p FROM scaled WHERE split = 'test'""",
)
def step_classifier(spark, sf):
    data, model = _fitted(spark, sf, _fit_step)
    return rounded(m.score(model, data.split("test")).select("id", "slot", "stage", "p"), "p")


@query(
    "neighbour_classifier",
    f"""WITH RECURSIVE {STEPS}, {NEIGHBOURS}, {FIT_NEAR}
    SELECT id, slot, stage, round({_scored_sql('near_fit', NEAR)}, 6) AS p FROM wide WHERE split = 'test'""",
)
def neighbour_classifier(spark, sf):
    data, model = _fitted(spark, sf, _fit_near)
    wide = neighbour_features(data.split("test"), "id", "slot", MEASURES, width="6 hours")
    return rounded(m.score(model, wide).select("id", "slot", "stage", "p"), "p")


def _auc_sql(p: str) -> str:
    """Area by mid-ranks over the validation split."""
    return f"""(SELECT (sum(mid) FILTER (WHERE stage = 1) - sum(stage)::DOUBLE * (sum(stage) + 1) / 2)
      / nullif(sum(stage)::DOUBLE * sum(1 - stage), 0) FROM (
        SELECT stage, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0::DOUBLE AS mid
        FROM both_scored WHERE split = 'val'))"""


@query(
    "select_by_auc",
    f"""WITH RECURSIVE {STEPS}, {NEIGHBOURS}, {FIT_STEP}, {FIT_NEAR}, both_scored AS (
      SELECT id, slot, stage, split, {_scored_sql('step_fit', MEASURES)} AS step, {_scored_sql('near_fit', NEAR)} AS near FROM wide),
    areas AS (SELECT coalesce({_auc_sql('step')}, 0) AS step_area, coalesce({_auc_sql('near')}, 0) AS near_area)
    SELECT CASE WHEN near_area > step_area THEN 'near' ELSE 'step' END AS model, id, slot, stage,
      round(CASE WHEN near_area > step_area THEN near ELSE step END, 6) AS p
    FROM both_scored, areas WHERE split = 'test'""",
)
def select_by_auc(spark, sf):
    data, step = _fitted(spark, sf, _fit_step)

    def wide(split):
        return neighbour_features(data.split(split), "id", "slot", MEASURES, width="6 hours")

    models = {"step": step, "near": _fit_near(data.split("train"))}
    best, _ = m.select_by_auc(models, wide("val"), "stage")
    scored = m.score(models[best], wide("test"))
    out = scored.select(F.lit(best).alias("model"), "id", "slot", "stage", "p")
    return rounded(out, "p")


def flagged_stays(spark, sf):
    """The cohort's grid with the flags of all five treatments and static attributes."""
    detail = src.stay_detail(spark, sf)
    cohort = staged_cohort(spark, sf)
    stages = stage_series(cohort, src.stages(spark, sf))
    series = stored(
        f.build_series(vital_pivot(spark, sf, cohort), lab_pivot(spark, sf, cohort=cohort), stages)
    )
    grid, _ = f.clean_resample(series, min_coverage=0.3, min_integrity=0.2)
    treatments = {
        "ventilation": src.intervals(spark, sf, "error").withColumnRenamed("id", "stay_id"),
        "sedative": f.order_intervals(src.inputevents(spark, sf)),
        "vasopressor": src.vasopressors(spark, sf),
        "rrt": f.renal_intervals(
            cohort,
            src.renal_chartevents(spark, sf),
            src.inputevents(spark, sf),
            src.datetimeevents(spark, sf),
            src.procedureevents(spark, sf),
        ),
        "crrt": src.continuous_renal(spark, sf),
    }
    static = f.encode_static(static_detail(detail, src.admissions(spark, sf), cohort))
    return f.attach_flags_static(grid, treatments, static)


#: Measures of the cohort's wide series.
WHOLE = [*VITALS_LEFT, *LABS_LEFT, "glucose", "creatinine", "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr"]


def _exact(sql: str) -> str:
    """Shared SQL without its rounding, as the steps in between don't round."""
    return re.sub(r"round\((.+?), 6\)", r"\1", sql)


def _inside_fences(col: str) -> str:
    q1, q3 = (f"(SELECT quantile_cont({col}, {p}) FROM built)" for p in (0.25, 0.75))
    spread = f"1.5 * ({q3} - {q1})"
    return f"CASE WHEN {col} < {q1} - {spread} OR {col} > {q3} + {spread} THEN NULL ELSE {col} END AS {col}"


#: The way from the cohort to the labelled grid.  Treatment flags and static columns add no row and drop none.
LABELLED_STAYS = f"""{_exact(build_ctes("k.charttime"))}, built AS ({_exact(BUILT)}),
masked AS (SELECT stay_id, charttime, aki_stage, {", ".join(map(_inside_fences, WHOLE))} FROM built),
merged AS (
  SELECT stay_id, charttime, max(aki_stage) AS stage, {", ".join(f"avg({x}) AS {x}" for x in WHOLE)}
  FROM masked GROUP BY 1, 2 HAVING coalesce({", ".join(f"max({x})" for x in WHOLE)}, max(aki_stage)) IS NOT NULL),
los AS (SELECT stay_id, epoch_us(max(charttime) - min(charttime)) / 86400000000 AS los FROM merged GROUP BY 1),
inside AS (SELECT stay_id FROM los WHERE los > 2 AND los <= (SELECT quantile_cont(los, 0.95) FROM los)),
presence AS (
  SELECT stay_id, unnest([{", ".join(f"'{x}'" for x in WHOLE)}]) AS feature,
    unnest([{", ".join(f"(count({x}) > 0)::INT" for x in WHOLE)}]) AS seen
  FROM merged WHERE stay_id IN (SELECT stay_id FROM inside) GROUP BY 1),
covered AS (SELECT feature FROM presence GROUP BY 1 HAVING avg(seen) >= 0.3),
complete AS (
  SELECT stay_id FROM presence WHERE feature IN (SELECT feature FROM covered) GROUP BY 1 HAVING avg(seen) >= 0.2),
occupied AS (
  SELECT stay_id AS id, time_bucket(INTERVAL '6 hours', charttime) AS slot, max(stage) AS stage
  FROM merged WHERE stay_id IN (SELECT stay_id FROM complete) GROUP BY 1, 2),
slots AS (
  SELECT id, unnest(generate_series(min(slot), max(slot), INTERVAL 6 HOUR)) AS slot FROM occupied GROUP BY id),
grid AS (SELECT slots.id, slots.slot, stage FROM slots LEFT JOIN occupied USING (id, slot)), {LABELLED}"""


@query(
    "cohort_to_supervised",
    f"""WITH {LABELLED_STAYS}, {ADMISSIONS}, attributes AS (
      SELECT gender, race, admission_type FROM detail LEFT JOIN admissions USING (hadm_id)
      WHERE stay_id IN (SELECT stay_id FROM cohort))
    SELECT {SPLIT} AS split, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(stage)::BIGINT AS n_positive,
      ((SELECT count(*) FROM covered) + 5 + 1 + (SELECT count(DISTINCT gender) + count(DISTINCT race)
        + count(DISTINCT admission_type) FROM attributes))::INT AS n_features
    FROM labelled GROUP BY 1""",
)
def cohort_to_supervised(spark, sf):
    """The whole way: cohort, measurements, grid, treatment flags, static attributes, labels.

    One row per split with its size and the number of features.
    """
    data = supervised_set(flagged_stays(spark, sf), fn="arithmetic", width="6 hours")
    return data.rows.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("stay_id").alias("n_ids"),
        F.sum("aki_stage").alias("n_positive"),
        F.lit(len(data.features)).alias("n_features"),
    )
