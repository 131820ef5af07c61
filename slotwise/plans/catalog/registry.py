"""The registry of queries and the SQL texts they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise import dictionaries as d
from slotwise.plans import inputs as src

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can state it, its oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round double columns, because two engines sum in different orders."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def sql_list(values) -> str:
    return "[" + ", ".join(literal(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def sql_pick(values: list, index: str) -> str:
    return f"{sql_list(values)}[(({index}) % {len(values)})::INT + 1]"


def avg(col: str, alias: str | None = None) -> str:
    return f"round(avg({col}), 6) AS {alias or col}"


MEASURED = (
    "CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN -value ELSE value END"
)
STAGE = "least(floor(value / 40), 3)::INT"

WINDOWS = """windows AS (
  SELECT user_id, min(ts) + INTERVAL 1 DAY AS s, min(ts) + INTERVAL 21 DAY AS e
  FROM events GROUP BY user_id)"""

DETAIL = f"""{WINDOWS}, detail AS (
  SELECT user_id + 1000000 AS subject_id, user_id // 2 AS hadm_id, user_id AS stay_id,
    CASE WHEN user_id % 11 <> 0 THEN {sql_pick(['F', 'M'], 'user_id')} END AS gender,
    s - INTERVAL 1 DAY AS admittime, e AS dischtime,
    (10 + user_id % 85)::DOUBLE AS admission_age, {sql_pick(src.RACES, 'user_id')} AS race,
    (user_id % 40)::DOUBLE / 2 AS los_icu,
    CASE WHEN user_id % 37 <> 0 THEN s END AS icu_intime, e AS icu_outtime,
    user_id % 3 = 0 AS first_icu_stay
  FROM windows)"""

STAGES = f"""stages AS (
  SELECT user_id AS stay_id, ts AS charttime,
    CASE WHEN event_id % 5 <> 0 THEN value / 40 END AS creat,
    CASE WHEN event_id % 3 <> 0 THEN value * 0.5::DOUBLE END AS uo_rt_6hr,
    value * 0.25::DOUBLE AS uo_rt_12hr, value * 0.125::DOUBLE AS uo_rt_24hr,
    CASE WHEN event_id % 97 <> 0 THEN {STAGE} END AS aki_stage
  FROM events WHERE event_type = 'error')"""

PRIOR = """prior AS (
  SELECT d.stay_id, d.icu_intime, d.icu_outtime, d.first_icu_stay, k.charttime, k.aki_stage
  FROM detail d LEFT JOIN stages k ON d.stay_id = k.stay_id AND k.charttime < d.icu_intime
  WHERE k.aki_stage <> 0)"""

FIRST_COHORT = f"""{DETAIL}, {STAGES}, {PRIOR}, first_cohort AS (
  SELECT subject_id, hadm_id, stay_id, icu_intime, icu_outtime FROM detail d
  WHERE admission_age BETWEEN 18 AND 89 AND los_icu >= 2
    AND icu_intime IS NOT NULL AND icu_outtime IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM prior p WHERE p.stay_id = d.stay_id))"""

#: What later steps read: stays left after those with an unstaged row, or with no row, in the window are deleted.
COHORT = f"""{FIRST_COHORT}, in_window AS (
  SELECT c.stay_id, k.aki_stage FROM first_cohort c JOIN stages k ON k.stay_id = c.stay_id
    AND k.charttime >= c.icu_intime AND k.charttime <= c.icu_outtime),
cohort AS (
  SELECT * FROM first_cohort WHERE stay_id IN (SELECT stay_id FROM in_window WHERE aki_stage IS NOT NULL)
    AND stay_id NOT IN (SELECT stay_id FROM in_window WHERE aki_stage IS NULL))"""

ADMISSIONS = f"""admissions AS (
  SELECT DISTINCT user_id // 2 AS hadm_id,
    {sql_pick(src.ADMISSION_TYPES, '(user_id // 2)')} AS admission_type FROM events)"""

LABEVENTS = f"""labevents AS (
  SELECT user_id // 2 AS hadm_id, ts AS charttime,
    {sql_pick(src.LAB_CODES + [1], 'event_id')} AS itemid, {MEASURED} AS valuenum
  FROM events WHERE event_type IN ('view', 'signup'))"""

CHARTEVENTS = f"""chartevents AS (
  SELECT user_id // 2 AS hadm_id, user_id AS stay_id, ts AS charttime,
    {sql_pick(src.VITAL_CODES + [1], 'event_id')} AS itemid, {MEASURED} AS valuenum
  FROM events WHERE event_type IN ('click', 'purchase'))"""


def _lab_case(out) -> str:
    return " ".join(
        f"WHEN itemid IN {sql_in(codes)} THEN {out(name, high)}"
        for name, codes, high in d.LAB_CONCEPTS
    )


LABELLED_LABS = f"""labs AS (
  SELECT hadm_id, charttime, CASE {_lab_case(lambda n, h: literal(n))} END AS concept,
    CASE {_lab_case(lambda n, h: f"CASE WHEN valuenum <= {h} THEN valuenum END")} END AS v
  FROM labevents WHERE valuenum > 0
    AND itemid IN {sql_in(src.LAB_CODES)})"""


def _vital_case() -> str:
    rules = [
        f"WHEN itemid IN {sql_in(codes)} AND valuenum > {low}"
        + (f" AND valuenum < {high}" if high is not None else "")
        + f" THEN '{name}'"
        for name, codes, low, high in d.VITAL_CONCEPTS
    ]
    rules.append(
        f"WHEN itemid IN {sql_in(d.SPO2_CODES)} AND valuenum > 0 AND valuenum <= 100 THEN 'spo2'"
    )
    rules.append(
        f"WHEN itemid IN {sql_in(d.FAHRENHEIT_CODES)} AND valuenum > 70 AND valuenum < 120 "
        "THEN 'tempc'"
    )
    return " ".join(rules)


LABELLED_VITALS = f"""vitals AS (
  SELECT stay_id, charttime, CASE {_vital_case()} END AS concept,
    CASE WHEN itemid IN {sql_in(d.FAHRENHEIT_CODES)} THEN (valuenum - 32) / 1.8::DOUBLE
      ELSE valuenum END AS v
  FROM chartevents WHERE itemid IN {sql_in(src.VITAL_CODES)})"""

LAB_NAMES = d.concepts(d.lab_rules())


def pivot_columns(names: list[str], fn: str = "avg", suffix: str = "_mean") -> str:
    return ", ".join(
        f"round({fn}(v) FILTER (WHERE concept = '{n}'), 6) AS {n}{suffix}" for n in names
    )


SERIES = f"""series AS (
  SELECT user_id AS id, ts AS time,
    CASE WHEN event_type = 'click' THEN value END AS click,
    CASE WHEN event_type = 'view' THEN value END AS view,
    CASE WHEN event_type = 'purchase' THEN value END AS purchase,
    CASE WHEN event_type = 'signup' AND user_id % 3 = 0 THEN value END AS rare,
    CASE WHEN event_type = 'error' THEN {STAGE} END AS stage
  FROM events)"""

HOURLY = SERIES.replace("ts AS time", "date_trunc('hour', ts) AS time").replace(
    "series AS", "hourly AS", 1
)


def grid_sql(source: str = "series", name: str = "grid") -> str:
    return f"""occupied AS (
  SELECT id, time_bucket(INTERVAL '6 hours', time) AS slot, avg(click) AS click,
    avg(view) AS view, avg(purchase) AS purchase, max(stage) AS stage
  FROM {source} GROUP BY 1, 2),
slots AS (
  SELECT id, unnest(generate_series(min(slot), max(slot), INTERVAL 6 HOUR)) AS slot
  FROM occupied GROUP BY id),
{name} AS (
  SELECT slots.id, slots.slot, click, view, purchase, stage
  FROM slots LEFT JOIN occupied USING (id, slot))"""


GRID = f"{SERIES}, {grid_sql()}"

INTERVALS = """intervals AS (
  SELECT user_id AS id, event_type AS kind,
    CASE WHEN event_id % 50 = 0 THEN ts + (event_id % 30)::INT * INTERVAL 1 HOUR ELSE ts END
      AS starttime,
    CASE WHEN event_id % 50 = 0 THEN ts ELSE ts + (event_id % 30)::INT * INTERVAL 1 HOUR END
      AS endtime
  FROM events)"""

SCORES = """scores AS (
  SELECT user_id AS id, ts AS time, ((event_id * 7919) % 1000)::DOUBLE / 1000 AS p,
    (value > 50)::INT AS y, event_type AS kind FROM events)"""
