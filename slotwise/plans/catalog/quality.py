"""Queries that profile and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.ranking import exact_quantiles
from slotwise.operators import cleaning as c
from slotwise.operators import quality as q
from slotwise.plans import inputs as src
from slotwise.plans.catalog.registry import SERIES, query, rounded

FEATURES = ["click", "view", "purchase", "rare"]
LOS = f"""{SERIES}, los AS (
  SELECT id, epoch_us(max(time) - min(time)) / 86400000000 AS los FROM series GROUP BY 1)"""
BOUND = "(SELECT quantile_cont(los, 0.95) FROM los)"


@query("length_of_stay", f"WITH {LOS} SELECT id, round(los, 6) AS los FROM los")
def length_of_stay(spark, sf):
    return rounded(q.length_of_stay(src.series(spark, sf), "id", "time"), "los")


@query(
    "los_filter",
    f"""WITH {LOS} SELECT id, time FROM series
    WHERE id IN (SELECT id FROM los WHERE los > 2 AND los <= {BOUND})""",
)
def los_filter(spark, sf):
    return q.los_filter(src.series(spark, sf).select("id", "time"), "id", "time")


@query(
    "los_counts",
    f"""WITH {LOS} SELECT round({BOUND}, 6) AS bound, round(min(los), 6) AS los_min,
      round(max(los), 6) AS los_max,
      count(*) FILTER (WHERE los > 2 AND los <= {BOUND}) AS n_inside,
      count(*) FILTER (WHERE NOT (los > 2 AND los <= {BOUND})) AS n_outside FROM los""",
)
def los_counts(spark, sf):
    los = q.length_of_stay(src.series(spark, sf), "id", "time")
    return rounded(q.los_counts(los), "bound", "los_min", "los_max")


@query(
    "los_histogram",
    f"""WITH {LOS}, b AS (SELECT least(floor(los)::BIGINT, ceil({BOUND})::BIGINT - 1) AS bin
      FROM los)
    SELECT bin, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM los), 2)
      AS percent FROM b GROUP BY 1""",
)
def los_histogram(spark, sf):
    los = q.length_of_stay(src.series(spark, sf), "id", "time")
    cap = q.quantile(los, "los", 0.95).select(F.ceil("value").alias("cap"))
    return q.histogram(los, "los", 1.0, cap)


@query(
    "exact_quantiles",
    " UNION ALL ".join(
        f"SELECT '{x}' AS feature, round(quantile_cont({x}, 0.05), 6) AS q0, "
        f"round(quantile_cont({x}, 0.5), 6) AS q1, round(quantile_cont({x}, 0.95), 6) AS q2 "
        "FROM lineitem"
        for x in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def quantiles(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(exact_quantiles(items, cols, [0.05, 0.5, 0.95]), "q0", "q1", "q2")


PRESENCE = "presence AS (SELECT id, " + ", ".join(
    f"(count({x}) > 0)::INT AS {x}" for x in FEATURES
) + " FROM series GROUP BY 1)"
COVERAGE = "coverage AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, avg({x}::DOUBLE) AS coverage FROM presence" for x in FEATURES
) + ")"


@query(
    "feature_coverage",
    f"""WITH {SERIES}, {PRESENCE}, {COVERAGE}
    SELECT feature, round(coverage, 6) AS coverage FROM coverage""",
)
def feature_coverage(spark, sf):
    return rounded(q.feature_coverage(src.series(spark, sf), "id", FEATURES), "coverage")


@query("keep_covered", f"WITH {SERIES} SELECT id, time, click, view, purchase, stage FROM series")
def keep_covered(spark, sf):
    kept, _ = q.keep_covered(src.series(spark, sf), "id", FEATURES, 0.8)
    return kept


@query(
    "info_integrity",
    f"""WITH {SERIES}, {PRESENCE}
    SELECT id, round((click + view + purchase + rare)::DOUBLE / 4, 6) AS integrity
    FROM presence""",
)
def info_integrity(spark, sf):
    return rounded(q.info_integrity(src.series(spark, sf), "id", FEATURES), "integrity")


@query(
    "keep_complete",
    f"""WITH {SERIES}, {PRESENCE} SELECT id, time FROM series WHERE id IN (
      SELECT id FROM presence WHERE (click + view + purchase + rare)::DOUBLE / 4 >= 0.8)""",
)
def keep_complete(spark, sf):
    return q.keep_complete(src.series(spark, sf), "id", FEATURES, 0.8).select("id", "time")


@query(
    "coverage_compare",
    f"""WITH {SERIES}, {PRESENCE}, {COVERAGE}
    SELECT feature, round(coverage, 6) AS origin,
      CASE WHEN coverage >= 0.8 THEN round(coverage, 6) END AS after FROM coverage""",
)
def coverage_compare(spark, sf):
    before = q.feature_coverage(src.series(spark, sf), "id", FEATURES)
    after = before.filter(F.col("coverage") >= 0.8)
    both = q.compare_reports(
        before.withColumnRenamed("coverage", "origin"),
        after.withColumnRenamed("coverage", "after"),
        "feature",
    )
    return rounded(both, "origin", "after")


@query("value_counts", f"WITH {SERIES} SELECT stage, count(*) AS n FROM series GROUP BY 1")
def value_counts(spark, sf):
    return q.value_counts(src.series(spark, sf), "stage")


@query(
    "n_unique",
    """SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type,
      count(DISTINCT value) AS value FROM events""",
)
def n_unique(spark, sf):
    return q.n_unique(src.events(spark, sf), ["user_id", "event_type", "value"])


def _profile_sql(col: str, dtype: str) -> str:
    return f"""SELECT '{col}' AS feature, '{dtype}' AS dtype, count(*) AS n_rows,
      count(*) FILTER (WHERE {col} IS NULL) AS n_null, round(avg({col}), 6) AS mean,
      round(stddev_samp({col}), 6) AS std, min({col})::DOUBLE AS min, max({col})::DOUBLE AS max,
      round(quantile_cont({col}, 0.25), 6) AS q25, round(quantile_cont({col}, 0.5), 6) AS q50,
      round(quantile_cont({col}, 0.75), 6) AS q75 FROM series"""


@query(
    "profile",
    f"""WITH {SERIES} {_profile_sql('click', 'double')}
    UNION ALL {_profile_sql('rare', 'double')} UNION ALL {_profile_sql('stage', 'int')}""",
)
def profile(spark, sf):
    out = q.profile(src.series(spark, sf), ["click", "rare", "stage"])
    return rounded(out, "mean", "std", "q25", "q50", "q75")


@query(
    "count_negative",
    """SELECT count(*) FILTER (WHERE o_totalprice - 100000 < 0) AS margin,
      count(*) FILTER (WHERE o_custkey - 500 < 0) AS shifted FROM orders""",
)
def count_negative(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        (F.col("o_totalprice") - 100000).alias("margin"), (F.col("o_custkey") - 500).alias("shifted")
    )
    return c.count_negative(orders, ["margin", "shifted"])


@query(
    "null_guard_rows",
    f"WITH {SERIES} SELECT id, time, click FROM series WHERE click IS NOT NULL",
)
def null_guard_rows(spark, sf):
    rows = src.series(spark, sf).select("id", "time", "click")
    return c.null_guard(rows, ["click"], "drop_rows")


@query(
    "null_guard_feature",
    f"""WITH {SERIES} SELECT id, time, click FROM series
    WHERE NOT EXISTS (SELECT 1 FROM series WHERE click IS NULL)""",
)
def null_guard_feature(spark, sf):
    rows = src.series(spark, sf).select("id", "time", "click")
    return c.null_guard(rows, ["click"], "skip_feature")


@query(
    "entity_label",
    f"WITH {SERIES} SELECT id, max(stage) AS stage FROM series GROUP BY 1",
)
def entity_label(spark, sf):
    return q.entity_label(src.series(spark, sf), "id", "stage")


@query(
    "positive_ratio",
    f"""WITH {SERIES}, e AS (SELECT id, max((stage > 2)::INT) AS y FROM series GROUP BY 1)
    SELECT count(*) AS n_entities, sum(y)::BIGINT AS n_positive,
      round(avg(y::DOUBLE), 6) AS positive_ratio FROM e""",
)
def positive_ratio(spark, sf):
    rows = src.series(spark, sf).withColumn("severe", (F.col("stage") > 2).cast("int"))
    return rounded(q.positive_ratio(rows, "id", "severe"), "positive_ratio")


@query(
    "max_group_size",
    "SELECT max(n) AS max_size FROM (SELECT count(*) AS n FROM events GROUP BY user_id)",
)
def max_group_size(spark, sf):
    return q.max_group_size(src.events(spark, sf), "user_id")


TOPPED = ["event_type", "user_id", "session_id"]


def _top_sql(col: str) -> str:
    return f"""SELECT '{col}' AS feature, row_number() OVER (ORDER BY count(*) DESC, {col}::VARCHAR)::INT AS rank,
      {col}::VARCHAR AS value, count(*) AS n FROM typed WHERE {col} IS NOT NULL GROUP BY {col} QUALIFY rank <= 5"""


@query(
    "profile_top",
    "WITH typed AS (SELECT event_type, user_id, user_id // 7 AS session_id FROM events) "
    + " UNION ALL ".join(f"SELECT * FROM ({_top_sql(x)})" for x in TOPPED),
)
def profile_top(spark, sf):
    rows = src.events(spark, sf).withColumn("session_id", F.floor(F.col("user_id") / 7).cast("long"))
    return q.top_values(rows, TOPPED, k=5)
