"""Queries that go through files and back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slotwise.dictionaries import LEGACY_NAMES
from slotwise.operators.cleaning import (
    cast_columns,
    feature_columns,
    harmonize_columns,
    label_last,
    parse_times,
)
from slotwise.operators.series import presented
from slotwise.plans import inputs as src
from slotwise.plans.catalog.learning import FILLED, labelled_of
from slotwise.plans.catalog.registry import SERIES, query, rounded
from slotwise.plans.catalog.series import MEASURES
from slotwise.session import shared_folder
from slotwise.sources import (
    append_report,
    materialize,
    read_report,
    read_table,
    read_tsv,
    run_record,
    write_tsv,
)


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


@query("read_table", "SELECT o_orderkey, o_totalprice FROM orders")
def read_columns(spark, sf):
    return read_table(spark, "orders", ["o_orderkey", "o_totalprice"], sf)


@query("tsv_roundtrip", f"WITH {SERIES} SELECT * FROM series")
def tsv_roundtrip(spark, sf):
    rows = src.series(spark, sf)
    path = scratch(spark)
    write_tsv(rows, path)
    return read_tsv(spark, path, rows.schema)


@query("materialize", f"WITH {SERIES} SELECT id, time, stage FROM series WHERE stage IS NOT NULL")
def stored_table(spark, sf):
    rows = src.series(spark, sf).select("id", "time", "stage").dropna()
    return materialize(rows, "staged", path=scratch(spark))


@query(
    "harmonize_columns",
    f"WITH {SERIES} SELECT id AS stay_id, time AS charttime, click, stage AS aki_stage FROM series",
)
def harmonized(spark, sf):
    legacy = src.series(spark, sf).select(
        F.col("id").alias("patient_id"), F.col("time").alias("检验日期"),
        F.col("stage").alias("akistage"), "click",
    )
    return label_last(harmonize_columns(legacy, LEGACY_NAMES), "aki_stage")


@query(
    "run_record",
    f"""WITH {FILLED}, e AS (SELECT id, max(stage) AS y, count(*) AS n FROM filled GROUP BY 1)
    SELECT 8888::INT AS random_seed, 'fill with zero' AS imputation, 3::BIGINT AS feature_num,
      count(*) AS sample_num, round(avg(y::DOUBLE), 6) AS positive_ratio,
      max(n) AS time_seq_length FROM e""",
)
def recorded(spark, sf):
    rows = labelled_of(spark, sf).select("id", "slot", "stage", *MEASURES)
    params = {"random_seed": 8888, "imputation": "fill with zero"}
    record = run_record(
        rows, "id", "stage", feature_columns(rows, ["id", "slot", "stage"]), params
    )
    return rounded(record, "positive_ratio")


@query(
    "parse_times",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 10 = 0 THEN 'unknown'
      ELSE o_orderdate::VARCHAR END AS TIMESTAMP) AS ordered FROM orders""",
)
def parsed(spark, sf):
    text = F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(
        F.col("o_orderdate").cast("string")
    )
    orders = read_table(spark, "orders", base=sf).select("o_orderkey", text.alias("ordered"))
    return parse_times(orders, ["ordered"])


@query(
    "cast_columns",
    """SELECT o_orderkey, o_totalprice::FLOAT::DOUBLE AS o_totalprice FROM orders""",
)
def cast(spark, sf):
    orders = read_table(spark, "orders", ["o_orderkey", "o_totalprice"], sf)
    single = cast_columns(orders, {"o_totalprice": "float"})
    return cast_columns(single, {"o_totalprice": "double"})


@query("presented", f"WITH {SERIES} SELECT id, time, stage FROM series")
def in_order(spark, sf):
    return presented(src.series(spark, sf).select("id", "time", "stage"), "id", "time")


@query("distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark, sf):
    return src.events(spark, sf).select("user_id", "event_type").distinct()


@query(
    "report_log",
    """SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_ids, 'all' AS run_id FROM events GROUP BY 1
    UNION ALL SELECT event_type, count(*), count(DISTINCT user_id), 'high' FROM events WHERE value > 50 GROUP BY 1""",
)
def report_log(spark, sf):
    """Two runs of a report, the first of them retried, read back as one table."""
    path = scratch(spark)

    def report(rows):
        return rows.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_ids"))

    events = src.events(spark, sf)
    for rows, run in ((events, "all"), (events.filter("value > 50"), "high"), (events, "all")):
        append_report(report(rows), path, run)
    return read_report(spark, path)
