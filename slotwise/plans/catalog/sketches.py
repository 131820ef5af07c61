"""Queries on stored sketches; SQL counts the rows, and each estimate is held against exact ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators import sketches as k
from slotwise.plans.catalog.registry import query
from slotwise.session import stored
from slotwise.sources import read_table

PROBS = {"q25": ("value", 0.25), "q50": ("value", 0.5), "q90": ("value", 0.9)}


def events_by_day(spark, sf):
    events = read_table(spark, "events", ["event_type", "user_id", "ts", "value"], sf)
    return events.withColumn("day", F.to_date("ts"))


def daily_sketches(spark, sf):
    return stored(k.sketch_table(events_by_day(spark, sf), ["event_type", "day"], ["value"], ["user_id"]))


def confirmed(estimates, rows, by):
    """Which estimates lie inside their bound, by exact counts over the rows of each group."""
    joined = rows.join(estimates.select(*by, *PROBS, "users"), by)
    counts = joined.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count("value").alias("n_value"),
        F.count_distinct("user_id").alias("n_users"),
        F.first("users").alias("users"),
        *[F.count_if(F.col("value") < F.col(q)).alias(f"below_{q}") for q in PROBS],
        *[F.count_if(F.col("value") <= F.col(q)).alias(f"up_to_{q}") for q in PROBS],
    )
    off = k.rank_bound()
    inside = {
        f"{q}_inside": (F.col(f"below_{q}") <= (p + off) * F.col("n_value"))
        & (F.col(f"up_to_{q}") >= (p - off) * F.col("n_value"))
        for q, (_, p) in PROBS.items()
    }
    near = F.abs(F.col("users") - F.col("n_users")) <= F.ceil(k.distinct_bound() * F.col("n_users"))
    return counts.withColumns(inside | {"users_inside": near}).select(
        *by, "n", "n_users", *inside, "users_inside"
    )


INSIDE = ", ".join(f"TRUE AS {q}_inside" for q in (*PROBS, "users"))


@query(
    "sketched_quantiles",
    f"""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, {INSIDE},
      count(DISTINCT ts::DATE) AS n_parts, count(*) AS n_merged
    FROM events GROUP BY 1""",
)
def sketched_quantiles(spark, sf):
    """Quantiles and users per event type, merged from the sketches of its days."""
    merged = k.merge_sketches(daily_sketches(spark, sf), ["event_type"])
    estimates = stored(k.read_sketches(merged, PROBS, {"users": "user_id"}))
    counted = confirmed(estimates, events_by_day(spark, sf), ["event_type"])
    return counted.join(estimates.select("event_type", "n_parts", F.col("n").alias("n_merged")), "event_type")


@query(
    "sketched_weeks",
    f"""WITH days AS (SELECT DISTINCT event_type, ts::DATE AS day FROM events)
    SELECT d.event_type, d.day::VARCHAR AS day, count(*) AS n, count(DISTINCT e.user_id) AS n_users, {INSIDE}
    FROM days d JOIN events e ON e.event_type = d.event_type
      AND e.ts::DATE BETWEEN d.day - 6 AND d.day GROUP BY 1, 2""",
)
def sketched_weeks(spark, sf):
    """The same for the seven days up to each day; only the confirmation reads the events again."""
    rolled = k.rolling_sketches(daily_sketches(spark, sf), "day", 7, ["event_type"])
    estimates = stored(k.read_sketches(rolled, PROBS, {"users": "user_id"}))
    rows = events_by_day(spark, sf)
    copies = rows.withColumn("day", F.explode(F.sequence(F.col("day"), F.date_add("day", 6))))
    out = confirmed(estimates, copies, ["event_type", "day"])
    return out.withColumn("day", F.col("day").cast("string"))
