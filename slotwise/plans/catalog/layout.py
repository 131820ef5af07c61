"""Queries on events stored by part and bucket, which group and join without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slotwise.operators.events import pivot_mean
from slotwise.plans import inputs as src
from slotwise.plans.catalog.events import KINDS
from slotwise.plans.catalog.registry import WINDOWS, query, rounded
from slotwise.plans.catalog.storage import scratch
from slotwise.session import stored
from slotwise.sources.layout import PART, SLICE, join_sliced, slice_of, store_sliced, store_windows

DAY = "date_diff('day', DATE '1970-01-01', ts::DATE)"
MEANS = ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{k}'), 6) AS {k}_mean" for k in KINDS)


def _table() -> str:
    return f"sliced_{uuid.uuid4().hex}"


def stored_events(spark, sf, part=None):
    return store_sliced(src.events(spark, sf), _table(), "user_id", "ts", scratch(spark), part=part)


def _pivoted(rows):
    wide = pivot_mean(rows, ["user_id", SLICE], "event_type", "value", KINDS)
    return rounded(wide, *[f"{k}_mean" for k in KINDS])


@query("stored_pivot", f"SELECT user_id, {DAY}::INT AS slice, {MEANS} FROM events GROUP BY 1, 2")
def stored_pivot(spark, sf):
    return _pivoted(stored_events(spark, sf))


@query(
    "stored_window_pivot",
    f"""WITH {WINDOWS} SELECT w.user_id, {DAY}::INT AS slice, {MEANS}
    FROM windows w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN w.s AND w.e GROUP BY 1, 2""",
)
def stored_window_pivot(spark, sf):
    events = stored_events(spark, sf)
    windows = src.windows(spark, sf)
    windows = store_windows(windows, _table(), "user_id", "start", "end", scratch(spark), events)
    return _pivoted(join_sliced(events, windows, "user_id", "ts", "start", "end"))


@query(
    "stored_part_rows",
    f"""WITH p AS (SELECT {DAY} // 10 AS part, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1)
    SELECT event_id, user_id, ts FROM events WHERE {DAY} // 10 IN (SELECT part FROM p WHERE n = (SELECT max(n) FROM p))""",
)
def stored_part_rows(spark, sf):
    """Events of the ten days with most errors; the other parts' files aren't read."""
    decade = F.floor(slice_of("ts") / 10).cast("int")
    events = stored_events(spark, sf, decade)
    parts = stored(events.groupBy(PART).agg(F.count_if(F.col("event_type") == "error").alias("n")))
    most = parts.filter(F.col("n") == parts.agg(F.max("n")).scalar())
    return events.join(most, PART).select("event_id", "user_id", "ts")
