"""Joins of events with entities, pivots and flags over coded events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.columns import any_of, slot_after, slot_floor, slots_between
from slotwise.session import stored


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], residual, how: str) -> DataFrame:
    """Equi join on shared key names plus a residual condition; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition = residual(renamed)
    for k in on:
        condition = (left[k] == renamed[f"_r_{k}"]) & condition
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in on])


#: Windows and events of one key meet in slices of this width.
SLICE = "7 days"


def _in_slices(
    stays: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    time: str,
    first: Column | None,
    last: str,
    residual,
    width: str,
) -> DataFrame:
    """Pairs of a stay and an event with equal keys whose time lies in the slices from ``first`` to ``last``.

    An event lies in one slice; a window is entered in each slice it touches (a hundred years are
    5,218 weeks).  Without ``first`` it begins with the earliest event.  The join is by key and
    slice, so the windows and events of one key are spread over the tasks and no slice pairs
    more than its own rows.
    """
    begin = events.agg(F.min(time)).scalar() if first is None else first
    windows = stays.withColumns({"_from": begin, "_to": F.col(last)})
    windows = windows.filter(F.col("_from") <= F.col("_to"))
    start, end = slot_floor(F.col("_from"), width), slot_floor(F.col("_to"), width)
    steps = F.explode(F.sequence(F.lit(0).cast("long"), slots_between(start, end, width).cast("long")))
    windows = windows.withColumns({"_from": start, "_k": steps})
    windows = windows.withColumn("_slice", slot_after(F.col("_from"), F.col("_k"), width)).drop("_from", "_to", "_k")
    sliced = events.withColumn("_slice", slot_floor(F.col(time), width))
    return _joined(windows, sliced, [*on, "_slice"], lambda r: residual(windows, r), "inner").drop("_slice")


def events_in_window(
    stays: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    time: str = "time",
    start: str = "start",
    end: str = "end",
    keep_unmatched: bool = False,
    slice: str = SLICE,
) -> DataFrame:
    """Events of each stay between its ``start`` and ``end``, both included.

    Key and time slice are an equality, the window a residual condition of the same join, so there is
    no nested loop, and a key with many windows and many events is cut into its slices.  No
    side is hinted: a small cohort is broadcast when its size is known to be small, a large one is
    merged and its skewed slices are split at run time.  ``keep_unmatched`` adds stays without
    events (with null event columns): what was matched is stored, and the stays missing from it
    are added, so that no outer join has to keep a hot entity's events together.
    """
    on = [on] if isinstance(on, str) else list(on)
    events = events.dropna(subset=[*on, time])
    found = _in_slices(
        stays, events, on, time, F.col(start), end,
        lambda w, r: r[time].between(w[start], w[end]), slice,
    )
    if not keep_unmatched:
        return found
    found = stored(found)
    window = [*on, start, end]
    rest = stays.join(found.select(*window).distinct(), window, "left_anti")
    return found.unionByName(rest, allowMissingColumns=True)


def events_before(
    stays: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    time: str = "time",
    start: str = "start",
    slice: str = SLICE,
) -> DataFrame:
    """Events of each stay strictly before its ``start``, met in time slices as in ``events_in_window``."""
    on = [on] if isinstance(on, str) else list(on)
    events = events.dropna(subset=[*on, time])
    return _in_slices(
        stays, events, on, time, None, start, lambda w, r: r[time] < w[start], slice
    )


def events_for_entity(
    stays: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    condition: Column | None = None,
) -> DataFrame:
    """Events of each stay's entity without a time bound; ``condition`` filters before the join."""
    kept = events.filter(condition) if condition is not None else events
    return stays.join(kept, on, "inner")


def pivot_agg(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    value: str,
    labels: Sequence[str],
    fn: str = "mean",
    suffix: str | None = None,
) -> DataFrame:
    """Long to wide: one row per key, one aggregated column per listed label.

    The labels are given, so the pivot is one aggregation with map-side partial results.  A key
    that has only other labels keeps its row, with nulls.
    """
    aggregate = {"mean": F.avg, "min": F.min, "max": F.max}[fn]
    suffix = f"_{fn}" if suffix is None else suffix
    return df.groupBy(*keys).agg(
        *[
            aggregate(F.when(F.col(label) == name, F.col(value))).alias(f"{name}{suffix}")
            for name in labels
        ]
    )


def pivot_mean(
    df: DataFrame, keys: Sequence[str], label: str, value: str, labels: Sequence[str]
) -> DataFrame:
    return pivot_agg(df, keys, label, value, labels, "mean")


def flag_events(
    df: DataFrame, keys: Sequence[str], rules: Sequence[Column], flag: str = "flag"
) -> DataFrame:
    """Per key, 1 when any event meets any rule, else 0."""
    hit = F.when(any_of(list(rules)), F.lit(1)).otherwise(F.lit(0))
    return df.groupBy(*keys).agg(F.max(hit).alias(flag))


def collapse_flags(df: DataFrame, keys: Sequence[str], flag: str = "flag") -> DataFrame:
    """One row per key with the largest flag."""
    return df.groupBy(*keys).agg(F.max(flag).alias(flag))


def enrich(df: DataFrame, attributes: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join of attributes that are unique per key."""
    return df.join(attributes, on, "left")


def value_rules(code: str, value: str, rules: Mapping[str, tuple]) -> list[Column]:
    """Conditions on code and chart value.

    Each rule is ``(codes, accepted values)``; without accepted values any non-null value counts.
    """
    conditions = []
    for codes, values in rules.values():
        condition = F.col(code).isin(list(codes))
        if values is None:
            conditions.append(condition & F.col(value).isNotNull())
        else:
            conditions.append(condition & F.col(value).isin(list(values)))
    return conditions
