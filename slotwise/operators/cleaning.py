"""Projection, filtering and cleaning of columns and rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from slotwise.dictionaries import CodeRule, dictionary_frame
from slotwise.functions.columns import any_of, named, quoted


def harmonize_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename legacy columns where they occur; an error if a new name would then occur twice."""
    after = [mapping.get(c, c) for c in df.columns]
    twice = sorted({c for c in after if after.count(c) > 1 and c in mapping.values()})
    if twice:
        raise ValueError(f"old and new names both occur: {twice}")
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def filter_codes(events: DataFrame, codes: Sequence[int | str], code: str = "code") -> DataFrame:
    """Rows whose code is in a literal list; the list reaches the parquet scan."""
    return events.filter(F.col(code).isin(list(codes)))


def accepted(value: str = "value") -> Column:
    """Whether the raw value lies within the bounds its code rule carries (true, false or null)."""
    v = F.col(value)
    above = F.when(F.col("low").isNull(), F.lit(True)).otherwise(
        F.when(F.col("low_open"), v > F.col("low")).otherwise(v >= F.col("low"))
    )
    below = F.when(F.col("high").isNull(), F.lit(True)).otherwise(
        F.when(F.col("high_open"), v < F.col("high")).otherwise(v <= F.col("high"))
    )
    return above & below


def map_codes(
    events: DataFrame, rules: Sequence[CodeRule], code: str = "code", keep_unmapped: bool = False
) -> DataFrame:
    """Attach the rule of each event's code: concept, bounds and unit conversion.

    Events with other codes are left out unless ``keep_unmapped``.  The dictionary is a local
    relation of known size, from which the planner decides on a broadcast; the code list itself also
    filters the scan.
    """
    rules = list(rules)
    table = dictionary_frame(events.sparkSession, rules)
    if not keep_unmapped:
        events = filter_codes(events, [r.code for r in rules], code)
    how = "left" if keep_unmapped else "inner"
    return events.join(table.withColumnRenamed("code", "_code"), F.col(code) == F.col("_code"), how).drop(
        "_code"
    )


def apply_limits(df: DataFrame, value: str = "value") -> DataFrame:
    """Null out values outside the bounds of their rule (see ``map_codes``)."""
    return df.withColumn(value, F.when(accepted(value), F.col(value)))


def convert_units(df: DataFrame, value: str = "value") -> DataFrame:
    """Convert to the concept's unit.  Bounds concern the raw value, so apply them first."""
    changed = (F.col("shift") != 0) | (F.col("scale") != 1)
    return df.withColumn(
        value,
        F.when(changed, (F.col(value) - F.col("shift")) / F.col("scale")).otherwise(F.col(value)),
    )


def points_to_intervals(
    df: DataFrame, time: str, start: str = "starttime", end: str = "endtime"
) -> DataFrame:
    """A point in time as an interval of zero length."""
    others = [c for c in df.columns if c != time]
    return df.select(*others, F.col(time).alias(start), F.col(time).alias(end))


def keep_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose id occurs in ``ids``."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(ids.select(*keys), keys, "left_semi")


def exclude_ids(
    df: DataFrame, ids: DataFrame, on: str, not_null: Sequence[str] = ()
) -> DataFrame:
    """Rows whose id does not occur in ``ids`` and whose ``not_null`` columns are filled."""
    kept = df.dropna(how="any", subset=list(not_null)) if not_null else df
    return kept.join(ids.select(on), on, "left_anti")


def drop_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows in which every one of ``cols`` is null."""
    return df.dropna(how="all", subset=list(cols))


def impute_constant(
    df: DataFrame, value: float | int | str = 0, cols: Sequence[str] | None = None
) -> DataFrame:
    return df.fillna(value, subset=None if cols is None else [quoted(c) for c in cols])


def recode(df: DataFrame, col: str, mapping: Mapping[Any, Any]) -> DataFrame:
    """Replace listed values of one column; other values pass through."""
    return df.replace(dict(mapping), subset=[col])


def mask_outliers(df: DataFrame, fences: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null out values outside ``[low, up]`` of their column; columns without a fence stay.

    ``fences`` has one row per column (see ``quality.iqr_fences``).  Its few numbers are fetched
    and become constants of the plan: no join, and no copy of the fit inside it.
    """
    bounds = {row["feature"]: (row["low"], row["up"]) for row in fences.collect()}

    def kept(c: str) -> Column:
        low, up = bounds[c]
        outside = (named(c) < F.lit(low)) | (named(c) > F.lit(up))
        return F.when(outside, F.lit(None)).otherwise(named(c))

    fenced = [c for c in cols if None not in bounds.get(c, (None, None))]
    return df.withColumns({c: kept(c) for c in fenced})


def parse_times(df: DataFrame, cols: Sequence[str], on_error: str = "null") -> DataFrame:
    """Text to timestamps without a time zone; text that is no time is null or an error."""
    parsed = {
        "null": lambda c: F.col(c).try_cast("timestamp_ntz"),
        "error": lambda c: F.col(c).cast("timestamp_ntz"),
    }[on_error]
    return df.withColumns({c: parsed(c) for c in cols})


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns, for example measures to ``float`` where a table is exported.

    Keys keep their type: an integer key does not survive a float.
    """
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def count_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: how many values of each column are below zero."""
    return df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols])


def null_guard(df: DataFrame, cols: Sequence[str], on_null: str = "drop_rows") -> DataFrame:
    """Decide what nulls in ``cols`` mean for an input table.

    ``drop_rows`` removes the rows, ``skip_feature`` empties the table when any is null, and
    ``error`` fails the job at the first null.
    """
    if on_null == "drop_rows":
        return df.dropna(how="any", subset=list(cols))
    missing = any_of([F.col(c).isNull() for c in cols])
    if on_null == "skip_feature":
        found = df.agg(F.coalesce(F.bool_or(missing), F.lit(False)).alias("found"))
        return df.filter(~found.scalar())
    if on_null == "error":
        failure = F.raise_error(F.lit(f"null in one of {', '.join(cols)}"))
        return df.filter(F.when(missing, failure.cast("boolean")).otherwise(F.lit(True)))
    raise ValueError(f"unknown on_null: {on_null}")


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Names of the feature columns, sorted: everything but keys and label."""
    return sorted(c for c in df.columns if c not in exclude)


def label_last(df: DataFrame, label: str) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if c != label], label)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in exclude
    ]
