"""A stored layout for events: partitioned by time, bucketed by entity and slice of days.

Rows of an entity and a slice lie in one bucket, so that grouping by (entity, slice, ...) and joining two
tables of this layout need no shuffle.  An entity's slices fall into different buckets: an entity with a third of
all rows doesn't make one bucket of them.  Parts are folders, which filters and joins on ``part`` prune.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.columns import named

SLICE, PART = "slice", "part"


def slice_of(time: str | Column, days: int = 1) -> Column:
    """Number of the slice of ``days`` days since 1970 that a time falls in."""
    col = named(time) if isinstance(time, str) else time
    return F.floor(F.unix_date(col.cast("date")) / F.lit(days)).cast("int")


def store_sliced(
    df: DataFrame,
    name: str,
    key: str,
    time: str,
    path: str,
    buckets: int | None = None,
    days: int = 1,
    part: Column | None = None,
) -> DataFrame:
    """Replace the catalog table ``name``, with its files at ``path``, by ``df`` with ``slice`` and ``part``.

    ``part`` is the month (yyyy-MM) if no other expression is given.  One shuffle deals the rows as the buckets
    are, so that a task writes one bucket, a file for each part.  Only
    the rows of one key and slice have to fit a task; take narrower slices where they don't.  Rows without a time form
    a slice and a part of their own (null).  ``buckets`` follows ``spark.sql.shuffle.partitions``; tables that are to be joined
    need the same number and ``days``.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    month = F.date_format(named(time), "yyyy-MM")
    rows = df.withColumns({SLICE: slice_of(time, days), PART: month if part is None else part})
    dealt = rows.repartition(buckets, named(key), F.col(SLICE))
    writer = dealt.write.mode("overwrite").partitionBy(PART).bucketBy(buckets, key, SLICE).sortBy(key, SLICE)
    writer.option("path", path).saveAsTable(name)
    return spark.read.table(name)


def store_windows(
    windows: DataFrame,
    name: str,
    key: str,
    start: str,
    end: str,
    path: str,
    events: DataFrame,
    buckets: int | None = None,
    days: int = 1,
) -> DataFrame:
    """Windows as one row for each of their slices, bucketed as ``events``, a table of ``store_sliced``, is.

    Windows are cut to the slices that ``events`` spans, so that a window without an end makes no more rows than
    the table has days.  Windows that end before they start, or lack a bound, have no row.
    """
    spark = windows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = events.agg(F.min(SLICE).alias("low"), F.max(SLICE).alias("high")).first()
    low, high = (F.lit(x).cast("int") for x in span)
    first, last = F.greatest(slice_of(start, days), low), F.least(slice_of(end, days), high)
    inside = windows.filter(named(start) <= named(end)).withColumns({"_first": first, "_last": last})
    inside = inside.filter(F.col("_first") <= F.col("_last"))
    rows = inside.withColumn(SLICE, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    dealt = rows.repartition(buckets, named(key), F.col(SLICE))
    writer = dealt.write.mode("overwrite").bucketBy(buckets, key, SLICE).sortBy(key, SLICE)
    writer.option("path", path).saveAsTable(name)
    return spark.read.table(name)


def join_sliced(
    events: DataFrame, windows: DataFrame, key: str, time: str, start: str, end: str
) -> DataFrame:
    """Events inside the windows of their key, both ends included, from two tables of the same buckets.

    An event lies in one slice, so it meets a window once.  The tables' names of further columns must differ.
    """
    met = events.join(windows, [key, SLICE])
    return met.filter(named(time).between(named(start), named(end)))


def drop_sliced(spark: SparkSession, *names: str) -> None:
    """Forget the tables; their files stay until their folder goes."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


__all__ = ["PART", "SLICE", "drop_sliced", "join_sliced", "slice_of", "store_sliced", "store_windows"]
