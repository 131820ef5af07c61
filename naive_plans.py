"""Straightforward Spark plans for the same results, as a yardstick for the benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions.columns import slot_of
from slotwise.plans import inputs as src
from slotwise.plans.catalog.series import MEASURES


def iqr_fences(spark, sf):
    """One exact-percentile job per column."""
    rows, parts = src.series(spark, sf), []
    for c in MEASURES:
        q1, q3 = rows.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
        parts.append((c, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    return spark.createDataFrame(parts, "feature string, low double, up double")


def resample_6h(spark, sf):
    """Gap filling by a full skeleton and a join."""
    rows = src.series(spark, sf)
    slots = rows.groupBy("id", slot_of("time", "6 hours").alias("slot")).agg(
        *[F.avg(c).alias(c) for c in MEASURES], F.max("stage").alias("stage")
    )
    ends = slots.groupBy("id").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    grid = ends.select(
        "id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 6 hours"))).alias("slot")
    )
    return grid.join(slots, ["id", "slot"], "left")


def flag_intervals(spark, sf):
    """A range join of every slot of an id with every interval of the id."""
    grid, rows = resample_6h(spark, sf).select("id", "slot"), src.intervals(spark, sf)
    last = F.col("slot") + F.expr("INTERVAL 6 hours") - F.expr("INTERVAL 1 second")
    hit = (
        F.col("slot").between(F.col("starttime"), F.col("endtime"))
        | F.col("starttime").between(F.col("slot"), last)
        | F.col("endtime").between(F.col("slot"), last)
    )
    return (
        grid.join(rows, "id", "left")
        .groupBy("id", "slot")
        .agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("treated"))
    )


def collapse_duplicates(spark, sf):
    """One aggregation per column, merged by full outer joins."""
    rows = src.hourly_series(spark, sf)
    parts = [rows.groupBy("id", "time").agg(F.avg(c).alias(c)) for c in MEASURES]
    parts.append(rows.groupBy("id", "time").agg(F.max("stage").alias("stage")))
    merged = reduce(lambda a, b: a.join(b, ["id", "time"], "full_outer"), parts)
    return merged.dropna(how="all", subset=[*MEASURES, "stage"])


def roc_auc(spark, sf) -> DataFrame:
    """Running sums over all rows in one task."""
    rows = src.scores(spark, sf)
    order = W.orderBy(F.desc("p"))
    run = rows.select(
        "y",
        F.sum("y").over(order).alias("tp"),
        F.sum(1 - F.col("y")).over(order).alias("fp"),
        F.row_number().over(order).alias("r"),
        "p",
    )
    points = run.groupBy("p").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    before = W.orderBy(F.desc("p"))
    area = (F.col("fp") - F.coalesce(F.lag("fp").over(before), F.lit(0))) * (
        F.col("tp") + F.coalesce(F.lag("tp").over(before), F.lit(0))
    )
    total = points.withColumn("a", area).agg(
        (F.sum("a") / (2.0 * F.max("tp") * F.max("fp"))).alias("roc_auc")
    )
    return total


NAIVE = {
    "iqr_fences": iqr_fences,
    "resample_6h": resample_6h,
    "flag_intervals": flag_intervals,
    "collapse_duplicates": collapse_duplicates,
    "roc_auc": roc_auc,
}
