"""Profiles, coverage, completeness, lengths of record, quantile fences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from slotwise.functions.columns import days_between, named
from slotwise.functions.ranking import exact_quantiles, quantile
from slotwise.operators.cleaning import keep_ids
from slotwise.session import stored


def entity_label(df: DataFrame, id: str, label: str) -> DataFrame:
    """The largest label of each entity."""
    return df.groupBy(id).agg(F.max(label).alias(label))


def positive_ratio(df: DataFrame, id: str, label: str, by: str | None = None) -> DataFrame:
    """Entities, positive entities and their share, for the whole set or per group.

    ``by`` must be constant within an entity, as a split is.
    """
    keys = [by] if by else []
    positive = (F.col(label) > 0).cast("int")
    return (
        df.groupBy(id, *keys)
        .agg(F.max(positive).alias("_positive"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_entities"),
            F.sum("_positive").alias("n_positive"),
            F.avg(F.col("_positive").cast("double")).alias("positive_ratio"),
        )
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def n_unique(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row: the number of distinct non-null values of each column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(c) for c in cols])


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Per column the fences ``Q1 - k*IQR`` and ``Q3 + k*IQR`` from exact quartiles.

    Fitted when called (see ``exact_quantiles``): a local table with one row per column.
    """
    q = exact_quantiles(df, cols, [0.25, 0.75])
    spread = (F.col("q1") - F.col("q0")) * F.lit(float(k))
    return q.select(
        "feature", (F.col("q0") - spread).alias("low"), (F.col("q1") + spread).alias("up")
    )


def length_of_stay(df: DataFrame, id: str, time: str) -> DataFrame:
    """Days between the first and the last record of each id."""
    spans = df.groupBy(id).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    return spans.select(id, days_between("_first", "_last").alias("los"))


def stays_within(los: DataFrame, low: float = 2.0, pct: float = 0.95) -> DataFrame:
    """Ids whose length of stay is above ``low`` and at most the given percentile of all.

    The lengths are stored, because finding the percentile reads them more than once.
    """
    los = stored(los)
    bound = quantile(los, "los", pct)
    return los.filter((F.col("los") > low) & (F.col("los") <= bound.scalar()))


def los_filter(
    df: DataFrame, id: str, time: str, low: float = 2.0, pct: float = 0.95
) -> DataFrame:
    """Rows of the ids that ``stays_within`` keeps."""
    return keep_ids(df, stays_within(length_of_stay(df, id, time), low, pct), id)


def los_counts(los: DataFrame, low: float = 2.0, pct: float = 0.95) -> DataFrame:
    """One row: the bound, and how many ids lie inside and outside the accepted range."""
    los = stored(los)
    bounded = los.withColumn("_bound", quantile(los, "los", pct).scalar())
    inside = (F.col("los") > low) & (F.col("los") <= F.col("_bound"))
    return bounded.agg(
        F.max("_bound").alias("bound"),
        F.min("los").alias("los_min"),
        F.max("los").alias("los_max"),
        F.count_if(inside).alias("n_inside"),
        F.count_if(~inside).alias("n_outside"),
    )


def histogram(
    df: DataFrame, col: str, width: float = 1.0, cap: int | DataFrame = 20, low: float = 0.0
) -> DataFrame:
    """Counts and percentages per bin of equal width; the tail falls into the last of ``cap`` bins.

    ``cap`` may be a one-value DataFrame, such as a rounded-up percentile.
    """
    n_bins = cap.scalar() if isinstance(cap, DataFrame) else F.lit(cap)
    binned = df.select(
        F.least(
            F.floor((F.col(col) - F.lit(low)) / F.lit(width)).cast("bigint"),
            (n_bins - 1).cast("bigint"),
        ).alias("bin")
    ).filter(F.col("bin").isNotNull())
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    total = df.agg(F.count(col).alias("total"))
    share = F.col("n").cast("double") * F.lit(100.0) / total.scalar()
    return counts.withColumn("percent", F.round(share, 2))


def _presence(df: DataFrame, id: str, feats: Sequence[str]) -> DataFrame:
    """Per id, for each feature 1 when it was ever measured."""
    return df.groupBy(id).agg(
        *[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in feats]
    )


def _unpivoted(one_row: DataFrame, feats: Sequence[str], value: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias(value)) for c in feats]
    return one_row.select(F.inline(F.array(*pairs)))


def feature_coverage(df: DataFrame, id: str, feats: Sequence[str]) -> DataFrame:
    """Per feature the share of ids with at least one value."""
    shares = _presence(df, id, feats).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in feats])
    return _unpivoted(shares, feats, "coverage")


def keep_covered(
    df: DataFrame, id: str, feats: Sequence[str], threshold: float = 0.8
) -> tuple[DataFrame, list[str]]:
    """Drop features covered by less than ``threshold`` of the ids.

    Which columns remain is needed to plan the result, so one row per feature is fetched.
    """
    enough = feature_coverage(df, id, feats).filter(F.col("coverage") >= threshold)
    names = {row["feature"] for row in enough.collect()}
    return df.drop(*[c for c in feats if c not in names]), [c for c in feats if c in names]


def info_integrity(df: DataFrame, id: str, feats: Sequence[str]) -> DataFrame:
    """Per id the share of features with at least one value."""
    measured = sum((F.col(c) for c in feats[1:]), F.col(feats[0]))
    return _presence(df, id, feats).select(
        id, (measured.cast("double") / F.lit(float(len(feats)))).alias("integrity")
    )


def keep_complete(
    df: DataFrame, id: str, feats: Sequence[str], threshold: float = 0.8
) -> DataFrame:
    """Rows of the ids with at least ``threshold`` of the features measured."""
    enough = info_integrity(df, id, feats).filter(F.col("integrity") >= threshold)
    return keep_ids(df, enough, id)


def compare_reports(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Full outer merge of a report made before and after a step."""
    return before.join(after, key, "full_outer")


def max_group_size(df: DataFrame, id: str) -> DataFrame:
    """One row: the number of rows of the longest entity."""
    return df.groupBy(id).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("max_size"))


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: type, rows, nulls, mean, deviation, range and exact quartiles."""
    types = {
        f.name: f.dataType.simpleString()
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and (cols is None or f.name in cols)
    }
    names = list(types)
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(types[c]).alias("dtype"),
                F.count("*").alias("n_rows"),
                F.count_if(F.col(c).isNull()).alias("n_null"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in names
        ]
    )
    rows = stats.select(F.inline(F.array(*[F.col(c) for c in names])))
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75]).withColumnsRenamed(
        {"q0": "q25", "q1": "q50", "q2": "q75"}
    )
    return rows.join(quartiles, "feature")


#: Values of a column that a task's summary holds, at first and at most.
SUMMARY, LARGEST_SUMMARY = 4096, 1 << 18


def frequent_values(df: DataFrame, cols: Sequence[str], capacity: int = SUMMARY) -> DataFrame:
    """A mergeable summary of frequent values: ``feature, value, least``, and the error of each feature with a null value.

    Misra-Gries: a task holds ``capacity`` counters for each column; when they overflow, the
    smallest count that frees half of them is taken off all.  Sums of the tasks' counts and errors keep the
    promise: a value's true number lies between ``least`` and ``least`` plus the error, and a value that is
    missing occurs at most that often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in cols]
        errors = [0] * len(cols)
        for b in batches:
            for i in range(len(cols)):
                counts = pc.value_counts(b.column(i).drop_null())
                held[i].update(dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True)))
                if len(held[i]) > capacity:
                    cut = sorted(held[i].values(), reverse=True)[capacity // 2]
                    errors[i] += cut
                    held[i] = Counter({v: n - cut for v, n in held[i].items() if n > cut})
        rows = [(c, v, n) for c, own in zip(cols, held, strict=True) for v, n in own.items()]
        rows += [(c, None, e) for c, e in zip(cols, errors, strict=True)]
        kinds = (pa.string(), pa.string(), pa.int64())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "value", "least"])

    texts = df.select(*[named(c).cast("string") for c in cols])
    sent = texts.mapInArrow(run, "feature string, value string, least long")
    return sent.groupBy("feature", "value").agg(F.sum("least").alias("least"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 10, capacity: int = SUMMARY) -> DataFrame:
    """The ``k`` most frequent values of each column: ``feature, rank, value, n``; ties by value, nulls left out.

    The first pass makes a summary, the second counts exactly what the summary cannot rule out.  If the error is
    so large that an unseen value might belong to the result, the summary is made again with eight times the
    counters; a column whose values are all rare is counted by value in the end, with partial sums.
    ``df`` is read twice or more: store it first when it is costly.
    """
    cols, out = list(cols), None

    def ranked(names: list[str], wanted: DataFrame | None) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), named(c).cast("string").alias("value")) for c in names])
        values = df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
        values = values if wanted is None else values.join(wanted, ["feature", "value"])
        counted = values.groupBy("feature", "value").agg(F.count("*").alias("n"))
        place = W.partitionBy("feature").orderBy(F.desc("n"), "value")
        counted = counted.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        return counted.select("feature", "rank", "value", "n")

    while cols:
        if capacity > LARGEST_SUMMARY:
            sure, part = cols, ranked(cols, None)
        else:
            summary = stored(frequent_values(df, cols, capacity))
            error = {r["feature"]: r["least"] for r in summary.filter(F.col("value").isNull()).collect()}
            known = summary.filter(F.col("value").isNotNull())
            by_least = W.partitionBy("feature").orderBy(F.desc("least"))
            kth = known.withColumn("_r", F.row_number().over(by_least)).filter(F.col("_r") <= k)
            kth = kth.filter(F.col("_r") == k).collect()
            bound = {r["feature"]: r["least"] for r in kth}
            sure = [c for c in cols if not error.get(c) or error[c] < bound.get(c, 0)]
            part = None
            if sure:
                floors = [F.lit(x) for c in sure for x in (c, bound.get(c, 0) - error.get(c, 0))]
                may = known.filter(F.col("feature").isin(sure) & (F.col("least") >= F.create_map(*floors)[F.col("feature")]))
                part = ranked(sure, stored(may.select("feature", "value")))
        if part is not None:
            out = part if out is None else out.unionByName(part)
        cols, capacity = [c for c in cols if c not in sure], capacity * 8
    return out
