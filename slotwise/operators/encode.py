"""Encoding, splitting, sampling, scaling and sequence building."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from slotwise.functions.columns import hash_bucket, hash_range, named, row_hash
from slotwise.operators.cleaning import recode
from slotwise.operators.events import enrich

SPLIT_BUCKETS = 1000
SPLITS = {"train": 0.8, "val": 0.1, "test": 0.1}


#: Values that may become columns, over all columns that are encoded together.
MOST_CATEGORIES = 10_000


def find_categories(
    df: DataFrame, cols: Sequence[str], most: int = MOST_CATEGORIES
) -> dict[str, list[str]]:
    """The distinct non-null values of each column, sorted.

    They become column names: more than ``most`` of them are an error, found without fetching more than
    that, since columns with many values belong in the long form of ``one_hot_rows``.
    """
    pairs = [F.struct(F.lit(c).alias("col"), named(c).alias("value")) for c in cols]
    rows = df.select(F.inline(F.array(*pairs))).dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values in {list(cols)}; use one_hot_rows or name the categories")
    return {c: sorted(row["value"] for row in rows if row["col"] == c) for c in cols}


def one_hot_rows(df: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    """The long form of one-hot columns: a row ``id, feature, 1`` for every value that is not null.

    For columns with many values: nothing is collected and no column is made per value.
    """
    pairs = [F.struct(F.lit(c).alias("col"), named(c).cast("string").alias("value")) for c in cols]
    rows = df.select(named(id), F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    return rows.select(
        named(id), F.concat_ws("_", "col", "value").alias("feature"), F.lit(1).alias("one")
    ).distinct()


def one_hot(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    categories: Mapping[str, Sequence[Any]] | None = None,
) -> DataFrame:
    """Replace string columns by 0/1 columns ``<col>_<value>``; a null gives all zeros.

    With explicit ``categories`` no job is run to find them.
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    known = categories or find_categories(df, cols)
    kept = [named(c) for c in df.columns if c not in cols]
    dummies = [
        F.when(named(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c in cols for v in known[c]
    ]
    return df.select(*kept, *dummies)


def static_features(
    detail: DataFrame,
    admissions: DataFrame,
    ids: DataFrame,
    id: str,
    admission_key: str,
    groups: Mapping[str, Mapping[Any, Any]],
    columns: Sequence[str],
    categories: Mapping[str, Sequence[Any]] | None = None,
) -> DataFrame:
    """One encoded row of static attributes per entity in ``ids``.

    ``groups`` maps a column to the recoding of its values before encoding.
    """
    rows = enrich(
        detail.join(ids.select(id), id, "left_semi"), admissions, admission_key
    ).select(id, *columns)
    for col, mapping in groups.items():
        rows = recode(rows, col, mapping)
    return one_hot(rows, categories=categories, cols=list(categories) if categories else None)


def split_by_id(
    df: DataFrame,
    id: str,
    weights: Mapping[str, float] = SPLITS,
    seed: int = 8888,
    fn: str = "xxhash64",
) -> DataFrame:
    """Add column ``split``; an entity is never in two splits.

    The split is a function of the id and the seed, so no shuffle and no id list is needed.
    """
    bucket = hash_bucket([id], seed, SPLIT_BUCKETS, fn)
    total, upper, names = sum(weights.values()), 0.0, list(weights)
    split: Column | None = None
    for name in names[:-1]:
        upper += weights[name] / total
        below = bucket < F.lit(round(upper * SPLIT_BUCKETS))
        split = F.when(below, name) if split is None else split.when(below, name)
    last = F.lit(names[-1])
    return df.withColumn("split", last if split is None else split.otherwise(last))


def get_split(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name).drop("split")


def undersample(
    df: DataFrame,
    label: str,
    n: int,
    keys: Sequence[str],
    seed: int = 42,
    fn: str = "xxhash64",
) -> DataFrame:
    """All positive rows and the ``n`` negative ones with the smallest hashes (all when there are fewer).

    The hash of ``keys``, which must identify a row, decides; the keys break ties.  One pass counts the
    negatives by ranges of the hash, summed in each task; the ranges below the threshold are
    taken whole in the second pass, and only the range that is taken in part is ranked, one of 65,536.
    No sort and no limit over all negatives, and no count of the rows beforehand.
    """
    positives = df.filter(F.col(label) > 0)
    negatives = df.filter(F.col(label) == 0).withColumn("_hash", row_hash(keys, seed, fn))
    negatives = negatives.withColumn("_range", hash_range("_hash", fn))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = (
        negatives.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .withColumn("_left", F.lit(n) - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(F.col("_left") > 0)
    )
    reached = negatives.join(counts, "_range")
    whole = reached.filter(F.col("_n") <= F.col("_left")).select(*map(named, df.columns))
    inside = W.partitionBy("_range").orderBy("_hash", *keys)
    part = (
        reached.filter(F.col("_n") > F.col("_left"))
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") <= F.col("_left"))
        .select(*map(named, df.columns))
    )
    return positives.unionByName(whole).unionByName(part)


def undersample_fraction(
    df: DataFrame,
    label: str,
    fraction: float,
    keys: Sequence[str],
    seed: int = 42,
    fn: str = "xxhash64",
) -> DataFrame:
    """All positive rows and about a fraction of the negative ones, in one scan."""
    buckets = SPLIT_BUCKETS if fn == "arithmetic" else 1_000_000
    chosen = hash_bucket(keys, seed, buckets, fn) < F.lit(round(fraction * buckets))
    return df.filter((F.col(label) > 0) | ((F.col(label) == 0) & chosen))


def shuffle_rows(
    df: DataFrame, keys: Sequence[str], seed: int = 42, fn: str = "xxhash64"
) -> DataFrame:
    """Rows in a reproducible random order (a range-partitioned sort by hash)."""
    return df.orderBy(row_hash(keys, seed, fn), *keys)


def fit_scaler(
    df: DataFrame,
    cols: Sequence[str],
    id: str,
    maxlen: int | DataFrame | None = None,
    include_padding: bool = True,
) -> DataFrame:
    """Mean and scale of each column: ``feature, mean, scale``.

    The deviation is the population one and a constant column has scale 1.  With
    ``include_padding`` the statistics are those of the padded sequences (``maxlen`` steps per
    id, zeros in front), without building them: the moments of the real rows are combined with
    those of the missing zeros.  ``maxlen`` may be left out to use the longest id.
    """
    sizes = df.groupBy(id).agg(F.count("*").alias("_steps"))
    length = (
        F.max("_steps") if maxlen is None
        else maxlen.scalar() if isinstance(maxlen, DataFrame)
        else F.lit(int(maxlen))
    )
    padded = sizes.agg((F.count("*") * length).cast("double").alias("n"))
    filled = [F.coalesce(named(c).cast("double"), F.lit(0.0)) for c in cols]
    moments = df.agg(
        F.count("*").cast("double").alias("_rows"),
        *[F.avg(v).alias(f"_m{i}") for i, v in enumerate(filled)],
        *[F.var_pop(v).alias(f"_v{i}") for i, v in enumerate(filled)],
    ).withColumn("_total", padded.scalar() if include_padding else F.col("_rows"))
    rows, n = F.col("_rows"), F.col("_total")

    def fitted(i: int, c: str) -> Column:
        m, v = F.col(f"_m{i}"), F.col(f"_v{i}")
        variance = (v * rows + m * m * rows * (n - rows) / n) / n
        scale = F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0))
        return F.struct(
            F.lit(c).alias("feature"), (m * rows / n).alias("mean"), scale.alias("scale")
        )

    return moments.select(F.inline(F.array(*[fitted(i, c) for i, c in enumerate(cols)])))


def _fitted_stats(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """One row per column, fetched as constants of the plans that use them."""
    return {row["feature"]: (row["mean"], row["scale"]) for row in stats.collect()}


def scaled_zero(stats: DataFrame, cols: Sequence[str]) -> Column:
    """What a padding step of zeros looks like after scaling: one value per column."""
    fitted = _fitted_stats(stats)
    return F.array(*[F.lit(-fitted[c][0] / fitted[c][1]) for c in cols])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and scale columns with fitted statistics; missing values count as zero."""
    fitted = _fitted_stats(stats)

    def scaled(c: str) -> Column:
        value = F.coalesce(named(c).cast("double"), F.lit(0.0))
        return (value - F.lit(fitted[c][0])) / F.lit(fitted[c][1])

    return df.withColumns({c: scaled(c) for c in cols})


def last_steps(df: DataFrame, id: str, time: str, maxlen: int) -> DataFrame:
    """The last ``maxlen`` rows of each id, with ``step`` = their place in the padded sequence.

    The row-number filter is applied per task before the shuffle, so an id with very many rows
    sends at most ``maxlen`` of them from each task.
    """
    backwards = W.partitionBy(id).orderBy(F.col(time).desc())
    return (
        df.withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") <= maxlen)
        .withColumn("step", F.lit(maxlen) - F.col("_back"))
        .drop("_back")
    )


def pad_sequences(
    df: DataFrame,
    id: str,
    time: str,
    cols: Sequence[str],
    maxlen: int,
    label: str | None = None,
    pad: Column | float = 0.0,
) -> DataFrame:
    """One row per id: ``features``, an array of exactly ``maxlen`` steps of ``cols``.

    Short series get padding in front, long ones keep their last steps.  ``pad`` is one value
    for all columns, or an array column with one per column (see ``scaled_zero``).  The label
    travels in an array of its own, padded with 0.  A gathered group holds at most ``maxlen``
    rows.
    """
    padding = pad if isinstance(pad, Column) else F.array(*[F.lit(float(pad))] * len(cols))
    filled = F.array(*[F.coalesce(named(c).cast("double"), F.lit(0.0)) for c in cols])
    fields = [F.col("step"), filled.alias("x")]
    if label is not None:
        fields.append(F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y"))
    gathered = (
        last_steps(df, id, time, maxlen)
        .groupBy(id)
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_seq"))
    )
    missing = F.lit(maxlen) - F.size("_seq")
    front = F.array_repeat(padding, missing)
    out = [F.concat(front, F.col("_seq.x")).alias("features")]
    if label is not None:
        out.append(F.concat(F.array_repeat(F.lit(0), missing), F.col("_seq.y")).alias("labels"))
    return gathered.select(id, F.size("_seq").alias("n_steps"), *out)


def one_hot_label(label: str | Column) -> Column:
    """A 0/1 label as ``[not y, y]``; for an array of labels, one pair per step."""
    c = F.col(label) if isinstance(label, str) else label
    return F.array(F.lit(1) - c, c)


def one_hot_labels(labels: str) -> Column:
    return F.transform(F.col(labels), one_hot_label)

