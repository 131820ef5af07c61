"""Mergeable sketches: built once per part of a table, stored, and merged for any union of parts.

Quantiles come from KLL sketches, numbers of distinct values from HLL sketches, both with a stated bound.
A sketch has a size of its own, whatever the number of rows behind it, so a year of daily sketches is
a small table that answers for any group of days without reading the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.columns import named

#: Accuracy of the quantile sketches; the error of a rank falls almost in proportion.
KLL_K = 800
#: Binary logarithm of the registers of a distinct sketch.
HLL_LG = 12


def rank_bound(k: int = KLL_K) -> float:
    """Largest error of a rank, as a share of the rows: twice the one that holds in 99 of 100 sketches."""
    return 2 * 2.296 / k**0.9723


def distinct_bound(lg: int = HLL_LG) -> float:
    """Largest relative error of a number of distinct values: five standard errors of merged sketches."""
    return 5 * 1.04 / math.sqrt(2**lg)


def sketch_table(
    df: DataFrame,
    by: Sequence[str],
    values: Sequence[str] = (),
    distinct: Sequence[str] = (),
    k: int = KLL_K,
    lg: int = HLL_LG,
) -> DataFrame:
    """One row per group: ``n`` rows, for each column of ``values`` the number ``n_<c>`` of its values and their
    sketch ``kll_<c>``, for each one of ``distinct`` a sketch ``hll_<c>``.

    Nulls and NaN are no values; a group without any has ``n_<c>`` 0.  A null group key is a group.  Tasks
    build sketches before the shuffle, which moves one per task and group.  Store the result:
    sketches of the same rows differ from run to run inside their bound.
    """
    numbers = {c: F.nanvl(named(c).cast("double"), F.lit(None).cast("double")) for c in values}
    return df.groupBy(*map(named, by)).agg(
        F.count("*").alias("n"),
        *[F.count(v).alias(f"n_{c}") for c, v in numbers.items()],
        *[F.kll_sketch_agg_double(v, F.lit(k)).alias(f"kll_{c}") for c, v in numbers.items()],
        *[F.hll_sketch_agg(named(c), F.lit(lg)).alias(f"hll_{c}") for c in distinct],
    )


def merge_sketches(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups from those of finer ones, with ``n_parts``, how many were merged.

    Merging has map-side parts too, so a group with very many parts is no single task's work.
    """
    counts = [c for c in table.columns if (c == "n" or c.startswith("n_")) and c not in (*by, "n_parts")]
    quantiles = [c for c in table.columns if c.startswith("kll_")]
    distinct = [c for c in table.columns if c.startswith("hll_")]
    return table.groupBy(*map(named, by)).agg(
        F.count("*").alias("n_parts"),
        *[F.sum(named(c)).alias(c) for c in counts],
        *[F.kll_merge_agg_double(named(c)).alias(c) for c in quantiles],
        *[F.hll_union_agg(named(c)).alias(c) for c in distinct],
    )


def rolling_sketches(table: DataFrame, day: str, days: int, by: Sequence[str] = ()) -> DataFrame:
    """Merged sketches of the last ``days`` days up to each day that has rows of its group.

    ``table`` has one row per day and group.  Each row is copied to the days that look back on it; no raw row is read.
    """
    copies = table.withColumn("_own", named(day)).withColumn(
        day, F.explode(F.sequence(named(day), F.date_add(named(day), days - 1)))
    )
    copies = copies.withColumn("n_own", (F.col("_own") == named(day)).cast("long"))
    merged = merge_sketches(copies.drop("_own"), [*by, day])
    return merged.filter(F.col("n_own") > 0).drop("n_own")


def read_sketches(
    table: DataFrame, probs: Mapping[str, tuple[str, float]], distinct: Mapping[str, str] | None = None
) -> DataFrame:
    """Add estimates: ``probs`` maps a new column to a value column and a probability, ``distinct`` to
    a column whose distinct values are counted.  The sketches are left out.

    Null where a group has no value.  The rank of a quantile is off by at most ``rank_bound`` of
    the values, a number of distinct values by at most the part ``distinct_bound``.
    """
    quantiles = {
        name: F.when(
            named(f"n_{c}") > 0, F.kll_sketch_get_quantile_double(named(f"kll_{c}"), F.lit(p))
        )
        for name, (c, p) in probs.items()
    }
    counted = {name: F.hll_sketch_estimate(named(f"hll_{c}")) for name, c in (distinct or {}).items()}
    out = table.withColumns(quantiles | counted)
    return out.drop(*[c for c in table.columns if c.startswith(("kll_", "hll_"))])
