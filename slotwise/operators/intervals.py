"""Interval tables and interval flags on a slot grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions.columns import named, slot_after, slot_floor


def union_intervals(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several interval tables, matched by column name."""
    return reduce(DataFrame.unionByName, frames)


def slot_ranges(
    intervals: DataFrame, id: str, start: str, end: str, width: str, tail: str
) -> DataFrame:
    """The first and last slot each interval touches: ``id, first, last``.

    Touching means that the slot's start lies in the closed interval, or that an end of the
    interval lies in the closed range from the slot's start to ``tail`` before the next slot.
    Forward intervals touch one unbroken run of slots.  Reversed ones (start after end) touch
    by their two ends only.
    """
    one_slot, rest = F.expr(f"INTERVAL {width}"), F.expr(f"INTERVAL {tail}")
    rows = intervals.select(id, F.col(start).alias("_s"), F.col(end).alias("_e")).dropna()
    rows = rows.withColumns(
        {"_ss": slot_floor(F.col("_s"), width), "_es": slot_floor(F.col("_e"), width)}
    )

    def counts(t: str, slot: str) -> Column:
        return F.col(t) <= F.col(slot) + one_slot - rest

    def run(first: Column, last: Column) -> Column:
        return F.struct(first.alias("first"), last.alias("last"))

    start_slot, end_slot = F.col("_ss"), F.col("_es")
    after_start = F.when(counts("_s", "_ss"), start_slot).otherwise(start_slot + one_slot)
    forward = F.array(run(after_start, end_slot))
    by_ends = F.array(
        run(F.when(counts("_s", "_ss"), start_slot), start_slot),
        run(F.when(counts("_e", "_es"), end_slot), end_slot),
    )
    runs = F.when(F.col("_s") <= F.col("_e"), forward).otherwise(by_ends)
    return rows.select(id, F.inline(runs)).filter(F.col("first") <= F.col("last"))


#: Slots that are swept together; the sums of whole blocks are carried on.
SWEEP_BLOCK = 256


def flag_treatments(
    grid: DataFrame,
    treatments: Mapping[str, DataFrame],
    id: str = "id",
    slot: str = "slot",
    width: str = "6 hours",
    tail: str = "1 second",
    start: str = "starttime",
    end: str = "endtime",
    block: int = SWEEP_BLOCK,
) -> DataFrame:
    """Add one column per treatment: 1 where one of its intervals touches the slot, else 0.

    A sweep: the run of slots that an interval touches opens at its first slot and closes after its last, and
    a slot is touched while more runs have opened than closed.  A run is two rows however long
    it is; rows of one id and slot are summed before the shuffle.  An id's time is cut into
    blocks of ``block`` slots, swept by different tasks: each starts with the sums of all
    blocks before it, which are one row per id and block.  The grid is read twice; store it first
    when it is costly.
    """
    names = list(treatments)
    wide = f"{block * _amount(width)[0]} {_amount(width)[1]}"
    runs = union_intervals(
        [
            slot_ranges(table, id, start, end, width, tail).withColumn("_name", F.lit(name))
            for name, table in treatments.items()
        ]
    )
    ends = F.array(
        F.struct(F.col("first").alias(slot), F.lit(1).alias("_step")),
        F.struct(slot_after(F.col("last"), F.lit(1), width).alias(slot), F.lit(-1).alias("_step")),
    )
    steps = (
        runs.select(id, "_name", F.inline(ends))
        .groupBy(id, slot)
        .agg(*[F.sum(F.when(F.col("_name") == n, F.col("_step")).otherwise(0)).alias(f"_d{i}") for i, n in enumerate(names)])
    )
    deltas = [f"_d{i}" for i in range(len(names))]
    at = slot_floor(F.col(slot), wide)
    # a run opened before an id's first block, or a block without steps, still carries its sums
    blocks = steps.select(id, at.alias("_block"), *deltas).unionByName(
        grid.select(id, at.alias("_block")).distinct(), allowMissingColumns=True
    )
    sums = blocks.groupBy(id, "_block").agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in deltas])
    before = W.partitionBy(id).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(id, "_block", *[F.coalesce(F.sum(d).over(before), F.lit(0)).alias(f"_c{d}") for d in deltas])
    rows = grid.withColumn("_grid", F.lit(True)).unionByName(steps, allowMissingColumns=True)
    inside = W.partitionBy(id, "_block").orderBy(slot).rangeBetween(W.unboundedPreceding, W.currentRow)
    swept = rows.withColumn("_block", at).withColumns(
        {f"_s{d}": F.coalesce(F.sum(d).over(inside), F.lit(0)) for d in deltas}
    )
    swept = swept.filter(F.col("_grid")).join(carried, [id, "_block"], "left")
    flags = [
        (F.col(f"_s{d}") + F.coalesce(f"_c{d}", F.lit(0)) > 0).cast("int").alias(n) for n, d in zip(names, deltas, strict=True)
    ]
    return swept.select(*map(named, grid.columns), *flags)


def _amount(width: str) -> tuple[int, str]:
    """The number and the unit of an interval such as ``6 hours``."""
    number, unit = width.split()
    return int(number), unit


def flag_intervals(
    grid: DataFrame, intervals: DataFrame, name: str, **columns: str
) -> DataFrame:
    """Add column ``name``: 1 where an interval touches the slot, else 0.

    The keyword arguments are those of ``flag_treatments``.
    """
    return flag_treatments(grid, {name: intervals}, **columns)
