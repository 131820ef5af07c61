"""Operators on wide time series: fusing, aligning, resampling, shifting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions.columns import named, slot_after, slot_number, slot_of, slots_between
from slotwise.session import stored

#: Slots that one row is exploded to at a time; longer gaps take two levels.
GAP_BLOCK = 1000

#: Slots of one id that a window group holds, besides the few copied from its neighbours.
SLOT_BLOCK = 1000


def fuse_measure(
    sources: Sequence[tuple[DataFrame, str]], keys: Sequence[str], out: str
) -> DataFrame:
    """One measure from several sources: union without exact repeats, nulls left out.

    Sources that disagree at one time both survive; ``collapse_duplicates`` averages them.
    """
    parts = [df.select(*keys, F.col(col).alias(out)).dropna(subset=[out]) for df, col in sources]
    return reduce(DataFrame.unionByName, parts).distinct()


def align_series(
    frames: Sequence[DataFrame],
    keys: Sequence[str],
    fused: Mapping[str, Sequence[str]] | None = None,
    repeated: Sequence[DataFrame] = (),
) -> DataFrame:
    """Full outer merge of several series on the same keys.

    The series share no column names but the keys.  They are stacked and grouped once, rather than
    merged one after the other, so each of them is computed once.  ``frames`` must be unique per
    key; one that is not is an error.  A series in ``repeated`` may hold any number of rows per key:
    each of them gives a row, as in an outer merge.

    ``fused`` maps a new column to the columns it is fused from: each distinct value of them
    gives a row, as if they had been united by ``fuse_measure`` and merged.  Rows with a null key
    are left out.

    Only one row per key is grouped.  Repeated rows and fused values stay rows and are joined to it
    one series after the other, each result stored, so run-time skew handling can split a key with
    very many of them.  Without either, the merge is one shuffle and nothing is stored.
    """
    fused = dict(fused or {})
    sources = {c for names in fused.values() for c in names}
    own = [[c for c in df.columns if c not in keys and c not in sources] for df in (*frames, *repeated)]
    stacked = [
        df.dropna(subset=list(keys)).withColumn("_series", F.lit(i))
        for i, df in enumerate((*frames, *repeated))
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    several = range(len(frames), len(own))
    if fused or repeated:
        merged = stored(merged)
    out = merged.groupBy(*keys).agg(
        *[F.max(c).alias(c) for names in own[: len(frames)] for c in names],
        *[
            reduce(lambda a, b: a + b, [F.count(c) for c in names]).alias(f"_n_{name}")
            for name, names in fused.items()
        ],
        *[F.count_if(F.col("_series") == i).alias(f"_n_{i}") for i in range(len(own))],
    )
    once = reduce(lambda a, b: a & b, [F.col(f"_n_{i}") < 2 for i in range(len(frames))], F.lit(True))
    failure = F.raise_error(F.lit("a series repeats a key: name it in `repeated`")).cast("boolean")
    out = out.filter(F.when(once, F.lit(True)).otherwise(failure))
    columns = [c for names in own for c in names]
    many = [
        (f"_n_{name}", fuse_measure([(merged, c) for c in names], keys, name))
        for name, names in fused.items()
    ]
    many += [
        (f"_n_{i}", merged.filter(F.col("_series") == i).select(*keys, *own[i])) for i in several
    ]
    if many:
        single = out = stored(out)
    for count, rows in many:
        # keys the series lacks get a row of nulls, so an inner join, which can split either side, keeps all
        missing = single.filter(F.col(count) == 0).select(*keys)
        out = stored(out.join(rows.unionByName(missing, allowMissingColumns=True), list(keys)))
    return out.select(*keys, *columns, *fused)


def attach_static(series: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Left join of one static row per entity.

    No broadcast is forced: a static table that is small enough is broadcast by its size.
    """
    return series.join(static, key, "left")


def collapse_duplicates(
    df: DataFrame,
    keys: Sequence[str],
    means: Sequence[str],
    maxima: Sequence[str] = (),
    drop_if_empty: bool = True,
) -> DataFrame:
    """One row per key: the mean of each measure, the largest of each column in ``maxima``.

    Stage-like labels belong in ``maxima``: a mean of stages would be a fraction.  Rows whose
    every value is null are dropped.
    """
    out = df.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in means], *[F.max(c).alias(c) for c in maxima]
    )
    return out.dropna(how="all", subset=[*means, *maxima]) if drop_if_empty else out


def resample(
    df: DataFrame,
    id: str,
    time: str,
    width: str = "6 hours",
    numeric: Sequence[str] = (),
    discrete: Sequence[str] = (),
    fill_gaps: bool = True,
    slot: str = "slot",
) -> DataFrame:
    """Irregular series to a regular grid of left-closed slots, labelled by their start.

    Numeric columns take the mean of a slot and discrete ones the largest value.  With
    ``fill_gaps`` the empty slots between an id's first and last one appear with nulls.

    Rows are reduced to slots before they are shuffled.  The grid itself is laid out from each id's
    first and last slot, by blocks of slots and then inside each block, and the occupied slots are joined
    to it by id and slot, so neither an id with very many rows nor a gap of any length meets in one
    task; ``long_gaps`` reports such gaps.
    """
    slots = (
        df.filter(F.col(id).isNotNull())
        .groupBy(id, slot_of(time, width).alias(slot))
        .agg(*[F.avg(c).alias(c) for c in numeric], *[F.max(c).alias(c) for c in discrete])
    )
    if not fill_gaps:
        return slots
    spans = slots.groupBy(id).agg(F.min(slot).alias("_start"), F.max(slot).alias("_end"))
    last = slots_between(F.col("_start"), F.col("_end"), width).alias("_last")
    spans = spans.filter(F.col("_start").isNotNull()).select(id, "_start", last)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(GAP_BLOCK).cast("long")))
    blocks = spans.select("*", block.alias("_first")).repartition(id, "_first")
    step = F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + GAP_BLOCK - 1, F.col("_last"))))
    grid = blocks.select(id, "_start", step.alias("_k"))
    grid = grid.select(id, slot_after(F.col("_start"), F.col("_k"), width).alias(slot))
    return grid.join(slots, [id, slot], "left").select(id, slot, *numeric, *discrete)


def long_gaps(df: DataFrame, id: str, time: str, slots: int, width: str = "6 hours") -> DataFrame:
    """Gaps of more than ``slots`` slots between neighbouring occupied ones: id, start, end, n_slots."""
    own = df.filter(F.col(id).isNotNull()).select(id, slot_of(time, width).alias("start")).distinct()
    following = F.lead("start").over(W.partitionBy(id).orderBy("start"))
    gaps = own.withColumn("end", following)
    gaps = gaps.withColumn("n_slots", slots_between(F.col("start"), F.col("end"), width))
    return gaps.filter(F.col("n_slots") > slots)


def shift_label(
    df: DataFrame,
    id: str,
    time: str,
    label: str,
    steps: int = 8,
    binary: bool = True,
    horizon: str | None = None,
    width: str | None = None,
) -> DataFrame:
    """Replace the label by the one ``steps`` rows ahead of the same id.

    Missing labels count as 0 before the shift, rows without a future label are dropped, and
    with ``binary`` any stage above 0 becomes 1.  On a gap-free grid ``steps`` rows are a fixed
    time.  With ``horizon`` the label must lie exactly that far ahead in time, and rows for
    which that slot is missing are dropped.

    The input must be a slot grid (one row per id and slot, as ``resample`` makes).  With ``width``, the
    width of its slots, the label must lie exactly ``steps`` slots ahead, which is the same on a
    gap-free grid, and an id's slots are cut into blocks for many tasks.  Without it rows are counted
    and an id's whole grid is one group.  Rows without a time have no label ahead.
    """
    current = F.coalesce(F.col(label), F.lit(0))
    if horizon is None and width is not None:
        shifted = _beside(df, id, time, width, {"_ahead": steps}, current.alias("value"))
        shifted = shifted.filter(F.col("_ahead").isNotNull()).withColumn(label, F.col("_ahead.value"))
    elif horizon is None:
        order = W.partitionBy(id).orderBy(time)
        shifted = df.withColumn(label, F.lead(current, steps).over(order))
        shifted = shifted.filter(F.col(label).isNotNull())
    else:
        earlier = F.col(time) - F.expr(f"INTERVAL {horizon}")
        ahead = df.select(id, earlier.alias(time), current.alias("_ahead"))
        shifted = df.join(ahead, [id, time]).withColumn(label, F.col("_ahead"))
    if binary:
        shifted = shifted.withColumn(label, (F.col(label) > 0).cast("int"))
    return shifted.select(*map(named, df.columns))


def neighbour_features(
    df: DataFrame,
    id: str,
    time: str,
    cols: Sequence[str],
    lags: Sequence[int] = (1, 0, -1),
    default: float = 0.0,
    width: str | None = None,
) -> DataFrame:
    """Add the values of neighbouring steps as columns ``<c>_lag<k>`` / ``<c>_lead<k>``.

    A lag of 0 is the column itself.  Negative lags look ahead in time: the default
    (previous, current, next) is what a centred convolution of width 3 sees, and it leaks one
    future slot into each row.  ``lags=(0, 1, 2)`` is the causal form.

    The input must be a slot grid, as for ``shift_label``, and ``width`` is the width of its slots: with it,
    steps are slots and an id's slots are cut into blocks for many tasks.
    """
    wanted = [k for k in lags if k != 0]
    order = W.partitionBy(id).orderBy(time)

    def title(c: str, k: int) -> str:
        return f"{c}_{'lag' if k > 0 else 'lead'}{abs(k)}"

    if width is None:
        def neighbour(c: str, k: int) -> Column:
            value = named(c)
            shifted = F.lag(value, k, default) if k > 0 else F.lead(value, -k, default)
            return shifted.over(order)

        return df.withColumns({title(c, k): neighbour(c, k) for c in cols for k in wanted})

    values = [named(c).alias(f"v{i}") for i, c in enumerate(cols)]
    rows = _beside(df, id, time, width, {f"_at{j}": -k for j, k in enumerate(wanted)}, *values)

    def found(i: int, j: int) -> Column:
        outside = F.lit(default).cast(df.select(named(cols[i])).schema[0].dataType)
        return F.when(F.col(f"_at{j}").isNull(), outside).otherwise(F.col(f"_at{j}.v{i}"))

    added = {title(c, k): found(i, j) for i, c in enumerate(cols) for j, k in enumerate(wanted)}
    return rows.withColumns(added).drop(*[f"_at{j}" for j in range(len(wanted))])


def _beside(
    df: DataFrame, id: str, time: str, width: str, offsets: Mapping[str, int], *values: Column
) -> DataFrame:
    """Add one column per offset: ``values`` of the same id's row that many slots ahead (behind, where
    negative), as a struct that is null when there is no such row.

    An id's slots are cut into blocks of ``SLOT_BLOCK``.  A row goes to its own block and to those of the rows
    that look at it, so each block finds all it needs in one task and only rows near a border are copied.
    """
    rows = df.withColumn("_slot", slot_number(F.col(time), width))

    def block(ahead: int) -> Column:
        return F.floor((F.col("_slot") - ahead) / SLOT_BLOCK)

    homes = F.array_distinct(F.array(block(0), *[block(k) for k in offsets.values()]))
    copies = rows.withColumn("_values", F.struct("_slot", *values)).withColumn("_block", F.explode(homes))
    order = W.partitionBy(id, "_block").orderBy("_slot")
    seen = {
        name: F.when(F.col("_slot").isNotNull(), F.first("_values").over(order.rangeBetween(k, k)))
        for name, k in offsets.items()
    }
    own = copies.withColumns(seen).filter(F.col("_block").eqNullSafe(block(0)))
    return own.select(*map(named, df.columns), *offsets)


def presented(df: DataFrame, id: str, time: str) -> DataFrame:
    """Rows of an id together and in time order inside each file, without a global sort.

    Ranges of (id, time) rather than hashes of the id, so one long series may span several
    tasks.
    """
    return df.repartitionByRange(id, time).sortWithinPartitions(id, time)
