"""Exact ranks, running sums and quantiles over whole tables, without a one-task sort.

Each of them works in two levels: rows are split into parts that fit a task, the totals of the
parts (a table as short as the number of parts) give each part its starting offset, and ranks
inside a part are added to the offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions.columns import any_of, row_hash
from slotwise.session import stored

ROWS_PER_BUCKET = 100_000
SKETCH_GROUPS = 64


def _range_parts(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str], descending: bool
) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` by range of (by, order); return the rows and the offset of each part.

    Where the ranges lie depends on a sample, so the split is stored: offsets and rows then
    always come from the same split, also when an executor is lost.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    parts = stored(df.repartitionByRange(*by, key).withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = totals.withColumns(
        {f"_before_{c}": F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)) for c in sums}
        | {f"_total_{c}": F.sum(f"_sum_{c}").over(W.partitionBy(*by)) for c in sums}
    )
    return parts, offsets


def cumulative(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<c>``, the inclusive running sum of each column in ``order``, and ``total_<c>``,
    its sum over the whole group.

    ``order`` must be unique within ``by``: pre-aggregate first.
    """
    parts, offsets = _range_parts(df, order, sums, by, descending)
    key = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy(*by, "_part").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    joined = _with_offsets(parts, offsets, by)
    running = {f"cum_{c}": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in sums}
    totals = {f"total_{c}": F.col(f"_total_{c}") for c in sums}
    return joined.withColumns(running | totals).select(*df.columns, *running, *totals)


def _with_offsets(parts: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    renamed = offsets.withColumnsRenamed({c: f"_o_{c}" for c in (*by, "_part")})
    condition = parts["_part"] == renamed["_o__part"]
    for c in by:
        condition &= parts[c].eqNullSafe(renamed[f"_o_{c}"])
    return parts.join(renamed, condition).drop(*[f"_o_{c}" for c in (*by, "_part")])


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    name: str = "feature",
    accuracy: int = 1000,
) -> DataFrame:
    """Exact quantiles with linear interpolation over the non-null values of each column.

    One row per column: its name and ``q0 .. qk`` for the given probabilities (null for a column
    without values).  The quantiles are fitted when the function is called, so the result is a
    local table of ``len(cols)`` rows that later plans use without computing it again.

    Sketches bracket each wanted rank, exact counts confirm the brackets, and only the values
    inside a bracket (about one percent of the rows) are shuffled and ranked.  The input is read
    three times; store it first when it is costly.
    """
    doubles = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols]
    values = df.select(*[v.alias(f"c{i}") for i, v in enumerate(doubles)])
    targets = [_Target(i, p) for i in range(len(cols)) for p in probs]
    pending, margin = targets, 5.0 / accuracy
    while pending:
        _bracket(values, pending, margin, accuracy)
        _count(values, pending)
        pending = [t for t in pending if not t.covered()]
        margin *= 10
    _rank(values, [t for t in targets if t.size and t.low != t.high])
    rows = [
        {name: c, **{f"q{j}": targets[i * len(probs) + j].value() for j in range(len(probs))}}
        for i, c in enumerate(cols)
    ]
    schema = pa.schema([(name, pa.string()), *[(f"q{j}", pa.float64()) for j in range(len(probs))]])
    return df.sparkSession.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


@dataclass
class _Target:
    """One wanted quantile: its column, the bracket around it and what is known about it."""

    col: int
    prob: float
    low: float = -math.inf
    high: float = math.inf
    size: int = 0
    below: int = 0
    inside: int = 0
    found: dict[int, float] = field(default_factory=dict)
    sketches: list[tuple[float, float]] = field(default_factory=list)

    @property
    def position(self) -> float:
        return max(self.size - 1, 0) * self.prob

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)

    def covered(self) -> bool:
        first, last = self.ranks
        return not self.size or self.below <= first and last < self.below + self.inside

    def value(self) -> float | None:
        if not self.size:
            return None
        first, last = (self.found.get(r, self.low) for r in self.ranks)
        return first + (last - first) * (self.position - math.floor(self.position))


def _bracket(values: DataFrame, targets: list[_Target], margin: float, accuracy: int) -> None:
    """Bracket each target from approximate quantiles a margin below and above it.

    Sketches are merged in a fixed number of groups rather than in one task, and a few numbers
    per group are fetched: the quantile of the whole lies between the smallest and the largest
    one of the groups.
    """

    by_column: dict[int, list[_Target]] = {}
    for t in targets:
        by_column.setdefault(t.col, []).append(t)

    def sketch(c: int) -> Column:
        points = [max(t.prob - margin, 0.0) for t in by_column[c]]
        points += [min(t.prob + margin, 1.0) for t in by_column[c]]
        listed = F.array(*[F.lit(p) for p in points])
        return F.percentile_approx(f"c{c}", listed, F.lit(accuracy)).alias(f"s{c}")

    groups = values.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_group"))
    for row in groups.agg(*[sketch(c) for c in by_column]).collect():
        for c, wanted in by_column.items():
            for k, t in enumerate(wanted if row[f"s{c}"] else []):
                low, high = row[f"s{c}"][k], row[f"s{c}"][k + len(wanted)]
                t.sketches.append((low, high))
    for t in targets:
        lows, highs = zip(*t.sketches, strict=True) if t.sketches else ((), ())
        t.low = min(lows) if lows and t.prob > margin else -math.inf
        t.high = max(highs) if highs and t.prob < 1 - margin else math.inf
        t.sketches = []


def _count(values: DataFrame, targets: list[_Target]) -> None:
    """Count exactly how many values lie below and inside each bracket."""
    sizes = {t.col: F.count(f"c{t.col}").alias(f"size{t.col}") for t in targets}
    below = [F.count_if(F.col(f"c{t.col}") < t.low) for t in targets]
    up_to = [F.count_if(F.col(f"c{t.col}") <= t.high) for t in targets]
    counts = values.agg(
        *sizes.values(),
        *[c.alias(f"below{k}") for k, c in enumerate(below)],
        *[c.alias(f"up_to{k}") for k, c in enumerate(up_to)],
    ).first()
    for k, t in enumerate(targets):
        t.size, t.below = counts[f"size{t.col}"], counts[f"below{k}"]
        t.inside = counts[f"up_to{k}"] - t.below


def _rank(values: DataFrame, targets: list[_Target]) -> None:
    """Find the values at the wanted ranks among those inside the brackets.

    Values outside every bracket of their column are left out before anything is joined or
    shuffled; the table of brackets is as short as the list of targets and is broadcast.
    """
    if not targets:
        return
    brackets: dict[int, list[Column]] = {}
    for t in targets:
        inside = F.col(f"c{t.col}").between(F.lit(t.low), F.lit(t.high))
        brackets.setdefault(t.col, []).append(inside)
    pairs = [
        F.struct(F.lit(c).alias("c"), F.when(any_of(inside), F.col(f"c{c}")).alias("v"))
        for c, inside in brackets.items()
    ]
    candidates = values.select(F.inline(F.array(*pairs))).filter(F.col("v").isNotNull())
    table = pa.table(
        {
            "k": pa.array(range(len(targets)), pa.int32()),
            "c": pa.array([t.col for t in targets], pa.int32()),
            "low": pa.array([t.low for t in targets], pa.float64()),
            "high": pa.array([t.high for t in targets], pa.float64()),
        }
    )
    wanted = F.broadcast(values.sparkSession.createDataFrame(table))
    inside = candidates.join(wanted, "c").filter(F.col("v").between(F.col("low"), F.col("high")))
    counts = inside.groupBy("k", "v").agg(F.count("*").alias("n"))
    running = cumulative(counts, "v", ["n"], by=["k"])
    ranks = {
        "k": pa.array([k for k, t in enumerate(targets) for _ in t.ranks], pa.int32()),
        "r": pa.array([r - t.below for t in targets for r in t.ranks], pa.int64()),
    }
    asked = F.broadcast(values.sparkSession.createDataFrame(pa.table(ranks)))
    reached = running.join(asked, "k").filter(F.col("cum_n") > F.col("r"))
    for row in reached.groupBy("k", "r").agg(F.min("v").alias("v")).collect():
        t = targets[row["k"]]
        t.found[row["r"] + t.below] = row["v"]


def quantile(df: DataFrame, col: str, prob: float) -> DataFrame:
    """One row, one column ``value``: the exact quantile of ``col``."""
    return exact_quantiles(df, [col], [prob]).select(F.col("q0").alias("value"))


def bucket_count(df: DataFrame) -> int:
    """Hash buckets for the rows of ``df``, so many that each fits a task whatever the table's size."""
    return max(1, math.ceil(df.count() / ROWS_PER_BUCKET))


def shuffled_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    by: Sequence[str] = (),
    rank: str = "rank",
    buckets: int | None = None,
    fn: str = "xxhash64",
) -> DataFrame:
    """Number rows 0, 1, 2 ... in a reproducible random order.

    ``keys`` must identify a row (within ``by``).  Rows fall evenly into hash buckets, each
    ranked on its own and placed after the buckets before it.  Without ``buckets`` their number follows
    from a count of the rows.
    """
    buckets = buckets or bucket_count(df)
    hashed = df.withColumn("_hash", row_hash([*by, *keys] if fn != "arithmetic" else keys, seed, fn))
    hashed = hashed.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*by, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    inside = W.partitionBy(*by, "_bucket").orderBy("_hash", *keys)
    return (
        hashed.join(offsets, [*by, "_bucket"])
        .withColumn(rank, F.col("_before") + F.row_number().over(inside) - 1)
        .select(*df.columns, rank)
    )
