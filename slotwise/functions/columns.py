"""Column expressions shared by the operators; all stay inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def quoted(name: str) -> str:
    """A column name that may hold dots or spaces, as encoded category names do."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Sequence[Column]) -> Column:
    """True when at least one condition is true."""
    return reduce(lambda a, b: a | b, conditions)


def slot_of(time: str | Column, width: str) -> Column:
    """Start of the left-closed slot that contains ``time``; slots are aligned to midnight when
    ``width`` divides a day."""
    return F.window(_col(time), width).getField("start")


def slot_floor(time: Column, width: str) -> Column:
    """Same slot as ``slot_of``, as arithmetic on the epoch that one projection may repeat."""
    origin = _epoch()
    micros = F.timestamp_diff("MICROSECOND", origin, time.cast("timestamp_ntz"))
    return F.timestamp_add("MICROSECOND", micros - F.pmod(micros, _micros_of(width)), origin)


def slots_between(first: Column, last: Column, width: str) -> Column:
    """How many slots lie from one slot start to another."""
    return F.floor(F.timestamp_diff("MICROSECOND", first, last) / _micros_of(width))


def slot_after(first: Column, steps: Column, width: str) -> Column:
    """The slot start a number of slots after another one."""
    return F.timestamp_add("MICROSECOND", steps * _micros_of(width), first)


def slot_number(time: Column, width: str) -> Column:
    """Number of the slot that contains ``time``, counted from the epoch; neighbouring slots differ by one."""
    return slots_between(_epoch(), time.cast("timestamp_ntz"), width)


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros_of(width: str) -> Column:
    """Length of an interval in microseconds; a constant once the plan is optimised."""
    return F.timestamp_diff("MICROSECOND", _epoch(), _epoch() + F.expr(f"INTERVAL {width}"))


def days_between(start: str | Column, end: str | Column) -> Column:
    """Elapsed time in fractional days, exact to the microsecond."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return micros.cast("double") / F.lit(float(MICROS_PER_DAY))


def nonzero_mean(c: str | Column) -> Column:
    """Aggregate: mean of the values other than zero, 0 when there is none."""
    return F.coalesce(F.avg(F.when(_col(c) != 0, _col(c))), F.lit(0.0))


def first_nonnull(c: str | Column, order: str | Column) -> Column:
    """Aggregate: the non-null value that comes first in ``order``, the smallest one of equal places."""
    place = F.struct(_col(order).alias("order"), _col(c).alias("value"))
    return F.min_by(_col(c), F.when(_col(c).isNotNull(), place))


def sigmoid(c: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def binarize(c: str | Column, threshold: float) -> Column:
    """1 when strictly above the threshold, else 0; null stays null."""
    return F.when(_col(c).isNotNull(), (_col(c) > threshold).cast("int"))


def row_hash(keys: Sequence[str | Column], seed: int, fn: str = "xxhash64") -> Column:
    """A reproducible pseudo-random number per key.

    ``arithmetic`` takes one integer key and can be repeated on any SQL engine;
    ``xxhash64`` mixes far better and is the default.  ``multiplicative`` also takes one integer key
    (below 2**31 in size), has 32 bits and can be repeated in SQL.
    """
    if fn == "multiplicative":
        (key,) = keys
        return F.pmod(_col(key) * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32)).cast("bigint")
    if fn == "arithmetic":
        (key,) = keys
        return F.pmod(_col(key) * F.lit(7919) + F.lit(seed), F.lit(1000)).cast("bigint")
    return F.xxhash64(*[_col(k) for k in keys], F.lit(seed))


def hash_range(hash: str | Column, fn: str = "xxhash64") -> Column:
    """One of 65,536 ranges of a row hash (1,000 for ``arithmetic``), ascending with the hash."""
    dropped = {"arithmetic": 0, "multiplicative": 16, "xxhash64": 48}[fn]
    return F.shiftright(_col(hash), dropped).cast("int")


def hash_bucket(
    keys: Sequence[str | Column], seed: int, buckets: int, fn: str = "xxhash64"
) -> Column:
    """The row hash folded to ``0 .. buckets-1``."""
    return F.pmod(row_hash(keys, seed, fn), F.lit(buckets)).cast("int")
