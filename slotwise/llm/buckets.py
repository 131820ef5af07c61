"""Comparison of all members of hash buckets, with large buckets cut into blocks.

A bucket of n members is cut into n / BLOCK blocks by the members' hash, and each pair of blocks is
compared in a place of its own, so no task holds more than two blocks at a time and every pair is met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import partitions_of, stored

BLOCK = 2048
#: Verified pairs held before they are folded into links to the smallest member.
FOLD = 1 << 20


def oversized(members: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """Buckets of more than ``block`` members with their number of blocks; a stored table."""
    sizes = members.groupBy(*key).count().where(F.col("count") > block)
    return stored(sizes.select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks")))


def in_blocks(members: DataFrame, key: list[str], id_col: str, large: DataFrame) -> DataFrame:
    """``members`` once per pair of blocks (lo, hi) they belong to, dealt out and sorted by bucket and pair."""
    rows = members.join(large, key, "left")
    own = F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(own, i).alias("lo"), F.greatest(own, i).alias("hi")))
    alone = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("blocks") > 1, others).otherwise(alone)))
    rows = rows.select(*members.columns, F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), F.when(F.col("blocks") > 1, own).otherwise(0).alias("own"))
    place = [*key, "lo", "hi"]
    return rows.repartition(partitions_of(members.sparkSession), *place).sortWithinPartitions(*place)


def whole_groups(batches: Iterator[pa.RecordBatch], place: int, least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, equal in the first ``place`` columns, with each row's group number."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            group = _numbered(table, place)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield table.slice(0, cut), group[:cut]
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
            least = max(least, 2 * count)
    if count:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _numbered(table, place)


def _numbered(table: pa.Table, place: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for i in range(place):
        x = table.column(i).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def pairs(group: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal group, in portions of about ``most``.  ``group`` ascends."""
    end = np.searchsorted(group, group, side="right")
    active, lag, left, right, held = np.arange(len(group)), 1, [], [], 0
    while len(active):
        active = active[active + lag < end[active]]
        for at in range(0, len(active), most):
            part = active[at : at + most]
            left.append(part)
            right.append(part + lag)
            held += len(part)
            if held >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
        lag += 1
    if held:
        yield np.concatenate(left), np.concatenate(right)


class Links:
    """Folds verified pairs of positions into a link from each position to the smallest one it reaches."""

    def __init__(self, n: int):
        self.label, self.left, self.right, self.held = np.arange(n), [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.left.append(i)
        self.right.append(j)
        self.held += len(i)
        if self.held > FOLD:
            self._fold()

    def _fold(self) -> None:
        if not self.held:
            return
        i, j, label = np.concatenate(self.left), np.concatenate(self.right), self.label
        while len(i):
            a, b = label[i], label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
        self.label, self.left, self.right, self.held = label, [], [], 0

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions with a smaller one to link to, and that one."""
        self._fold()
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return own, self.label[own]


def linked(rows: DataFrame, place: int, verify: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray], ids: str) -> DataFrame:
    """Edges (a, b) that join the ids of all verified pairs of ``rows``, as from ``in_blocks``.

    ``verify`` gets a table of whole groups and index pairs, and says which pairs hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, place):
            links, names = Links(table.num_rows), table.column(ids).to_numpy()
            for i, j in pairs(group):
                good = verify(table, i, j)
                links.add(i[good], j[good])
            a, b = links.stars()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.int64()), pa.array(names[b], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")
