"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised.  Each of ``TABLES`` tables hashes a vector by ``PROJECTIONS`` random projections,
shifted and cut into cells of ``WIDTH``; vectors of one label that share a bucket in some table are compared by
exact cosine in double precision.  Equal vectors of one label are one class, compared once however many
there are.  A pair at the least cosine shares a bucket of a table with probability about 0.25, so forty
tables miss it once in about 80,000 such pairs; closer pairs are missed less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.buckets import BLOCK, Links, in_blocks, pairs, whole_groups
from slotwise.llm.common import list_column, stored
from slotwise.llm.components import connected_components

TABLES, PROJECTIONS, WIDTH, SEED = 40, 8, 1.0, 20240229
LEAST_COSINE = 0.98


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and shifts, the same in every task."""
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def bucket_keys(unit: np.ndarray) -> np.ndarray:
    """One 64-bit key per vector and table."""
    directions, shifts = _projections(unit.shape[1])
    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    key = np.zeros((len(unit), TABLES), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(PROJECTIONS):
            key = (key ^ cells[:, :, i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def usable(vector: str = "embedding") -> Column:
    """Vectors with finite components only, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, normalised rows) of a list column, by number of components.

    Rows are divided by their largest component first, so that squares neither overflow nor vanish.
    """
    offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        rows = values[offsets[:-1][at][:, None] + np.arange(dim)].astype(np.float64)
        rows /= np.abs(rows).max(axis=1, keepdims=True)
        yield at, rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, label, class_id) of all usable vectors with a label, and classes (class_id, label, vector, copies)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & usable("vector")).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    classes = rows.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("class_id", F.monotonically_increasing_id()))
    return rows.join(classes.select("label", "vector", "class_id"), ["label", "vector"]).select("vec_id", "label", "class_id"), classes


def table_keys(classes: DataFrame) -> DataFrame:
    """(class_id, table_no, key, keys): one row per class and table; ``key`` also holds label and number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.zeros((b.num_rows, TABLES), np.int64)
            for at, unit in _units(b.column(1)):
                keys[at] = bucket_keys(unit)
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(keys.ravel(), [TABLES] * b.num_rows)], names=["class_id", "keys"])

    keyed = classes.select("class_id", "vector").mapInArrow(run, "class_id long, keys array<long>")
    return keyed.join(classes.select("class_id", "label", F.size("vector").alias("dim")), "class_id")


def near_classes(classes: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """(a, b, n): links found, folded within each place of comparison.

    A row with ``n`` gives class ``a`` that many links to vectors of other classes; a row with ``b`` joins the two.
    Every pair counts in the first table that brings it together, and there in one place only.
    """
    keyed = stored(table_keys(classes))
    spread = keyed.select("class_id", "label", "dim", F.posexplode("keys").alias("table_no", "key"))
    place = ["label", "dim", "table_no", "key"]
    sizes = stored(spread.groupBy(*place).count().where("count > 1"))
    blocks = sizes.select(*place, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    near = spread.join(blocks, place).drop("blocks")
    number = F.xxhash64("label", "dim", "table_no", "key")
    near = near.select("class_id", "table_no", number.alias("bucket"))
    large = stored(blocks.where("blocks > 1").select(number.alias("bucket"), "blocks"))
    full = keyed.select("class_id", "label", "keys").join(classes.select("class_id", "vector", "copies"), "class_id")
    rows = in_blocks(near.join(full, "class_id"), ["bucket"], "class_id", large)
    rows = rows.select("bucket", "lo", "hi", "own", "class_id", "table_no", "keys", "copies", "vector", F.xxhash64("label").alias("label_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, 3):
            yield from _compared(table, group, least)

    return rows.mapInArrow(run, "a long, b long, n long")


def _compared(table: pa.Table, group: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    column = lambda name: table.column(name).combine_chunks()
    lo, hi, own = (column(x).to_numpy() for x in ("lo", "hi", "own"))
    ids, copies, number = column("class_id").to_numpy(), column("copies").to_numpy(), column("table_no").to_numpy()
    keys = column("keys").values.to_numpy().reshape(-1, TABLES)
    label = column("label_hash").to_numpy()
    vectors = column("vector")
    sizes = np.diff(vectors.offsets.to_numpy())
    unit = np.zeros((table.num_rows, sizes.max()))
    for at, rows in _units(vectors):
        unit[at, : rows.shape[1]] = rows
    links, counts = Links(table.num_rows), np.zeros(table.num_rows, np.int64)
    for i, j in pairs(group, 1 << 16):
        # members of one block meet in that block's own place only
        good = ((lo[i] == hi[i]) | (own[i] != own[j])) & (label[i] == label[j]) & (sizes[i] == sizes[j])
        i, j = i[good], j[good]
        same = keys[i] == keys[j]
        first = np.argmax(same, axis=1) == number[i]
        i, j = i[first], j[first]
        good = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        i, j = i[good], j[good]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        links.add(i, j)
    a, b = links.stars()
    linked = np.flatnonzero(counts)
    if len(linked):
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[linked], ids[a]])),
                pa.concat_arrays([none(len(linked)), pa.array(ids[b], pa.int64())]),
                pa.concat_arrays([pa.array(counts[linked], pa.int64()), none(len(a))]),
            ],
            names=["a", "b", "n"],
        )


def embedding_components(vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is at least ``least``.  Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing; vectors of different length neither.
    ``n_links`` counts other vectors, copies included; ``component_id`` is the smallest vec_id reachable.
    """
    members, classes = classes_of(vectors)
    found = stored(near_classes(classes, least, block))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("near"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class_id")
    known = classes.select("class_id", "copies", "least").join(counts, "class_id", "left").join(roots, "class_id", "left")
    known = stored(known.select("class_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "class_id").alias("root"), "least"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(known.join(smallest, "root").select("class_id", "n_links", "component_id"), "class_id").select("vec_id", "n_links", "component_id")
    rest = vectors.where(F.col("label").isNull() | ~usable("embedding"))
    alone = rest.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
