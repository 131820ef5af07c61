"""Helpers the operators share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.session import shared_folder, stored, tables_folder, workspace

__all__ = [
    "documents_of", "few_tasks", "fold_of", "fresh", "list_column", "partitions_of", "path_for", "stored", "streamed_sha256", "tables_folder", "text_of",
    "with_uid", "workspace",
]

#: Rows of a narrow table that a task takes at least.
TASK_ROWS = 1 << 14


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that further columns can't clash with those of an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0 of the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """A stored copy of ``df`` with one number per row.

    It is stored because row numbers are only repeatable on files: a task that is run again after
    the loss of an executor must give each row the number it had before.
    """
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in no more tasks and files than those fill."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def path_for(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def list_column(values: np.ndarray, lengths: Iterable[int]) -> pa.ListArray:
    """An Arrow list column from concatenated values."""
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def streamed_sha256(parts: DataFrame, key: str, order: str, part: str, name: str, between: str = ",") -> DataFrame:
    """(key, name): SHA-256 (hex) of the texts ``part`` of a key in ``order``, joined by ``between``; they stream through a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def made(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([d for _, d in pairs], pa.string())], names=[key, name])

        for b in batches:
            done = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                else:
                    state.update(between.encode())
                state.update(text.encode())
            yield made(done)
        if state is not None:
            yield made([(now, state.hexdigest())])

    rows = parts.repartition(partitions_of(parts.sparkSession), key).sortWithinPartitions(key, order)
    return rows.select(F.col(key).cast("string").alias(key), part).mapInArrow(run, f"{key} string, {name} string")
