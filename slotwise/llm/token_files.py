"""Token files: Parquet with one row per document, in ascending id order.

``ids`` is a list column with dictionary encoding (a vocabulary fits one dictionary page), the ascending
columns use delta encoding, row groups have a set size, and pages are short and indexed, so that a reader
asking for a range of documents, or for the metadata alone, skips the rest.  Spark's own writer makes the
files; a range exchange deals the documents out, so no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.llm.common import documents_of, list_column, partitions_of
from slotwise.llm.tokens import encoder, slices

SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, parts: int | None = None, group_bytes: int = 32 << 20, page_bytes: int = 128 << 10, page_rows: int = 500) -> None:
    """Encode every text, append ``end_id`` and write the ids to ``path``, ascending by doc_id.

    Documents without id come first.  Rows with the same id are ordered by text; a hot id is spread over
    parts by its texts' hashes.  A null or empty text gives the end id alone.  An empty table gives files
    without rows.  ``part`` numbers the ranges in order and ``part_start`` counts ids within one.
    """
    spark = docs.sparkSession
    rows = documents_of(docs)
    rows = rows.repartitionByRange(parts or partitions_of(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, start, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for b in batches:
            ids_of, texts_of = b.column(0), b.column(1)
            for first, texts in slices(texts_of):
                own, counts = enc.joined(texts)
                counts = counts + 1
                ids, last = np.empty(len(own) + len(texts), "<u4"), np.zeros(len(own) + len(texts), bool)
                last[np.cumsum(counts) - 1] = True
                ids[last], ids[~last] = end_id, own
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), ids_of.slice(first, n), pa.array(starts), pa.array(counts), list_column(ids.view("<i4"), counts)],
                    schema=_ARROW,
                )

    (
        rows.mapInArrow(encode, SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#part_start", "false")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files as (doc_id, start, n_tokens, ids); ``start`` counts the ids of all documents before.

    The starts of the parts come from one row per part.  Filters on doc_id and the choice of columns
    reach the scan: without ``ids`` only the metadata is read.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    bases = sizes.select("part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids themselves."""
    import zlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
