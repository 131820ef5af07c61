"""Exact duplicates by two passes over a Bloom filter.

The first pass enters the hash of every text in a counting filter whose counters stop at two: the filter
knows which bits were set more than once.  A hash all of whose bits were set more than once may be repeated;
any other hash is certainly unique.  The second pass looks every row up: rows with a unique hash go straight
to the result, the others are shuffled by their SHA-256 and grouped exactly.

The filter is cut into pages of 65,536 bits, one page for 4,096 rows, and a hash sets four bits of one page.
Tasks send only the positions they set, and pages grow in number, never in size, so no task holds more than a
page.  The finished pages are broadcast while they are small (``BROADCAST_BYTES``); beyond that they are
joined by page number, which moves hashes, not texts.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import fresh, stored, text_of, with_uid

#: Bits of a page, bits set by a hash, and rows that share a page: a unique hash is taken for a repeated one in about 0.2 % of cases.
PAGE_BITS, PROBES, ROWS_PER_PAGE = 1 << 16, 4, 1 << 12
#: Rows whose positions a task gathers before it sends them.
PORTION = 1 << 18
#: Pages up to this size in all are broadcast.
BROADCAST_BYTES = 64 << 20

PAGE_SCHEMA = "page long, bits array<long>"


def normal_digest(text: str | Column = "text") -> Column:
    """SHA-256 (hex) of the text with A-Z in lower case; null is empty, all other characters stay as they are."""
    return F.sha2(F.translate(text_of(text), string.ascii_uppercase, string.ascii_lowercase), 256)


def page_of(digest: str | Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(pages).cast("long"))


def spots_of(digest: str | Column) -> Column:
    """Four positions of 16 bits each, as one long."""
    return F.xxhash64(F.lit(1), digest)


def set_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, once, twice) of a task's hashes: positions set at all, and those set more than once, as uint16."""

    def sent(pages: list, spots: list) -> pa.RecordBatch:
        page, spot = np.concatenate(pages), np.concatenate(spots).view(np.uint64)
        each = [(page.astype(np.uint64) << np.uint64(16)) | ((spot >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(PROBES)]
        found, times = np.unique(np.concatenate(each), return_counts=True)
        numbers, starts = np.unique(found >> np.uint64(16), return_index=True)
        low = (found & np.uint64(0xFFFF)).astype("<u2")
        before = np.concatenate([[0], np.cumsum(times > 1)])
        ends = np.concatenate([starts, [len(found)]])

        def cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer((2 * at).astype("<i4")), pa.py_buffer(values)])

        return pa.RecordBatch.from_arrays(
            [pa.array(numbers.astype(np.int64)), cut(low, ends), cut(low[times > 1], before[ends])], names=["page", "once", "twice"]
        )

    pages, spots, held = [], [], 0
    for b in batches:
        pages.append(b.column(0).to_numpy())
        spots.append(b.column(1).to_numpy())
        held += b.num_rows
        if held >= PORTION:
            yield sent(pages, spots)
            pages, spots, held = [], [], 0
    if held:
        yield sent(pages, spots)


def merge_page(table: pa.Table) -> pa.Table:
    """The bits of one page that were set more than once by all tasks together, as 64-bit words; no row if there are none."""
    times = np.zeros(PAGE_BITS, np.int32)
    for name in ("once", "twice"):
        for value in table.column(name):
            times[np.frombuffer(value.as_buffer(), "<u2")] += 1  # positions of one value are different
    bits = np.packbits(times > 1, bitorder="little").view("<i8")
    some = bits.any()
    return pa.table({"page": pa.array([table.column("page")[0].as_py()] if some else [], pa.int64()), "bits": pa.array([bits] if some else [], pa.list_(pa.int64()))})


def repeated_pages(digests: DataFrame, pages: int) -> DataFrame:
    """The filter of all rows of ``digests`` (digest): pages with bits that were set more than once."""
    entered = digests.select(page_of("digest", pages).alias("page"), spots_of("digest").alias("spots"))
    sent = entered.mapInArrow(set_positions, "page long, once binary, twice binary")
    return stored(sent.groupBy("page").applyInArrow(merge_page, PAGE_SCHEMA))


def maybe_repeated(rows: DataFrame, digest: str, flag: str, pages: int, filter_pages: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``rows`` with ``flag``: false means that the digest is certainly unique."""
    page, bits = fresh(rows, "page", "bits")
    table = filter_pages.select(F.col("page").alias(page), F.col("bits").alias(bits))
    if filter_pages.count() * PAGE_BITS // 8 <= broadcast_bytes:
        table = F.broadcast(table)
    spots = spots_of(digest)
    hit = F.lit(True)
    for i in range(PROBES):
        spot = F.shiftrightunsigned(spots, 16 * i).bitwiseAND(F.lit(PAGE_BITS - 1)).cast("int")
        word = F.get(F.col(bits), F.shiftright(spot, 6))
        hit &= F.call_function("shiftright", word, spot.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
    joined = rows.withColumn(page, page_of(digest, pages)).join(table, page, "left")
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def pages_for(rows: int, rows_per_page: int = ROWS_PER_PAGE) -> int:
    return max(1, -(-rows // rows_per_page))


def _grouped(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass straight through, and candidates with (keep_id, keep_row, group_size), from (doc_id, row, digest, maybe)."""
    candidates = marked.where("maybe")
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id"), (-F.col("row")).alias("back")))
    groups = stored(candidates.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")))
    keep = groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.back")).alias("keep_row"), "group_size")
    return marked.where(~F.col("maybe")), candidates.join(keep, "digest")


def exact_groups(docs: DataFrame, rows_per_page: int = ROWS_PER_PAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A-Z; null is the empty text.  Of equal texts the row with the largest
    doc_id is kept; a null id comes after all others, and of several rows with that id the first one stored is kept.
    ``keep_id`` is null only where no equal row has an id.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), normal_digest("text").alias("digest"))
    rows = stored(rows)
    pages = pages_for(rows.count(), rows_per_page)
    marked = stored(maybe_repeated(rows, "digest", "maybe", pages, repeated_pages(rows, pages), broadcast_bytes))
    unique, grouped = _grouped(marked)
    unique = unique.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    grouped = grouped.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
    return unique.union(grouped).withColumnRenamed("digest", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, rows_per_page: int = ROWS_PER_PAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without equal texts, all columns kept; which row of equal ones stays is as in ``exact_groups``.

    Rows whose text is unique by the filter are not shuffled.
    """
    uid, digest, flag = fresh(docs, "uid", "digest", "maybe")
    numbered = with_uid(docs.withColumn(digest, normal_digest("text")), uid)
    pages = pages_for(numbered.count(), rows_per_page)
    found = repeated_pages(numbered.select(F.col(digest).alias("digest")), pages)
    marked = stored(maybe_repeated(numbered, digest, flag, pages, found, broadcast_bytes))
    plain = marked.where(flag).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(uid).alias("row"), F.col(digest).alias("digest"), F.lit(True).alias("maybe"))
    _, grouped = _grouped(plain)
    first = grouped.where("row = keep_row").select(F.col("row").alias(uid))
    again = marked.where(flag).join(first, uid, "left_semi")
    return marked.where(~F.col(flag)).select(docs.columns).union(again.select(docs.columns))
