"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments.  If two fingerprints differ in at most two bits,
they differ in at most one bit of the first segment, or not at all in the second.  Each fingerprint is
therefore entered in a table for either segment, and looks up its ball of radius one (33 values) in the
first and its own value in the second; the complete distance of what meets is verified.  Work is done
on distinct fingerprints, so exact copies, however many, count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.buckets import BLOCK, in_blocks, linked, oversized
from slotwise.llm.common import stored, text_of, with_uid
from slotwise.llm.components import connected_components

#: Fingerprints at this distance or less are linked; the segments below are made for it.
RADIUS = 2


def fingerprint(text: bytes, words_in_shingle: int = 3, portion: int = 1 << 16) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    width = min(words_in_shingle, len(words))
    hashes = [hashed(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])]  # noqa: B905  starts is longer
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), portion):
        part = np.array(hashes[at : at + portion], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, uid, fp) of ``docs`` (doc_id, uid, text): ``fp`` is the fingerprint's bits as a signed long.

    Letters A-Z count as lower case, words are separated by ASCII white space.  A text of fewer words
    than a shingle has is one shingle; without words the fingerprint is zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words_in_shingle) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "uid", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("uid").cast("long").alias("uid"), text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, fp long")


def probes(fps: DataFrame) -> DataFrame:
    """(segment, value, fp, entered): table entries and the ball each fingerprint looks up, from (fp)."""
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    first = fps.select(F.lit(0).alias("segment"), high.alias("own"), "fp", F.explode(flips).alias("flip"))
    first = first.select("segment", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), "fp", (F.col("flip") == 0).alias("entered"))
    return first.union(fps.select(F.lit(1), low, "fp", F.lit(True)))


def _near(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs in which one looked the other up, at no more than the radius."""
    fp, entered = table.column("fp").to_numpy().view(np.uint64), table.column("entered").to_numpy()
    return (entered[i] | entered[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS)


def fingerprint_roots(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, root) for every distinct fingerprint that links to another one; others are left out."""
    rows = probes(fps.select("fp").distinct())
    key = ["segment", "value"]
    large = oversized(rows, key, block)
    placed = in_blocks(rows, key, "fp", large).select(*key, "lo", "hi", "fp", "entered")
    return connected_components(linked(placed, 4, _near, "fp")).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, words_in_shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, uid, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links, null where no document of the component has an
    id.  Texts without words have fingerprint zero and link like any other.
    """
    return _components(fingerprints(docs.withColumn("uid", F.monotonically_increasing_id()), words_in_shingle), block)


def _components(marks: DataFrame, block: int) -> DataFrame:
    marks = stored(marks)
    classes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = fingerprint_roots(classes, block)
    rooted = classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(least, "root").select("fp", "component_id", "root")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marks.join(named, "fp").select("doc_id", "uid", hexed, "component_id", "root")


def keep_one_each(docs: DataFrame, words_in_shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    All columns are kept.  Among rows of one id the first stored stays; rows without an id come last.
    """
    from slotwise.llm.common import fresh

    (uid,) = fresh(docs, "uid")
    numbered = with_uid(docs, uid)
    plain = numbered.select("doc_id", "text", F.col(uid).alias("uid"))
    marks = _components(fingerprints(plain, words_in_shingle), block)
    first = marks.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("first"))
    return numbered.join(first.select(F.col("first.uid").alias(uid)), uid, "left_semi").drop(uid)
