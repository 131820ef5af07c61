"""Bounded-space packing of token ids into fixed windows.

Every partition keeps a fixed number of open windows.  A document's full windows leave at once; what
remains goes to the open window it fits best.  When none fits, the head of the piece fills the fullest
window, which is emitted full, and the rest opens a new one.  Windows still open at the end of the
partitions are merged in rounds of ``FAN`` tasks each, so no task holds more than ``FAN`` x ``windows``
of them however many partitions there are; the last round leaves at most one window unfilled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import documents_of, path_for
from slotwise.llm.tokens import encoder, slices

#: Tasks whose open windows are merged together.
FAN = 64
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, task long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("task", pa.int64())])


class Packer:
    """Best-fit packing into at most ``windows`` open windows of ``size`` ids.

    A piece is (doc_id, start, doc_tokens, ids).  ``emit`` gets the pieces of a finished window.
    """

    def __init__(self, size: int, windows: int, emit):
        self.size, self.windows, self.emit = size, windows, emit
        self.open: list[list] = []  # [ids held, pieces]

    def add(self, doc_id, start: int, doc_tokens: int, ids: bytes) -> None:
        whole = 4 * self.size
        while len(ids) >= whole:
            self.emit([(doc_id, start, doc_tokens, ids[:whole])])
            start, ids = start + self.size, ids[whole:]
        if not ids:
            return
        need = len(ids) // 4
        fits = [w for w in self.open if w[0] + need <= self.size]
        if fits:
            self._put(max(fits, key=lambda w: w[0]), doc_id, start, doc_tokens, ids)
            return
        if len(self.open) >= self.windows:
            fullest = max(self.open, key=lambda w: w[0])
            free = self.size - fullest[0]
            self._put(fullest, doc_id, start, doc_tokens, ids[: 4 * free])
            start, ids = start + free, ids[4 * free :]
        self.open.append([0, []])
        self._put(self.open[-1], doc_id, start, doc_tokens, ids)

    def _put(self, window: list, doc_id, start: int, doc_tokens: int, ids: bytes) -> None:
        window[0] += len(ids) // 4
        window[1].append((doc_id, start, doc_tokens, ids))
        if window[0] == self.size:
            self.open.remove(window)
            self.emit(window[1])

    def drain(self) -> None:
        """Emit what is open: the fullest windows are filled from the others, one is left unfilled."""
        rest = sorted(self.open, key=lambda w: -w[0])
        while len(rest) > 1:
            self.open = [rest[0]]
            giver = rest[-1]
            piece = giver[1].pop()
            free = self.size - rest[0][0]
            ids = piece[3]
            self._put(rest[0], piece[0], piece[1], piece[2], ids[: 4 * free])
            if len(ids) > 4 * free:
                giver[1].append((piece[0], piece[1] + free, piece[2], ids[4 * free :]))
            giver[0] -= min(len(ids) // 4, free)
            rest = [w for w in rest if w[1] and w[0] and w[0] < self.size]
        for w in rest:
            self.emit(w[1])
        self.open = []


class _Rows:
    """Collects finished windows as Arrow batches.  Sequence ids are unique by round, task and count."""

    def __init__(self, level: int, task: int):
        self.base, self.task, self.count, self.rows, self.bytes = (level << 56) | (task << 32), task, 0, [], 0

    def emit(self, pieces: list) -> None:
        self._add(pieces, self.base + self.count)
        self.count += 1

    def keep(self, pieces: list) -> None:
        self._add(pieces, None)

    def _add(self, pieces: list, sequence: int | None) -> None:
        at = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, total, ids, sequence, at, self.task))
            at += n
            self.bytes += len(ids)

    def batch(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.bytes >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            self.rows, self.bytes = [], 0


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, windows: int = 16) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.  Every id of every document,
    and the end id put after it, lies in exactly one piece.  All sequences are full but at most one.  A null or empty text is
    the end id alone; repeated rows are separate documents; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        rows = _Rows(0, TaskContext.get().partitionId())
        packer = Packer(size, windows, rows.emit)
        for b in batches:
            ids_of = b.column(0)
            for first, texts in slices(b.column(1)):
                for i, ids in enumerate(enc.ids(texts)):
                    packer.add(ids_of[first + i].as_py(), 0, len(ids) // 4 + 1, ids + end)
                yield from rows.batch(4 << 20)
        for _, pieces in packer.open:
            rows.keep(pieces)
        yield from rows.batch()

    def written(df: DataFrame) -> DataFrame:
        path = path_for(spark, "packed")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(SCHEMA).parquet(path)

    done = [written(documents_of(docs).mapInArrow(fill, SCHEMA))]
    level, tasks = 0, _tasks(done[-1])
    while tasks:
        level, groups = level + 1, -(-tasks // FAN)
        merge = _merger(level, size, windows, last=groups == 1)
        loose = done[-1].where("sequence_id IS NULL").withColumn("task", F.expr(f"task div {FAN}"))
        done.append(written(loose.groupBy("task").applyInArrow(merge, SCHEMA)))
        tasks = groups if groups > 1 else 0
    columns = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    return reduce(DataFrame.union, [x.where("sequence_id IS NOT NULL").select(columns) for x in done])


def _tasks(pieces: DataFrame) -> int:
    """One more than the largest number of a task with open windows; 0 if there are none."""
    most = pieces.where("sequence_id IS NULL").agg(F.max("task")).first()[0]
    return 0 if most is None else most + 1


def _merger(level: int, size: int, windows: int, last: bool):
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        rows = _Rows(level, table.column("task")[0].as_py())
        packer = Packer(size, windows, rows.emit)
        for x in table.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            packer.add(x["doc_id"], x["start"], x["doc_tokens"], x["ids"])
        if last:
            packer.drain()
        for _, pieces in packer.open:
            rows.keep(pieces)
        out = list(rows.batch())
        return pa.Table.from_batches(out, schema=_ARROW)

    return merge
