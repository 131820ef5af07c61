"""Repeated substrings by enhanced suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts anywhere else too.  Every such window has an
anchor, the leftmost of its ``GRAM``-byte strings with the smallest hash, which depends on the window's bytes alone; equal
windows have equal anchors at equal places.  Consecutive windows of one anchor form a segment.  Segments are
grouped by their anchors: where a group holds one segment only, many times over, all of it repeats.  Groups of
different segments get a suffix array of their windows' starts with common-prefix lengths; a stack scan finds its
intervals, and those whose occurrences differ in the byte before are maximal repeats with all occurrences.

A very common anchor with more than ``LARGE`` different segments isn't put into one task: its windows are
hashed and counted with partial sums instead, which tells the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.buckets import whole_groups
from slotwise.llm.common import documents_of, partitions_of, stored

LENGTH, GRAM, LARGE = 200, 32, 2000
#: Grams whose hashes are worked on together; their places fit the low bits of a packed hash.
PORTION = 1 << 16
#: Texts whose segments or remains are gathered before they leave a task, and segments of one suffix array (whole anchors).
ROWS, SEGMENTS = 500, 1000
#: Three ranks below this fit one number.
TRIPLED = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place of ``text`` (uint8); ``gram`` is a power of two."""
    h, factor, width = text.astype(np.uint64) + np.uint64(1), _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * factor + h[width:]
            factor, width = factor * factor, 2 * width
        return _mixed(h)


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hashes, starts, ends) of the segments of a text, in portions; texts shorter than ``length`` have none.

    A segment holds the windows from its start to its end less ``length``.
    """
    data, width = np.frombuffer(text, np.uint8), length - gram + 1
    step = PORTION - width + 1
    for at in range(0, len(data) - length + 1, step):
        part = data[at : at + PORTION + gram - 1]
        if len(part) < length:
            break
        hashes = gram_hashes(part, gram)
        low = np.uint64(PORTION - 1)
        least, reach = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * reach <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        rest = width - reach
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        yield hashes[anchor[first]].view(np.int64), first + at, last + at + length


def segment_rows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(anchor, digest, uid, start, end) of all segments of ``docs`` (uid, a pair of longs, and text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            parts: list[list] = [[], [], [], [], [], []]
            for doc, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                for anchors, starts, ends in segments(text, length, gram):
                    digests = [xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    for column, x in zip(parts, (anchors, np.array(digests, np.uint64).view(np.int64), np.full(len(starts), doc), np.full(len(starts), mark), starts, ends), strict=True):
                        column.append(x)
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(empty + x)) for x in parts], names=["anchor", "digest", "doc", "mark", "start", "end"])

    rows = docs.select("uid.doc", "uid.mark", "text").mapInArrow(run, "anchor long, digest long, doc long, mark long, start long, end long")
    return rows.select("anchor", "digest", F.struct("doc", "mark").alias("uid"), "start", "end")


def suffix_array(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Enhanced suffix array of the window starts of ``parts``: (part, start, common prefix with the one before, byte before).

    Suffixes end with their part.  The first start of a part has a byte before of its own, so it counts as different.
    """
    sizes = np.array([len(p) for p in parts])
    firsts = np.cumsum(sizes + 1) - sizes - 1
    signs = np.zeros(int(sizes.sum()) + len(parts), np.int16)  # 0 ends a part
    for p, at in zip(parts, firsts, strict=True):
        signs[at : at + len(p)] = np.frombuffer(p, np.uint8)
        signs[at : at + len(p)] += 1
    n, widths, ranks = len(signs), [7], []
    padded, key = np.concatenate([signs, np.zeros(7, np.int16)]), np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i : i + n]
    ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
    times = 3 if n < TRIPLED else 2  # ranks put side by side in one number
    while widths[-1] <= sizes.max():
        w, r = widths[-1], ranks[-1]
        key = r.astype(np.int64)
        for i in range(1, times):
            key = key * (n + 2) + np.concatenate([r[i * w :], np.full(min(i * w, n), -1, np.int32)])[:n] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        widths.append(times * w)
    counts = np.maximum(0, sizes - length + 1)
    part = np.repeat(np.arange(len(parts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = firsts[part] + start
    order = np.argsort(ranks[-1][place], kind="stable")
    part, start, place = part[order], start[order], place[order]
    a, b, common = place[:-1].copy(), place[1:].copy(), np.zeros(len(place), np.int64)
    for w, r in [*(x for x in zip(reversed(widths), reversed(ranks), strict=True) for _ in range(times - 1)), *[(1, signs)] * 6]:
        same = (a < n) & (b < n)
        same[same] = r[a[same]] == r[b[same]]
        common[1:][same] += w
        a[same] += w
        b[same] += w
    left = sizes[part] - start
    common[1:] = np.minimum(common[1:], np.minimum(left[:-1], left[1:]))
    before = np.where(start > 0, signs[place - 1], -1 - np.arange(len(place)))
    return part, start, common, before


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of at least ``least``, by one scan with a stack."""
    out, stack = [], []
    deep = common >= least
    edges = np.flatnonzero(deep | np.concatenate([[False], deep[:-1]])[: len(deep)])
    values = common[edges].tolist()
    for i, depth in [*zip(edges.tolist(), values, strict=True), (len(common), 0)]:
        if depth < least:
            depth = 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i - 1))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def repeat_groups(parts: list[bytes], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of at least ``length`` bytes in ``parts``: (bytes, all occurrences as (part, start)).

    A repeat is maximal if no byte can be added to it on the right, nor on the left, in all its occurrences.
    """
    part, start, found = _maximal(parts, length)
    return [(d, [(int(p), int(s)) for p, s in zip(part[i : j + 1], start[i : j + 1], strict=True)]) for d, i, j in found]


def _maximal(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    part, start, common, before = suffix_array(parts, length)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]) if len(before) else before
    return part, start, [(d, i, j) for d, i, j in intervals(common, length) if changes[j] > changes[i]]


def repeated_ranges(parts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For every part the ranges that its maximal repeats cover, merged and in order."""
    part, start, found = _maximal(parts, length)
    deepest = np.zeros(len(part), np.int64)
    for depth, i, j in sorted(found):
        deepest[i : j + 1] = depth
    some = np.flatnonzero(deepest)
    some = some[np.lexsort((start[some], part[some]))]
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    for p, s, d in zip(part[some].tolist(), start[some].tolist(), deepest[some].tolist(), strict=True):
        own = out[p]
        if own and s <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], s + d))
        else:
            own.append((s, s + d))
    return out


def _ranges_of_groups(parts: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, from, to) of the repeats among different segments of one anchor; ``parts`` has anchor, digest, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, 1, SEGMENTS):
            found = repeated_ranges(table.column(2).to_pylist(), length)
            rows = np.repeat(np.arange(table.num_rows), [len(x) for x in found])
            flat = [r for x in found for r in x]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(table.column(i).to_numpy()[rows]) for i in (0, 1)], pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64())],
                names=["anchor", "digest", "from", "to"],
            )

    dealt = parts.repartition(partitions_of(parts.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "digest", "bytes").mapInArrow(run, "anchor long, digest long, from long, to long")


def _ranges_of_windows(parts: DataFrame, length: int) -> DataFrame:
    """The same for very common anchors: windows that several different segments share, counted with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(2)[i].as_py()
                n = len(own) - length + 1
                marks = np.array([xxhash.xxh3_64_intdigest(own[s : s + length]) for s in range(n)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column(0)[i].as_py())), pa.array(np.full(n, b.column(1)[i].as_py())), pa.array(np.arange(n)), pa.array(marks)],
                    names=["anchor", "digest", "from", "mark"],
                )

    windows = parts.select("anchor", "digest", "bytes").mapInArrow(run, "anchor long, digest long, from long, mark long")
    common = windows.groupBy("mark").count().where("count > 1").select("mark")
    return windows.join(common, "mark").select("anchor", "digest", "from", (F.col("from") + length).alias("to"))


def _anchored(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments whose anchor occurs again, the different ones among them with their numbers, and the bytes of those."""
    rows = stored(segment_rows(docs, length, gram))
    anchors = stored(rows.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("differ")).where("n > 1").drop("n"))
    members = stored(rows.join(anchors, "anchor"))
    kinds = members.where("differ").groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("uid", "start", "end")).alias("one"))
    kinds = stored(kinds.select("anchor", "digest", "n", "one.*"))
    wanted = kinds.groupBy("uid").agg(F.collect_list(F.struct("anchor", "digest", "start", "end")).alias("of"))
    texts = docs.join(wanted, "uid").select(F.explode("of").alias("s"), "text")
    parts = texts.select("s.anchor", "s.digest", F.substring("text", (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int")).alias("bytes"))
    return members, kinds, stored(parts)


def _single_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, uid, text binary), the uids of rows alike in id and text, and one (uid, text) of each uid."""
    uid = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("mark"))
    numbered = documents_of(docs).select("doc_id", uid.alias("uid"), F.col("text").cast("binary").alias("text"))
    again = stored(numbered.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid"))
    single = numbered.join(again, "uid", "left_anti").select("uid", "text")
    one_each = numbered.join(again, "uid", "left_semi").groupBy("uid").agg(F.first("text").alias("text"))
    return numbered, again, single.union(one_each)


def maximal_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The groups of maximal repeats with all their occurrences: repeat, n_bytes, doc_id, start, one row for each occurrence.

    ``repeat`` is a hash of the repeated bytes.  Repeats are maximal inside the segments of one anchor, so one
    that is longer than a segment comes as several, which overlap.  Every string of ``length`` bytes that
    occurs twice lies in a group with the same occurrences.  Suffix arrays hold different segments once; copies of them are
    joined to the groups afterwards, so that a group of any size is rows, not a list.  Rows alike in id and
    text count as one; null texts are empty and, like all texts below ``length`` bytes, have no row.  An anchor's
    different segments are worked on in one task here, however many there are.
    """
    _, _, texts = _single_rows(docs)
    members, kinds, parts = _anchored(texts, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, 1, SEGMENTS):
            own = table.column(2).to_pylist()
            part, start, found = _maximal(own, length)
            at = 0
            while at < len(found):
                rows: list[tuple[int, int, int, int]] = []
                while at < len(found) and len(rows) < PORTION:
                    depth, i, j = found[at]
                    first = own[part[i]][start[i] : start[i] + depth]
                    mark = xxhash.xxh3_64_intdigest(first) - (1 << 63)
                    rows += [(int(p), mark, depth, int(x)) for p, x in zip(part[i : j + 1], start[i : j + 1], strict=True)]
                    at += 1
                place, mark, depth, x = (np.array(column, np.int64) for column in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(table.column(i).to_numpy()[place]) for i in (0, 1)], pa.array(mark), pa.array(depth), pa.array(x)],
                    names=["anchor", "digest", "repeat", "n_bytes", "from"],
                )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [xxhash.xxh3_64_intdigest(x.as_py()) - (1 << 63) for x in b.column(2)]
            sizes = [len(x.as_py()) for x in b.column(2)]
            columns = [b.column(0), b.column(1), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array([0] * b.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "digest", "repeat", "n_bytes", "from"])

    schema = "anchor long, digest long, repeat long, n_bytes long, from long"
    dealt = parts.repartition(partitions_of(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    among = dealt.select("anchor", "digest", "bytes").mapInArrow(run, schema)
    copied = parts.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"])
    copied = copied.select("anchor", "digest", "bytes").mapInArrow(whole, schema)
    groups = stored(among.union(copied).distinct())
    met = members.where("differ").join(groups, ["anchor", "digest"])
    met = met.select("repeat", "n_bytes", "uid", (F.col("start") + F.col("from")).alias("start"))
    alike = members.where("NOT differ").select(F.col("digest").bitwiseXOR(F.lit(-(1 << 63))).alias("repeat"), (F.col("end") - F.col("start")).alias("n_bytes"), "uid", "start")
    return met.union(alike).select("repeat", "n_bytes", F.col("uid.doc").alias("doc_id"), "start")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """(uid, spans) of ``docs`` (uid, a pair of longs, and text binary): ranges of bytes, not merged, that lie in repeated windows."""
    members, kinds, parts = _anchored(docs, length, gram)
    sizes = stored(kinds.groupBy("anchor").count().where(F.col("count") > large).select("anchor"))
    ranges = _ranges_of_groups(parts.join(sizes, "anchor", "left_anti"), length).union(_ranges_of_windows(parts.join(sizes, "anchor"), length))
    copied = kinds.where("n > 1").select("anchor", "digest", F.lit(0).cast("long").alias("from"), (F.col("end") - F.col("start")).alias("to"))
    merged = stored(ranges.union(copied).groupBy("anchor", "digest").agg(F.collect_list(F.struct("from", "to")).alias("ranges")))
    whole = members.where("NOT differ").select("uid", "start", "end")
    some = members.where("differ").join(merged, ["anchor", "digest"]).select("uid", "start", F.explode("ranges").alias("r"))
    spans = whole.union(some.select("uid", (F.col("start") + F.col("r.from")).alias("start"), (F.col("start") + F.col("r.to")).alias("end")))
    return spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal runs, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, spans, kept.

    ``spans`` are the maximal runs of removed bytes (start, end), ``kept`` the bytes left.  Texts are UTF-8, null
    counts as empty; matches never cross documents, but a document may repeat itself.  Rows are told apart by id and a hash
    of the text, the same on each read; rows alike in both are copies of each other: one of them is searched, and all
    lose the whole text if it has ``length`` bytes.
    """
    numbered, again, texts = _single_rows(docs)
    found = repeated_bytes(texts, length, gram, large)
    whole = again.withColumn("whole", F.lit(True))
    numbered = numbered.join(whole, "uid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(at, ROWS) for part in batches for at in range(0, part.num_rows, ROWS)):
            spans_of, kept, sizes, starts, ends, counts = b.column(2), [], [], [], [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                own = spans_of[i].values
                s, e = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if own is not None and len(own):
                    s, e = merged_spans(own.field(0).to_numpy(), own.field(1).to_numpy())
                cuts = np.concatenate([[0], np.stack([s, e], axis=1).ravel(), [len(text)]]).astype(int).tolist()
                kept.append(b"".join([text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)]))
                sizes.append(len(text))
                starts.append(s)
                ends.append(e)
                counts.append(len(s))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (starts, ends)], names=["start", "end"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pairs), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )

    size = F.octet_length("text").cast("long")
    every = F.when(F.col("whole") & (size >= length), F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))))
    joined = numbered.join(found, "uid", "left").select("doc_id", "text", F.coalesce(every, "spans").alias("spans"))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
