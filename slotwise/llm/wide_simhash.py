"""Near-duplicates by the Jaccard similarity of five-word shingles: wide SimHashes find candidates, exact sets decide.

At a similarity of 0.8 two texts differ in 15 % of their SimHash bits, so 64 bits with a ball of two, as in
``simhash.py``, are too few.  A fingerprint here has ``SEGMENTS`` segments of ``BITS`` bits and ``CHECKED`` further ones.
Each segment is entered in, and looks up, its Hamming ball of radius one, cut to the ``UNSURE`` bits whose sums are
nearest to zero: a similar text differs in those first.  What meets in a segment is verified by the distance of the
further bits, and what that leaves by exact sets (``minhash.py``).  Two texts at 0.8 meet in a segment with
probability 0.29.  Work is done on distinct shingle sets, so exact copies, however many, count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.buckets import BLOCK, Links, oversized, pairs, whole_groups
from slotwise.llm.common import few_tasks, list_column, partitions_of, stored, tables_folder, text_of, workspace
from slotwise.llm.components import connected_components
from slotwise.llm.minhash import LEAST, dissimilar_rows, rooted_in, shingles

SEGMENTS, BITS, UNSURE, CHECKED = 32, 20, 4, 128
#: Most differing bits of ``CHECKED`` in a candidate: at a similarity of 0.8 they are 19 on the average, with a deviation of 4.
RADIUS = 37
#: Segments that are shuffled at a time, so that the disk holds a part of them only.
TOGETHER = 8
#: Sums of a text; a shingle adds its sign and weight at ``PLACES`` of them before they are transformed.
SIDE, PLACES, SEED = 32, 8, 20240306
WIDTH = SIDE * SIDE
#: A set with fewer elements is similar to none but itself.
SMALLEST = LEAST[0] // (LEAST[1] - LEAST[0])


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors, weights, the order of the bits and a Hadamard matrix, the same in every task."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, (1 << 64) - 1, PLACES, np.uint64) | np.uint64(1)
    weights, order = rng.uniform(0.7, 1.3, PLACES), rng.permutation(WIDTH)[: SEGMENTS * BITS + CHECKED]
    matrix = np.ones((1, 1))
    while len(matrix) < SIDE:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return factors, weights, order, matrix


def bit_sums(sets: list[np.ndarray], portion: int = 1 << 14) -> np.ndarray:
    """One row per set, as from ``shingles``: for each bit the sum of what the shingles add to it or take from it.

    A shingle's hash sets its sign and weight at a few places; bit j of it is the parity of j and such a place.  The
    Walsh-Hadamard transform sums that over all shingles for all bits at once.
    """
    factors, weights, order, matrix = _constants()
    row = np.repeat(np.arange(len(sets)) * WIDTH, [len(x) for x in sets])
    hashes, sums = np.concatenate([np.zeros(0, np.uint64), *sets]), np.zeros(len(sets) * WIDTH)
    for at in range(0, len(hashes), portion):
        mixed = np.multiply.outer(factors, hashes[at : at + portion])
        signed = np.where(mixed >> np.uint64(20) & np.uint64(1), weights[:, None], -weights[:, None])
        place = (mixed >> np.uint64(32)).astype(np.int64) % WIDTH + row[at : at + portion]
        sums += np.bincount(place.ravel(), signed.ravel(), len(sums))
    return (matrix @ sums.reshape(-1, SIDE, SIDE) @ matrix).reshape(-1, WIDTH)[:, order]


def fingerprints(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``bit_sums``: the numbers of the places each one is entered in and looks up, by segment, and the further bits."""
    bits = sums > 0
    own = bits[:, : SEGMENTS * BITS].reshape(-1, SEGMENTS, BITS) @ (1 << np.arange(BITS))
    certain = np.abs(sums[:, : SEGMENTS * BITS]).reshape(-1, SEGMENTS, BITS)
    flips = 1 << np.argpartition(certain, UNSURE, axis=2)[:, :, :UNSURE]
    ball = np.concatenate([own[:, :, None], own[:, :, None] ^ flips], axis=2)
    further = np.packbits(np.ascontiguousarray(bits[:, SEGMENTS * BITS :]), axis=1).view(np.int64)
    return (ball + (np.arange(SEGMENTS) << BITS)[:, None]).reshape(len(sums), -1).astype(np.int32), further


def sketches(docs: DataFrame, at_once: int = 64) -> DataFrame:
    """(doc_id, uid, d0, d1, keys, f0, f1) of ``docs`` (doc_id, uid, text): a digest of the set in two parts, the places of
    its segments, and the further bits.

    A text of fewer words than a shingle has is one shingle; sets too small for a similar one have no places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        per_set = SEGMENTS * (UNSURE + 1)
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                sets = [shingles(x.as_py()) for x in part.column(2)]
                digests = np.array([divmod(xxhash.xxh128_intdigest(x.tobytes()), 1 << 64) for x in sets], np.uint64).view(np.int64)
                keys, further = fingerprints(bit_sums(sets))
                large = np.array([len(x) >= SMALLEST for x in sets])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], *map(pa.array, digests.T.copy()), list_column(keys[large].ravel(), large * per_set), *map(pa.array, further.T.copy())],
                    names=["doc_id", "uid", "d0", "d1", "keys", "f0", "f1"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "uid", text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, d0 long, d1 long, keys array<int>, f0 long, f1 long")


def _near(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that differ in no more of the further bits than the radius."""
    apart = np.zeros(len(i), np.int64)
    for name in ("f0", "f1"):
        bits = table.column(name).to_numpy().view(np.uint64)
        apart += np.bitwise_count(bits[i] ^ bits[j])
    return apart <= RADIUS


def portions() -> list[tuple[int, int]]:
    """Numbers of the segments that are shuffled at a time: one alone joins most of a large group, then ``TOGETHER``."""
    cuts = [0, 1, *range(TOGETHER, SEGMENTS, TOGETHER), SEGMENTS]
    return list(zip(cuts, cuts[1:]))  # noqa: B905


def candidate_groups(heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of those of ``heads`` (uid, keys, f0, f1) which verified meetings in segments join with others.

    What earlier segments joined has one label; later ones compare only members of different labels.  Of each portion
    only the labels outlast it.
    """
    spark = heads.sparkSession
    outside, named = tables_folder(spark), spark.createDataFrame([], "uid long, label long")
    size = UNSURE + 1
    for first, last in portions():
        keys = F.slice("keys", first * size + 1, (last - first) * size)
        entered = heads.select(F.explode(F.filter(keys, lambda _, i: i % size == 0)).alias("key"))
        part = heads.select("uid", "f0", "f1", keys.alias("keys"))
        with workspace(spark):
            # places with very many own entries are joined to their smallest member first, the balls' entries in them too
            large = oversized(entered, ["key"], block).select("key")
            if not large.isEmpty():
                named = relabelled(named, star_links(labelled(part, named).join(large, "key")))
            rows = labelled(part, named)
            placed = in_label_blocks(rows, label_blocks(rows.join(large, "key"), block))
            named = relabelled(named, joined_labels(placed), outside)
    return named.select(F.col("uid").alias("node"), F.col("label").alias("root"))


def labelled(part: DataFrame, named: DataFrame) -> DataFrame:
    """(key, uid, label, f0, f1) for each place of ``part`` (uid, f0, f1, keys); what is not in ``named`` (uid, label) is its own label."""
    return part.join(named, "uid", "left").select(F.explode("keys").alias("key"), "uid", F.coalesce("label", "uid").alias("label"), "f0", "f1")


def relabelled(named: DataFrame, links: DataFrame, folder: str | None = None) -> DataFrame:
    """``named`` (uid, label) after ``links`` (a, b) between labels: each has the smallest label it reaches; stored as by ``stored``."""
    roots = connected_components(folded(links))
    moved = named.join(roots.withColumnRenamed("node", "label"), "label", "left").select("uid", F.coalesce("root", "label").alias("label"))
    added = roots.select(F.col("node").alias("uid"), F.col("root").alias("label")).join(named, "uid", "left_anti")
    return stored(few_tasks(moved.union(added), named.count() + roots.count()), folder)


def star_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between labels, of ``rows`` as from ``labelled`` that are near the smallest member of their place."""
    first = F.min(F.struct("uid", "label", "f0", "f1")).alias("first")
    hubs = rows.groupBy("key").agg(first, F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("first.f0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("first.f1")))
    met = rows.join(stored(hubs.select("key", "first")), "key").where((F.col("label") != F.col("first.label")) & (apart <= RADIUS))
    return met.select(F.col("label").alias("a"), F.col("first.label").alias("b")).distinct()


def label_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(key, top, minor, major): the most frequent label of a place, the number of blocks of the others and of its own; a stored table."""
    sizes = rows.groupBy("key", "label").count()
    tops = sizes.groupBy("key").agg(F.max_by("label", "count").alias("top"), F.max("count").alias("most"), F.sum("count").alias("n"))
    blocks = [F.ceil(x / block).cast("int").alias(name) for x, name in ((F.col("n") - F.col("most"), "minor"), (F.col("most"), "major"))]
    return stored(tops.select("key", "top", *blocks))


def in_label_blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """(key, lo, hi, label, f0, f1): ``rows`` once per pair of blocks they belong to, dealt out and sorted by place and pair.

    Members of a place's most frequent label need no comparison with each other, so pairs of their blocks are left out,
    and with them places of one label.
    """
    rows = rows.join(large, "key", "left").where("minor > 0 OR minor IS NULL")
    frequent, spread = F.col("label") == F.col("top"), F.xxhash64("uid")
    own = F.when(frequent, F.col("minor") + F.pmod(spread, "major")).otherwise(F.pmod(spread, "minor")).cast("int")
    others = F.sequence(F.lit(0), F.when(frequent, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
    pairs = F.transform(others, lambda i: F.struct(F.least(own, i).alias("lo"), F.greatest(own, i).alias("hi")))
    alone = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("minor").isNull(), alone).otherwise(pairs)))
    place = ["key", "lo", "hi"]
    rows = rows.select("key", "pair.lo", "pair.hi", "label", "f0", "f1")
    return rows.repartition(partitions_of(rows.sparkSession), *place).sortWithinPartitions(*place)


def joined_labels(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the labels of all near pairs of ``rows``, as from ``in_label_blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, 3):
            label, start = table.column("label").to_numpy(), np.flatnonzero(np.diff(group, prepend=-1))
            several = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
            rest = np.repeat(several, np.diff(start, append=len(group)))
            table, group = table.filter(pa.array(rest)).combine_chunks(), group[rest]
            names, at = np.unique(label[rest], return_inverse=True)
            links = Links(len(names))
            for i, j in pairs(group):
                apart = at[i] != at[j]
                i, j = i[apart], j[apart]
                good = _near(table, i, j)
                links.add(at[i[good]], at[j[good]])
            a, b = links.stars()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.int64()), pa.array(names[b], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def folded(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) that join the same.

    A member of a large group meets another smallest one in each of its places, at most as many as it has entries: those
    are linked to the smallest of them, so that the components aren't searched among all meetings.
    """
    ends = edges.groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("others"))
    links = ends.select(F.explode(F.concat(F.array("a"), "others")).alias("a"), "b")
    return links.where("a <> b").distinct()


def similar_roots(heads: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(uid, root) for every one of ``heads`` that exact similarity joins with another; others may be left out."""
    groups = candidate_groups(heads, block).select(F.lit(0).alias("band"), F.col("root").alias("key"), F.col("node").alias("uid"), F.col("root").alias("b"))
    return rooted_in(stored(groups), texts, block)


def keep_dissimilar(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without near-duplicates: of the texts that links of similar ones join, the one with the smallest id stays.

    All columns are kept.  Among rows of one id the first stored stays; rows without an id come last.  Texts without
    words are copies of each other.
    """
    return dissimilar_rows(docs, sketches, lambda heads, texts: similar_roots(heads, texts, block))
