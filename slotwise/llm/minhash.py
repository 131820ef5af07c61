"""Near-duplicates by the Jaccard similarity of five-word shingles: MinHash bands find candidates, exact sets decide.

Texts at a similarity of 0.8 differ in about ten of 64 SimHash bits, far outside the balls of ``simhash.py``; two such
texts agree in a band of ``ROWS`` minima with probability 0.8 ** 5, so thirty bands miss such a pair once in about
150,000, and closer ones less.  Work is done on distinct shingle sets, so exact copies, however many, count once.

The members of a band's bucket are first compared with its smallest member.  What that joins needs no further
comparison, so only buckets which still hold several components are compared in full, in blocks (``buckets.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.buckets import BLOCK, in_blocks, oversized, whole_groups
from slotwise.llm.common import fresh, list_column, stored, tables_folder, text_of, with_uid, workspace
from slotwise.llm.components import connected_components

WORDS, BANDS, ROWS, SEED = 5, 30, 5, 20240229
#: Least Jaccard similarity of a link, as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
#: Words of 64 bits in the bitmaps that rule out pairs before their sets are compared.
BITMAP = 16


def shingles(text: bytes) -> np.ndarray:
    """Ascending 64-bit hashes of the different shingles of a text in UTF-8, read as in ``simhash.fingerprint``."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    hashes = [hashed(joined[a : b - 1]) for a, b in zip(starts, ends[min(WORDS, len(words)) - 1 :])]  # noqa: B905  starts is longer
    return np.unique(np.array(hashes, np.uint64))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions, the same in every task."""
    rng = np.random.default_rng(SEED)
    factor, summand = rng.integers(0, (1 << 64) - 1, (2, BANDS * ROWS), np.uint64)
    return factor | np.uint64(1), summand


def band_keys(hashes: np.ndarray, portion: int = 128) -> np.ndarray:
    """One 64-bit key per band of a set that is not empty."""
    factor, summand = _factors()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), portion):
        mixed = np.multiply.outer(factor, hashes[at : at + portion])
        mixed += summand[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        key = (key ^ least[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets, as from ``shingles``, is at least ``LEAST``."""
    p, q = LEAST
    if not len(a) or not len(b):
        return len(a) == len(b)
    if q * min(len(a), len(b)) < p * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, d0, d1, keys) of ``docs`` (doc_id, uid, text): a digest of the set in two parts, and its band keys.

    A text of fewer words than a shingle has is one shingle; without words it has no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            digests, keys, none = np.zeros((b.num_rows, 2), np.uint64), [], np.zeros(0, np.int64)
            for i, text in enumerate(b.column(2)):
                own = shingles(text.as_py())
                digest = xxhash.xxh128_intdigest(own.tobytes())
                digests[i] = digest >> 64, digest & (1 << 64) - 1
                keys.append(band_keys(own) if len(own) else none)
            listed = list_column(np.concatenate([none, *keys]), map(len, keys))
            d0, d1 = (pa.array(digests[:, i].view(np.int64)) for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), d0, d1, listed], names=["doc_id", "uid", "d0", "d1", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "uid", text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, d0 long, d1 long, keys array<long>")


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) of uids whose ``texts`` (uid, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = None, None
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            ids = batch.column(1).to_numpy()
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if known != ids[i]:
                    known, other = ids[i], shingles(y.as_py())
                good[i] = similar(shingles(x.as_py()), other)
            if good.any():
                yield batch.select(["a", "b"]).filter(pa.array(good))

    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("uid").alias(end), F.col("text").alias(f"text_{end}")), end)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps: two of them differ in at most as many bits as their sets have elements not in common."""
    out = np.zeros((len(sets), BITMAP * 64), np.uint8)
    for i, own in enumerate(sets):
        out[i] = np.bincount((own & np.uint64(BITMAP * 64 - 1)).astype(np.int64), minlength=BITMAP * 64) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def joined_roots(sets: list[np.ndarray], root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of roots that join all members of one group with a similar one; ``root`` has the known components."""
    p, q = LEAST
    sizes, maps = np.array([len(x) for x in sets]), _bitmaps(sets)
    label, out = root.copy(), []
    for i in range(len(sets) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        total = sizes[others] + sizes[i]
        apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        # (q + p) * |difference| <= (q - p) * (|a| + |b|) holds for all similar pairs
        others = others[(q + p) * apart <= (q - p) * total]
        for j in others:
            if label[i] != label[j] and similar(sets[i], sets[j]):
                out.append((int(root[i]), int(root[j])))
                label[label == label[j]] = label[i]
    return out


def compared(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between roots, of ``rows`` (band, key, lo, hi, root, text) as from ``in_blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, 4, 2048):
            root, text = table.column("root").to_numpy(), table.column("text")
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
            found = []
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                found += joined_roots([shingles(x.as_py()) for x in text.slice(a, b - a)], root[a:b])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return rows.select("band", "key", "lo", "hi", "root", "text").mapInArrow(run, "a long, b long")


def similar_roots(heads: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(uid, root) for every one of ``heads`` (uid, keys) that is joined with another; others may be left out."""
    place = ["band", "key"]
    spread = heads.select("uid", F.posexplode("keys").alias(*place))
    shared = stored(spread.groupBy(*place).agg(F.min("uid").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rooted_in(stored(spread.join(shared, place)), texts, block)


def rooted_in(members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(uid, root) for all that exact similarity joins within a bucket, of ``members`` (band, key, uid, b); ``b`` is the bucket's smallest."""
    place = ["band", "key"]
    stars = stored(members.where("uid <> b").select(F.col("uid").alias("a"), "b").distinct())
    roots = connected_components(similar_pairs(stars, texts)).withColumnRenamed("node", "uid")
    rooted = stored(members.select(*place, "uid").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")))
    several = rooted.groupBy(*place).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rest = stored(rooted.join(several.select(*place), place, "left_semi"))
    rows = in_blocks(rest.join(texts, "uid"), place, "uid", oversized(rest, place, block))
    more = connected_components(compared(rows)).select(F.col("node").alias("root"), F.col("root").alias("above"))
    every = roots.union(more.select(F.col("root").alias("uid"), "root").join(roots, "uid", "left_anti").select("uid", "root"))
    return every.join(more, "root", "left").select("uid", F.coalesce("above", "root").alias("root"))


def keep_dissimilar(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without near-duplicates: of the texts that links of similar ones join, the one with the smallest id stays.

    All columns are kept.  Among rows of one id the first stored stays; rows without an id come last.  Texts without
    words are copies of each other.
    """
    return dissimilar_rows(docs, sketches, lambda heads, texts: similar_roots(heads, texts, block))


def dissimilar_rows(docs: DataFrame, sketched: Callable[[DataFrame], DataFrame], rooted: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without near-duplicates, as in ``keep_dissimilar``.

    ``sketched`` gives (doc_id, uid, d0, d1, ...) of (doc_id, uid, text); ``rooted`` the (uid, root) of the similar ones
    among its rows, one per digest, and their texts.
    """
    (uid,) = fresh(docs, "uid")
    numbered = with_uid(docs, uid)
    plain = numbered.select("doc_id", "text", F.col(uid).alias("uid"))
    digest = ["d0", "d1"]
    outside = tables_folder(docs.sparkSession)
    with workspace(docs.sparkSession):
        marks = stored(sketched(plain))
        classes = stored(marks.groupBy(*digest).agg(F.min("uid").alias("uid")))
        heads = marks.drop("doc_id", *digest).join(classes.select("uid"), "uid", "left_semi")
        texts = plain.select("uid", text_of("text").cast("binary").alias("text"))
        roots = stored(rooted(heads, texts))
        named = classes.join(roots, "uid", "left").select(*digest, F.coalesce("root", "uid").alias("root"))
        rows = marks.select("doc_id", "uid", *digest).join(named, digest)
        first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("first"))
        kept = stored(first.select(F.col("first.uid").alias(uid)), outside)
    return numbered.join(kept, uid, "left_semi").drop(uid)
