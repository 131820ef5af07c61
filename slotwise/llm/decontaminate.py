"""Benchmark decontamination with spaced seeds.

A seed reads a short stretch of tokens through a mask that ignores some positions, so a substituted
word spoils only the seeds that look at it.  Seeds of the benchmark's items are hashed once; a bitmap of
them, whose size is a parameter, drops nearly all seeds of the documents as they are read, and the rest
are joined with the items' seeds.  Each hit fixes an alignment of document and item; around the hits
whole tokens are compared, and stretches with enough agreeing tokens are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import fresh, list_column, stored, text_of, with_uid

#: Masks of the seeds: 1 reads a token, 0 ignores it.  Each reads six.  Whatever two tokens of twelve are
#: substituted, one of the masks reads only equal ones.
MASKS = ("111111", "1111101", "1111011", "1110111", "1101111", "1011111", "11100111")
#: A stretch counts from this many aligned tokens with this share of equal ones.  Shorter items must match from end to
#: end but for one substituted token in ``SPOILED``; they are cut into one block more than that, one of which stays whole.
LEAST_TOKENS, SHARE, SPOILED = 12, 0.8, 5
#: Tokens of a document kept on either side of its seeds for the comparison.
CONTEXT = 64
BITS = 1 << 24
#: Signs that tokens are compared without; what consists of them alone is no token.
SIGNS = b".,;:!?\"'()[]|*"
#: Odd 64-bit numbers, one per token that a seed reads and one for the mask.
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, 7, np.uint64) * np.uint64(2) + np.uint64(1)
#: Tokens of documents whose seeds are made together.
TOGETHER = 1 << 17


def token_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every token: words between ASCII white space, A-Z as lower case, without the signs ``SIGNS``."""
    words = text.lower().translate(None, SIGNS).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(tokens: np.ndarray, whole: tuple[int, ...] = ()) -> list[tuple[int, np.ndarray]]:
    """For every mask its span and the seed hashes at all positions, then those of plain stretches of the lengths ``whole``.

    A seed is the sum of the read tokens' hashes, each times a number of its place among them, and of one for the mask.
    """
    n, out = len(tokens), []
    with np.errstate(over="ignore"):
        scaled = [tokens * _FACTORS[k] for k in range(len(MASKS[0]))]
        for salt, mask in [*enumerate(MASKS), *((100 + length, "1" * length) for length in whole)]:
            if n >= len(mask):
                read = [i for i, x in enumerate(mask) if x == "1"]
                seed = np.full(n - len(mask) + 1, np.uint64(salt + 1) * _FACTORS[-1], np.uint64)
                for k, i in enumerate(read):
                    seed += scaled[k][i : n - len(mask) + 1 + i]
                out.append((len(mask), seed ^ (seed >> np.uint64(31))))
    return out


def short_blocks(n: int) -> list[tuple[int, int]]:
    """(start, length) of the blocks of an item of ``n`` tokens that is too short for masks; some block is equal in every match."""
    blocks = n // SPOILED + 1
    cuts = [i * n // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]  # noqa: B905  one is shorter


def benchmark_tokens(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, tokens) with the hashes of every token; items without tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [token_hashes(x.as_py()).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(np.concatenate([np.zeros(0, np.int64), *own]), map(len, own))], names=["item_id", "tokens"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, tokens array<long>").where(F.size("tokens") > 0)


def item_classes(items: DataFrame) -> DataFrame:
    """(tokens, substitutions, n_items): how many items there are of each length below ``LEAST_TOKENS`` and how many tokens may differ; null is all longer ones."""
    n = F.size("tokens")
    own = benchmark_tokens(items).select(F.when(n < LEAST_TOKENS, n).alias("tokens"))
    return own.groupBy("tokens").agg(F.floor(F.first("tokens") / SPOILED).cast("int").alias("substitutions"), F.count("*").alias("n_items"))


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, seed, item_at, n) of (item, tokens); ``n`` is the item's number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for item, tokens in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.asarray(tokens.values.to_numpy(), np.int64).view(np.uint64)
                n = len(own)
                if n >= LEAST_TOKENS:
                    for _, s in seeds(own):
                        out += [(item, int(h), at, n) for at, h in enumerate(s.view(np.int64))]
                else:
                    for at, length in short_blocks(n):
                        out.append((item, int(seeds(own[at : at + length], (length,))[-1][1].view(np.int64)[0]), at, n))
            item, seed, at, n = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(seed, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["item", "seed", "item_at", "n"])

    return items.mapInArrow(run, "item long, seed long, item_at int, n int")


def _places(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a seed; ``bits`` is a power of two."""
    low = np.uint64(bits - 1)
    return seed & low, (seed >> np.uint64(32)) & low


def seed_bitmap(item_seed: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bloom filter of the seeds in 64-bit words; at most ``bits`` / 64 rows reach the driver, whatever the benchmark's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.concatenate(_places(b.column(0).to_numpy().view(np.uint64), bits)).astype(np.int64)
            value = np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(value)], names=["word", "value"])

    words = item_seed.select("seed").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value"))
    out = np.zeros(bits // 64, np.int64)
    for word, value in words.collect():
        out[word] = value
    return out.view(np.uint64)


def _known(seed: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Positions of the seeds that the filter holds."""
    one, two = _places(seed, 64 * len(bitmap))
    at = np.flatnonzero(_set(one, bitmap))
    return at[_set(two[at], bitmap)]


def _set(place: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return (bitmap[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def document_regions(docs: DataFrame, bitmap: np.ndarray, whole: tuple[int, ...] = (), context: int = CONTEXT) -> DataFrame:
    """Stretches of documents (doc_id, uid, text) around seeds that the filter holds.

    (doc_id, uid, region, first, tokens, ats, seeds): the stretch starts at token ``first`` and has the hashes
    ``tokens``; ``seeds`` begin at ``ats`` in it.  A document without any has one row without seeds.
    """
    none = np.zeros(0, np.uint64)

    def found(tokens: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every document, which ends at ``ends``, the places and seeds that the filter holds."""
        ats, own = [none.astype(np.int64)], [none]
        for span, seed in seeds(tokens, whole):
            hit = _known(seed, bitmap)
            hit = hit[hit + span <= ends[np.searchsorted(ends, hit, side="right")]]  # not over the end of a document
            ats.append(hit)
            own.append(seed[hit])
        at, seed = np.concatenate(ats), np.concatenate(own)
        order = np.argsort(at, kind="stable")
        at, seed = at[order], seed[order]
        cuts = np.searchsorted(at, ends[:-1])
        return list(zip(np.split(at, cuts), np.split(seed, cuts), strict=True))

    def stretches(tokens: np.ndarray, at: np.ndarray, seed: np.ndarray) -> Iterator[tuple]:
        if not len(at):
            yield 0, none, at, none
            return
        cuts = np.flatnonzero(np.diff(at) > 2 * context) + 1
        for a, s in zip(np.split(at, cuts), np.split(seed, cuts), strict=True):
            first = max(0, int(a[0]) - context)
            yield first, tokens[first : int(a[-1]) + 8 + context], a - first, s

    def together(b: pa.RecordBatch) -> Iterator[list[tuple]]:
        held, size = [], 0
        for doc_id, uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            held.append((doc_id, uid, token_hashes(text.as_py())))
            size += len(held[-1][2])
            if size >= TOGETHER:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs_of in (x for b in batches for x in together(b)):
            ends = np.cumsum([len(x[2]) for x in docs_of])
            rows: list[tuple] = []
            for (doc_id, uid, tokens), end, (at, seed) in zip(docs_of, ends, found(np.concatenate([x[2] for x in docs_of]), ends), strict=True):
                for region, (first, own, a, s) in enumerate(stretches(tokens, at - (end - len(tokens)), seed)):
                    rows.append((doc_id, uid, region, first, own.view(np.int64), a.astype(np.int32), s.view(np.int64)))
            doc_id, uid, region, first, *lists = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(uid, pa.int64()), pa.array(region, pa.int32()), pa.array(first, pa.int32())]
                + [list_column(np.concatenate([np.zeros(0, t), *x]), map(len, x)) for x, t in zip(lists, (np.int64, np.int32, np.int64), strict=True)],
                names=["doc_id", "uid", "region", "first", "tokens", "ats", "seeds"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "uid", text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, region int, first int, tokens array<long>, ats array<int>, seeds array<long>")


def best_stretches(equal: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Disjoint stretches (start, end), the union of all of ``least`` tokens or more that have the share of equal ones.

    They are cut to begin and end with an equal token.
    """
    if len(equal) < least:
        return []
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))]) + 1e-9 * np.arange(len(equal) + 1)
    lows = np.minimum.accumulate(sums)
    ends = np.flatnonzero(lows[: len(sums) - least] <= sums[least:]) + least
    starts = np.searchsorted(-lows, -sums[ends])
    out: list[list[int]] = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = [min(s, out[-1][0]), e]
            while len(out) > 1 and out[-1][0] <= out[-2][1]:
                last = out.pop()
                out[-1] = [min(out[-1][0], last[0]), last[1]]
        else:
            out.append([s, e])
    trimmed = []
    for s, e in out:
        own = np.flatnonzero(equal[s:e])
        if len(own):
            trimmed.append((s + int(own[0]), s + int(own[-1]) + 1))
    return trimmed


def overlaps(docs: DataFrame, items: DataFrame, least: int = LEAST_TOKENS, share: float = SHARE, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Verified overlaps of documents (doc_id, uid, text) with benchmark items, and (doc_id, uid) of all documents.

    Overlaps have uid, item_id, doc_at, item_at, n_tokens, n_equal; ``doc_at`` and ``item_at`` count tokens.  Items of
    equal tokens are compared once and all reported; nothing is capped.  The documents are read once.
    """
    items = stored(benchmark_tokens(items))
    names = items.select("item_id", F.xxhash64("tokens").alias("item"), "tokens")
    distinct = stored(names.groupBy("item").agg(F.first("tokens").alias("tokens")))
    seeded = stored(item_seeds(distinct))
    short = distinct.where(F.size("tokens") < LEAST_TOKENS).select(F.size("tokens")).distinct().collect()
    lengths = {length for r in short for _, length in short_blocks(r[0])}
    regions = stored(document_regions(docs, seed_bitmap(seeded, bits), tuple(sorted(lengths))))
    looked = regions.select("uid", "region", "first", F.explode(F.arrays_zip("ats", "seeds")).alias("s")).select("uid", "region", "first", "s.ats", F.col("s.seeds").alias("seed"))
    met = looked.join(seeded, "seed")
    # an item that allows no substitution is its own seed: the hit says all
    plain = met.where(F.col("n") < SPOILED).select("uid", "item", (F.col("first") + F.col("ats")).alias("doc_at"), F.lit(0).alias("item_at"), F.col("n").alias("n_tokens"), F.col("n").alias("n_equal"))
    hits = met.where(F.col("n") >= SPOILED).select("uid", "region", "item", (F.col("ats") - F.col("item_at")).alias("shift")).distinct()
    pairs = hits.join(regions.select("uid", "region", "first", "tokens"), ["uid", "region"]).join(distinct.withColumnRenamed("tokens", "item_tokens"), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                uid, item, shift, first = (b.column(k)[i].as_py() for k in range(4))
                own, test = (b.column(k)[i].values.to_numpy() for k in (4, 5))
                lo, hi = max(0, -shift), min(len(test), len(own) - shift)
                if hi <= lo:
                    continue
                equal = own[lo + shift : hi + shift] == test[lo:hi]
                if len(test) >= LEAST_TOKENS:
                    for s, e in best_stretches(equal, least, share):
                        out.append((uid, item, first + shift + lo + s, lo + s, e - s, int(equal[s:e].sum())))
                elif hi - lo == len(test) and equal.sum() >= len(test) - len(test) // SPOILED:
                    out.append((uid, item, first + shift, 0, len(test), int(equal.sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    columns = ["uid", "item", "doc_at", "item_at", "n_tokens", "n_equal"]
    found = pairs.select("uid", "item", "shift", "first", "tokens", "item_tokens").mapInArrow(verify, "uid long, item long, doc_at int, item_at int, n_tokens int, n_equal int")
    found = found.union(plain).distinct().join(names.select("item_id", "item"), "item").drop("item")
    return found, regions.where("region = 0").select("doc_id", "uid")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, contaminated, n_items, item_ids, spans.

    An item of fewer than 12 tokens must be there from end to end, with at most one token in five substituted; of longer ones
    a stretch of 12 tokens with four fifths equal counts.  ``item_ids`` ascend and are comma-joined; ``spans`` lists token ranges start:end of the overlaps, merged where the
    same stretch meets several items.  Documents and items that are null or empty overlap with nothing.
    """
    found, numbered = overlaps(docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id()), items, **options)
    per = found.groupBy("uid").agg(
        F.array_sort(F.collect_set("item_id")).alias("ids"),
        F.array_sort(F.collect_set(F.struct("doc_at", (F.col("doc_at") + F.col("n_tokens")).alias("end")))).alias("at"),
    )
    spans = F.array_join(F.transform("at", lambda s: F.concat_ws(":", s["doc_at"].cast("string"), s["end"].cast("string"))), ",")
    rows = numbered.join(per, "uid", "left")
    return rows.select(
        "doc_id",
        F.col("ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"),
        F.coalesce(spans, F.lit("")).alias("spans"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that overlap with an item; all columns stay."""
    (uid,) = fresh(docs, "uid")
    numbered = with_uid(docs, uid)
    found, _ = overlaps(numbered.select("doc_id", F.col(uid).alias("uid"), "text"), items, **options)
    return numbered.join(found.select(F.col("uid").alias(uid)).distinct(), uid, "left_anti").drop(uid)
