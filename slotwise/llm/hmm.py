"""Language-model scores from a hidden Markov model.

Every token belongs to a class: frequent words are classes of their own, other words share classes by their
ending.  Latent states emit classes and follow one another; a class emits its words by their corpus
counts.  A text's probability is the product of the exact likelihood of its class sequence, by the scaled
forward recursion, and of its words within their classes.

Corpus counts are sums over all training texts.  Baum-Welch counts are added up over partitions as rows of
one class each.  The training texts are dealt into parts; each round counts one part with the model so far
and re-estimates the model from the latest counts of all parts.  The parts of the first rounds, whose counts
come from a poor model, are counted again at the end, so that every training text weighs alike.  Texts are read
twice: to count words, and to store class sequences and rarer words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import fold_of, stored, text_of

FOLDS, HELD = 7, 2
#: Latent states, words that are classes of their own, classes of the others, parts of the training texts.
STATES, HEAD, TAIL, PARTS = 8, 8000, 512, 12
#: Parts that are counted a second time at the end.
AGAIN = 3
#: Words whose counts every task gets; counts of all others are joined.
KNOWN = 200_000
#: The token after the last word.  No word contains white space.
END = b"\n"
#: Words a worker holds before it passes their counts on.
HELD_WORDS = 400_000
#: Tokens whose sequences are worked on together.
TOGETHER = 400_000


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space with A-Z as lower case, then the end."""
    words = text.lower().split()
    words.append(END)
    return words


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) > HELD_WORDS:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])


@lru_cache(1 << 16)
def tail_class(word: bytes) -> int:
    """The class of a word that has none of its own, from its last bytes and whether it is long."""
    import xxhash

    return xxhash.xxh32_intdigest(word[-3:], len(word) > 7) % TAIL


class Vocabulary:
    """Counts that every task needs: frequent words with their counts, totals of the shared classes.

    The first ``head`` of ``words``, which are ordered by count, are classes of their own.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, head: int, total: int, distinct: int, tail_tokens: np.ndarray, tail_words: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.counts, self.head = np.asarray(counts, np.int64), min(head, len(words))
        self.total, self.distinct = total, distinct
        self.tail_tokens, self.tail_words = tail_tokens, tail_words
        self.classes = self.head + TAIL
        self.class_of = np.array([*range(self.head), *(self.head + tail_class(w) for w in words[self.head :]), 0], np.uint16)

    @property
    def base_total(self) -> float:
        """log10 of N + V + 1."""
        return float(np.log10(self.total + self.distinct + 1))

    def tail_total(self) -> np.ndarray:
        """log10 of what the words of each shared class are divided by, one unseen word included."""
        return np.log10(self.tail_tokens + self.tail_words + 1)


def vocabulary(counts: DataFrame, head: int = HEAD, known: int = KNOWN) -> Vocabulary:
    """From stored (word, c).  At most ``known`` words and one row per shared class reach the driver.

    Words are taken by ranges of their counts, from the largest on, as long as whole ranges fit.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    lowest, room = None, known
    for at, n in sorted(counts.groupBy(level).count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        lowest = at
    top = counts.where(level >= lowest).select("word", "c").toArrow().to_pylist() if lowest is not None else []
    top.sort(key=lambda r: (-r["c"], r["word"]))
    own = {r["word"] for r in top[:head]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, TAIL), np.int64)
        for b in batches:
            for word, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if word not in own:
                    k = tail_class(word)
                    sums[0, k] += c
                    sums[1, k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL)), pa.array(sums[0]), pa.array(sums[1])], names=["k", "n", "v"])

    sums = np.zeros((2, TAIL), np.int64)
    for k, n, v in counts.mapInArrow(run, "k long, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        sums[:, k] = n, v
    return Vocabulary([r["word"] for r in top], [r["c"] for r in top], head, total, distinct, sums[0], sums[1])


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, uid, held_out, part, classes, known, base, within, rare) of ``docs`` (doc_id, uid, held_out, text binary).

    ``classes`` is the class sequence as unsigned 16-bit integers.  ``known``, ``base`` and ``within`` sum up, over the words whose
    counts the task has, their number, log10(c + 1) and the log of their share of a shared class; ``rare`` lists
    the other words of a text with their numbers, and ``within`` has what they are divided by.
    """
    index, head, class_of, totals = words.index, words.head, words.class_of, words.tail_total()
    logs = np.append(np.log10(words.counts + 1), 0.0)
    shares = logs.copy()
    shares[:head] = 0
    shares[head:-1] -= totals[class_of[head:-1].astype(np.int64) - head]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, known, base, within, sizes, rare, times = [], [], [], [], [], [], []
            for text in b.column(3):
                own = tokens(text.as_py())
                at = np.fromiter(map(index.get, own, repeat(-1)), np.int32, len(own))
                ids, other = class_of[at], np.flatnonzero(at < 0)
                share = float(shares[at].sum())
                if len(other):
                    unknown = [own[i] for i in other.tolist()]
                    tails = np.fromiter(map(tail_class, unknown), np.int64, len(unknown))
                    ids[other] = head + tails
                    share -= float(totals[tails].sum())
                    counted = Counter(unknown)
                    rare.extend(counted)
                    times.extend(counted.values())
                    sizes.append(len(counted))
                else:
                    sizes.append(0)
                classes.append(ids.astype("<u2").tobytes())
                known.append(len(own) - len(other))
                base.append(float(logs[at].sum()))
                within.append(share)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(classes, pa.binary()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(within, pa.float64()), pa.ListArray.from_arrays(offsets, pairs)],
                names=["doc_id", "uid", "held_out", "classes", "known", "base", "within", "rare"],
            )

    rows = docs.select("doc_id", "uid", "held_out", "text").mapInArrow(
        run, "doc_id long, uid long, held_out boolean, classes binary, known long, base double, within double, rare array<struct<word: binary, n: long>>"
    )
    return rows.withColumn("part", F.when(~F.col("held_out"), F.pmod(F.xxhash64("doc_id", "uid"), F.lit(PARTS))).cast("int"))


class Model:
    """Start, transition and emission probabilities; emissions have one row per class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def first_model(words: Vocabulary, states: int = STATES) -> Model:
    """Emissions are the classes' corpus shares, made uneven by fixed random factors so that the states can part."""
    rng = np.random.default_rng(12345)
    share = np.concatenate([words.counts[: words.head], words.tail_tokens]) + 1.0
    emit = share[:, None] * np.exp(rng.standard_normal((words.classes, states)))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def lockstep(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of sequences of similar length: (their places, padded class matrix step by step, lengths).

    Longest first within a group, so that at each step the sequences still running are a prefix.
    """
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        group = order[at : at + max(1, TOGETHER // max(1, longest))]
        lengths = np.array([len(sequences[i]) for i in group])
        grid = np.zeros((longest, len(group)), np.uint16)
        for k, i in enumerate(group):
            grid[: lengths[k], k] = sequences[i]
        yield group, grid, lengths
        at += len(group)


def _running(grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many sequences still run at each step."""
    return np.searchsorted(-lengths, -np.arange(len(grid)), side="left")


def _steps(model: Model, grid: np.ndarray, running: np.ndarray, state: np.ndarray, first: int, last: int, keep: tuple | None = None) -> np.ndarray:
    """Scaled forward recursion over steps ``first`` to ``last`` (exclusive), from ``state``, which it changes; the logs of the scales, summed."""
    logs = np.zeros(grid.shape[1])
    for t in range(first, last):
        k = running[t]
        before = state[:k] @ model.move if t else state[:k]
        now = before * model.emit[grid[t, :k]]
        scale = now.sum(axis=1)
        now /= scale[:, None]
        state[:k] = now
        logs[:k] += np.log(scale)
        if keep:
            keep[0][t - first, :k], keep[1][t - first, :k] = now, scale
    return logs


def forward(model: Model, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log likelihoods of the sequences."""
    return _steps(model, grid, _running(grid, lengths), np.tile(model.start, (grid.shape[1], 1)), 0, len(grid))


def expected_counts(model: Model, grid: np.ndarray, lengths: np.ndarray, emit: np.ndarray, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts and moves; those of emissions are added to ``emit``.

    Forward vectors are held for about ``together`` tokens: of longer sequences, only those at the ends of stretches are
    kept, and a stretch is run forward once more when the backward recursion reaches it.
    """
    n, states, running = grid.shape[1], len(model.start), _running(grid, lengths)
    stretch = max(1, together // max(1, n))
    firsts = list(range(0, len(grid), stretch))
    state, held = np.tile(model.start, (n, 1)), []
    for first in firsts[:-1]:
        held.append(state.copy())
        _steps(model, grid, running, state, first, first + stretch)
    held.append(state)
    move, beta, start = np.zeros((states, states)), np.ones((n, states)), np.zeros(states)
    ahead = None  # the step after, as far as it can be made before the one at hand is known
    for first in reversed(firsts):
        last = min(first + stretch, len(grid))
        alphas, scales = np.zeros((last - first, n, states)), np.ones((last - first, n))
        _steps(model, grid, running, held.pop(), first, last, (alphas, scales))
        for t in range(last - 1, first - 1, -1):
            k, own = running[t], alphas[t - first]
            if ahead is not None:
                move += own[: len(ahead)].T @ ahead
            own[:k] *= beta[:k]
            ahead = None
            if t:
                ahead = model.emit[grid[t, :k]] * beta[:k] / scales[t - first, :k, None]
                beta[:k] = ahead @ model.move.T
            else:
                start = own.sum(axis=0)
        valid = np.arange(n) < running[first:last, None]
        classes, weights = grid[first:last][valid], alphas[valid]
        for s in range(states):
            emit[:, s] += np.bincount(classes, weights[:, s], len(emit))
    return start, move * model.move


def _sequences(column: pa.Array) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for x in column:
        held.append(np.frombuffer(x.as_py(), "<u2"))
        size += len(held[-1])
        if size >= 4 * TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_round(rows: DataFrame, model: Model) -> DataFrame:
    """(k, s0, s1, ...) summed over ``rows``: emission counts by class, then one row per state for moves, then starts."""
    states, n = len(model.start), len(model.emit)
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + states + 1, states))
        for b in batches:
            for sequences in _sequences(b.column(0)):
                for _, grid, lengths in lockstep(sequences):
                    start, move = expected_counts(model, grid, lengths, total[:n])
                    total[n : n + states] += move
                    total[-1] += start
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, i]) for i in range(states)]], names=["k", *names])

    schema = "k long, " + ", ".join(f"{x} double" for x in names)
    return rows.select("classes").mapInArrow(run, schema).groupBy("k").agg(*[F.sum(x).alias(x) for x in names])


def corpus_counts(rows: DataFrame, words: Vocabulary, parts: int = PARTS, again: int = AGAIN) -> tuple[Model, np.ndarray]:
    """The model after all rounds but its last estimate, and the latest Baum-Welch counts of all parts of ``rows`` (classes, part)."""
    model, n = first_model(words), words.classes
    latest = np.zeros((parts, n + STATES + 1, STATES))
    for part in [*range(parts), *range(again)]:
        found = np.zeros(latest.shape[1:])
        for row in count_round(rows.where(F.col("part") == part), model).collect():
            found[row[0]] = row[1:]
        latest[part] = found
        model = _estimate(latest.sum(axis=0), words)
    return model, latest.sum(axis=0)


def _estimate(total: np.ndarray, words: Vocabulary) -> Model:
    """Every class keeps a small pseudo-count in proportion to its corpus share, so unseen ones stay possible."""
    n = words.classes
    share = np.concatenate([words.counts[: words.head], words.tail_tokens]) + 1.0
    emit = total[:n] + 20 * (share / share.sum())[:, None]
    move, start = total[n : n + STATES] + 1, total[-1] + 1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(rows: DataFrame, words: Vocabulary, parts: int = PARTS, again: int = AGAIN) -> Model:
    """Incremental Baum-Welch over the parts of ``rows`` (classes, part); rows without part are left out."""
    return corpus_counts(rows, words, parts, again)[0]


def sequence_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(uid, doc_id, held_out, n_tokens, known, base, within, sequence): log10 likelihoods of the class sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            sizes = [len(x.as_py()) // 2 for x in b.column(0)]
            for sequences in _sequences(b.column(0)):
                own = np.zeros(len(sequences))
                for group, grid, lengths in lockstep(sequences):
                    own[group] = forward(model, grid, lengths)
                out.append(own)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(1, 7)], pa.array(sizes, pa.int64()), pa.array(np.concatenate([np.zeros(0), *out]) / np.log(10))],
                names=["uid", "doc_id", "held_out", "known", "base", "within", "n_tokens", "sequence"],
            )

    return rows.select("classes", "uid", "doc_id", "held_out", "known", "base", "within").mapInArrow(
        run, "uid long, doc_id long, held_out boolean, known long, base double, within double, n_tokens long, sequence double"
    )


def rare_scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(uid, rare_known, rare_base): sums over the words whose counts are joined."""
    spread = rows.select("uid", F.inline("rare")).join(counts, "word", "left")
    seen, log = F.when(F.col("c").isNotNull(), F.col("n")), F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    return spread.groupBy("uid").agg(F.sum(seen).alias("rare_known"), F.sum(log).alias("rare_base"))


def score_texts(docs: DataFrame, head: int = HEAD, known: int = KNOWN) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose id's crc32 modulo ``FOLDS`` is ``HELD`` are held out and teach nothing.  A null or empty text is the end
    alone.  Without training texts every count is zero and all unseen words share one probability.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("uid"),
        (fold_of("doc_id", FOLDS) == HELD).alias("held_out"),
        text_of("text").cast("binary").alias("text"),
    )
    counts = stored(word_counts(rows.where(~F.col("held_out"))))
    words = vocabulary(counts, head, known)
    coded = stored(encoded(rows, words))
    model = train(coded.where("part IS NOT NULL"), words)
    per = sequence_scores(coded, model).join(rare_scores(coded, counts), "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("rare_base")) - F.col("n_tokens") * F.lit(words.base_total)).alias("base_score"),
        (F.col("sequence") + F.col("within") + zero(F.col("rare_base"))).alias("score"),
    )
