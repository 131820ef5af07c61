"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic function of the weights of its
distinct words and word beginnings; a document is toxic unless every sentence is innocent (noisy-or).  Only document labels
train the weights: gradients of the bags' log-likelihood are summed over partitions, and the scores of
single sentences then locate the offending ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import fold_of, stored, text_of

#: Labelled documents that train, words that get a weight, and gradient steps: bounds of the fit.
TRAIN_DOCUMENTS, TRAIN_WORDS, STEPS = 12_000, 4000, 40
FOLDS = 5
_SENTENCE = re.compile(rb"[^.!?\n]+")
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


#: Lengths in bytes of the word beginnings that are features; they are marked to differ from words.
STEMS = (4, 5)


def features(words: Iterable[bytes]) -> set[bytes]:
    """Words, and the beginnings of longer ones."""
    own = set(words)
    return own | {b"^" + w[:n] for n in STEMS for w in own if len(w) > n}


def sentences(text: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, words) of every sentence in bytes; letters A-Z count as lower case."""
    for m in _SENTENCE.finditer(text.lower()):
        yield m.start(), m.end(), _WORD.findall(m.group())


@dataclass
class ToxicityModel:
    """Weights by word, and the score of a sentence without any weighted word."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -9.0

    def score(self, text: bytes, report: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and its sentences (start, end, probability) of at least ``report``, in bytes.

        A text without sentences scores 0.
        """
        weights, quiet, plain, offending = self.weights, 0.0, 0, []
        for start, end, words in sentences(text):
            hit = [w for w in features(words) if w in weights]
            if not hit:
                plain += 1
                continue
            z = self.bias + sum(weights[w] for w in hit)
            quiet += _log_innocent(z)
            if (p := 1 - np.exp(_log_innocent(z))) >= report:
                offending.append((start, end, float(p)))
        quiet += plain * _log_innocent(self.bias)
        return float(1 - np.exp(quiet)), offending


def _log_innocent(z: float) -> float:
    """log(1 - sigmoid(z))."""
    return -(np.log1p(np.exp(-abs(z))) + max(z, 0.0))


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(y, text) of the training documents: labelled, not held out, at most ``most``, chosen by a hash of the id.

    Repeated labels of one id count once, the larger holds; null labels and ids are left out.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != 0))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").cast("binary").alias("text"))
    return texts.join(own, "doc_id").select("y", "text")


def train(sample: DataFrame, words: int = TRAIN_WORDS, steps: int = STEPS, least: int = 4) -> ToxicityModel:
    """Fit a model to documents (y, text).

    Words of at least ``least`` training documents with the largest |log-odds| z-values get weights,
    which start at their log-odds.  Without documents of both labels the model finds nothing toxic.
    """
    sample = stored(sample.where("y IS NOT NULL"))
    totals = {y: n for y, n in sample.groupBy("y").count().collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    if not good or not bad:
        return ToxicityModel({}, -50.0)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, ws = [], []
            for y, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = features(_WORD.findall(text.as_py().lower()))
                ys += [y] * len(own)
                ws += own
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ws, pa.binary())], names=["y", "word"])

    counts = sample.mapInArrow(seen, "y int, word binary").groupBy("word").agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("g"))
    b, g = F.col("b") + 0.5, F.col("g") + 0.5
    odds = F.log(b / (bad + 1)) - F.log(g / (good + 1))
    z = F.abs(odds) / F.sqrt(1 / b + 1 / g)
    rows = counts.where(F.col("b") + F.col("g") >= least).select("word", odds.alias("odds"), z.alias("z")).orderBy(F.desc("z"), "word").limit(words).collect()
    index = {bytes(r["word"]): i for i, r in enumerate(rows)}
    weights = np.array([r["odds"] for r in rows])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, plains = [], []
            for text in batch.column(1):
                bag, plain = [], 0
                for _, _, own in sentences(text.as_py()):
                    hit = sorted(index[w] for w in features(own) if w in index)
                    if hit:
                        bag.append(hit)
                    else:
                        plain += 1
                bags.append(bag)
                plains.append(plain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plains, pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["y", "plain", "bag"])

    encoded = stored(sample.mapInArrow(encode, "y int, plain int, bag array<array<int>>").coalesce(4))
    params = np.concatenate([np.clip(weights, -3, 6), [-6.0]])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        gradient = _gradient(encoded, params) / (good + bad) - 1e-5 * np.append(params[:-1], 0)
        first = 0.8 * first + 0.2 * gradient
        second = 0.95 * second + 0.05 * gradient**2
        params = params + 0.15 * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-6)
    return ToxicityModel({w: float(params[i]) for w, i in index.items() if abs(params[i]) > 0.02}, float(params[-1]))


def _gradient(encoded: DataFrame, params: np.ndarray) -> np.ndarray:
    """Gradient of the bags' log-likelihood, summed over partitions: one row per task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(params)
        for b in batches:
            y, plain, bags = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            outer, inner = bags.offsets.to_numpy(), bags.values.offsets.to_numpy()
            words = bags.values.values.to_numpy()
            sizes = np.diff(inner)
            sentence_of = np.repeat(np.arange(len(sizes)), sizes)
            words = words[inner[0] : inner[-1]]
            z = np.bincount(sentence_of, params[words], len(sizes)) + params[-1]
            document = np.repeat(np.arange(len(y)), np.diff(outer))
            z = z[outer[0] : outer[-1]] if len(z) != outer[-1] - outer[0] else z
            p = 1 / (1 + np.exp(-z))
            p0 = 1 / (1 + np.exp(-params[-1]))
            quiet = np.bincount(document, -np.logaddexp(0, z), len(y)) - plain * np.logaddexp(0, params[-1])
            toxic = np.clip(-np.expm1(quiet), 1e-12, 1)
            slope = np.where(y == 1, (1 - toxic) / toxic, -1.0)
            by_sentence = slope[document] * p
            total[:-1] += np.bincount(words, by_sentence[sentence_of], len(params) - 1)
            total[-1] += by_sentence.sum() + (slope * plain * p0).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    return np.sum([np.array(r[0]) for r in encoded.mapInArrow(part, "g array<double>").collect()], axis=0)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted, spans) of every whole text of ``docs`` (doc_id, text).

    ``spans`` lists the offending sentences as (start, end, score), offsets in UTF-8 bytes.  Empty texts score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            found = [model.score(x.as_py()) for x in b.column(1)]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in own] for _, own in found]
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)],
                names=["doc_id", "score", "predicted", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,score:double>>")


def keep_innocent(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows of ``docs`` that the model does not call toxic; all columns stay."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def innocent(text: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py())[0] < 0.5 for x in text], pa.bool_())

    return docs.where(innocent(text_of("text").cast("binary")))
