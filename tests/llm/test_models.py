import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from slotwise.llm import hmm
from slotwise.llm.toxicity import ToxicityModel, keep_innocent, score_toxicity, train, training_sample


def spoken(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_forward_is_the_exact_likelihood():
    rng = np.random.default_rng(1)
    start, move, emit = rng.random(3), rng.random((3, 3)), rng.random((5, 3))
    model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 5, 2)]
    for group, grid, lengths in hmm.lockstep(sequences):
        for place, log in zip(group, hmm.forward(model, grid, lengths), strict=True):
            own, total = sequences[place], 0.0
            for path in itertools.product(range(3), repeat=len(own)):
                p = model.start[path[0]] * model.emit[own[0], path[0]]
                for t in range(1, len(own)):
                    p *= model.move[path[t - 1], path[t]] * model.emit[own[t], path[t]]
                total += p
            assert math.isclose(log, math.log(total), rel_tol=1e-9)


def test_baum_welch_counts_equal_posteriors():
    rng = np.random.default_rng(2)
    start, move, emit = rng.random(2), rng.random((2, 2)), rng.random((3, 2))
    model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    own = np.array([0, 2, 1, 2])
    want_emit, want_move, total = np.zeros((3, 2)), np.zeros((2, 2)), 0.0
    for path in itertools.product(range(2), repeat=4):
        p = model.start[path[0]] * model.emit[own[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[own[t], path[t]]
        total += p
        for t, s in enumerate(path):
            want_emit[own[t], s] += p
            if t:
                want_move[path[t - 1], s] += p
    emit = np.zeros((3, 2))
    (_, grid, lengths), = hmm.lockstep([own])
    _, got_move = hmm.expected_counts(model, grid, lengths, emit)
    assert np.allclose(emit, want_emit / total) and np.allclose(got_move, want_move / total)


def test_long_sequences_are_counted_in_stretches():
    rng = np.random.default_rng(4)
    start, move, emit = rng.random(3), rng.random((3, 3)), rng.random((6, 3))
    model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    sequences = [rng.integers(0, 6, n) for n in (50, 49, 31, 7, 1)]
    (_, grid, lengths), = hmm.lockstep(sequences)
    results = []
    for together in (1, 5, 35, 10_000):
        emitted = np.zeros((6, 3))
        results.append((*hmm.expected_counts(model, grid, lengths, emitted, together), emitted))
    for other in results[1:]:
        assert all(np.allclose(x, y) for x, y in zip(results[0], other, strict=True))
    assert math.isclose(results[0][2].sum(), 138) and math.isclose(results[0][0].sum(), 5) and math.isclose(results[0][1].sum(), 133)


def plain_scores(texts, held, model, words):
    """log10 of the text by a forward recursion over single numbers and dictionaries of counts."""
    tokens = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    counts = Counter(w for own, h in zip(tokens, held, strict=True) if not h for w in own)
    head = {w: i for w, i in words.index.items() if i < words.head}
    groups = {}
    for w, c in counts.items():
        if w not in head:
            n, v = groups.get(hmm.tail_class(w), (0, 0))
            groups[hmm.tail_class(w)] = n + c, v + 1
    out = []
    for own in tokens:
        classes = [head.get(w, words.head + hmm.tail_class(w)) for w in own]
        log, state = 0.0, [float(x) for x in model.start]
        for t, k in enumerate(classes):
            if t:
                state = [sum(state[i] * float(model.move[i, j]) for i in range(len(state))) for j in range(len(state))]
            state = [x * float(model.emit[k, j]) for j, x in enumerate(state)]
            log += math.log10(sum(state))
            state = [x / sum(state) for x in state]
        for w in own:
            if w not in head:
                n, v = groups.get(hmm.tail_class(w), (0, 0))
                log += math.log10((counts[w] + 1) / (n + v + 1))
        out.append(log)
    return out


@pytest.mark.parametrize(("head", "known"), [(30, 70), (8000, 200_000), (5, 0)])
def test_scores(spark, docs_of, edges, head, known):
    rng = random.Random(3)
    tongues = [["".join(rng.choice(s) for _ in range(4)) for _ in range(60)] for s in ("abcd", "wxyz")]
    texts = [*edges, *[spoken(rng, tongues[i % 2], 80) for i in range(240)], "Never SEEN words", "never seen words"]
    docs = docs_of(texts)
    rows = hmm.score_texts(docs, head, known).orderBy("doc_id").collect()
    tokens = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(w for own, h in zip(tokens, held, strict=True) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    for own, h, r in zip(tokens, held, rows, strict=True):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(own), sum(w in counts for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    words, model, total = trained(docs, head, known)
    assert math.isclose(total[-1].sum(), held.count(False)) and math.isclose(total[: words.classes].sum(), n)
    for want, r in zip(plain_scores(texts, held, model, words), rows, strict=True):
        assert math.isclose(r["score"], want, rel_tol=1e-6)
    if known:
        tested = [r for r in rows if r["held_out"] and r["doc_id"] >= len(edges)]
        assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)
    assert hmm.score_texts(docs_of([])).count() == 0


def trained(docs, head, known):
    """Vocabulary, model and the counts it was last estimated from, of the same rows as ``score_texts``."""
    rows = docs.selectExpr("doc_id", "monotonically_increasing_id() as uid", "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2 as held_out", "cast(coalesce(text, '') as binary) as text")
    words = hmm.vocabulary(hmm.word_counts(rows.where("NOT held_out")), head, known)
    model, total = hmm.corpus_counts(hmm.encoded(rows, words).where("part IS NOT NULL"), words)
    return words, model, total


def test_repeated_rows_and_null_ids_are_scored(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (None, None), (2, "c")]
    got = hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({round(r["score"], 9) for r in got if r["n_tokens"] == 3}) == 1


def toxic_docs(rng, n):
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    bad = ["zulk", "zulkig", "zulkor", "quax"]
    rows = []
    for i in range(n):
        y = int(i % 3 == 0)
        sentences = [spoken(rng, plain, 8) for _ in range(rng.randint(2, 8))]
        if y:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(bad)
        rows.append((". ".join(sentences), y))
    return rows


def test_toxicity(spark, docs_of, edges):
    rows = toxic_docs(random.Random(7), 600)
    texts = [t for t, _ in rows] + edges
    docs = docs_of(texts)
    labels = [(i, y) for i, (_, y) in enumerate(rows)] + [(0, None), (None, 1), (1, rows[1][1]), (1, rows[1][1])]
    sample = training_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sample.count() == 600 - len(held)
    model = train(sample)
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    right = sum(got[i]["predicted"] == rows[i][1] for i in held)
    assert len(got) == len(texts) and right >= 0.97 * len(held)
    for i in held:
        for s in got[i]["spans"]:
            inside = rows[i][0].encode()[s["start"] : s["end"]]
            assert rows[i][1] == 0 or b"zulk" in inside or b"quax" in inside or got[i]["predicted"] == 0
    assert got[600]["score"] == got[601]["score"] == 0.0
    kept = keep_innocent(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if not r["predicted"])


def test_toxicity_without_examples(spark, docs_of):
    docs = docs_of(["a b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(training_sample(docs, none))
    assert [r["predicted"] for r in score_toxicity(docs, model).collect()] == [0, 0]
    assert score_toxicity(docs.limit(0), ToxicityModel()).count() == 0
