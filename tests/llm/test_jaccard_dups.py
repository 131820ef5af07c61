import random

import numpy as np
import pytest

import corpus_pipeline
from slotwise.llm.minhash import band_keys, keep_dissimilar, shingles
from tests.llm.test_near_dups import reach, texts_near


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_links(texts):
    """All pairs at 0.8 or more, compared one by one."""
    sets = [plain_set(t) for t in texts]
    return [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0
    ]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(words)), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def texts_similar():
    """Groups around 0.8 on either side, chains, a group whose smallest member is far from most, and short texts."""
    rng = random.Random(5)
    out = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(words))
        out += [changed(rng, words, max(1, len(words) * k // 200)) for k in (1, 3, 4, 5, 6, 8)]
    words = [f"v{i}" for i in range(300)]
    for i in range(60):  # each is near the next ones only
        out.append(" ".join([*words[i * 4 :], *[f"u{k}" for k in range(i * 4)]]))
    return [*out, *out[:5], "one two", "one  TWO", "one two three", "a b c d e f", "a b c d e g"]


@pytest.mark.parametrize("block", [2048, 3])
def test_keep_dissimilar(spark, parquet_of, edges, block):
    texts = [*edges, *texts_similar(), *texts_near()]
    random.Random(1).shuffle(texts)
    docs = parquet_of(texts)
    links = plain_links(texts)
    want = {i for i, r in reach(range(len(texts)), links).items() if i == r}
    kept = keep_dissimilar(docs, block)
    assert kept.columns == docs.columns and len(links) > 300
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_rows_without_ids(spark):
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in keep_dissimilar(twice).collect()) == [0, 1]
    assert keep_dissimilar(twice.limit(0)).count() == 0


def test_recall_of_planted_pairs_at_the_threshold():
    rng = random.Random(2)
    found = []
    while len(found) < 500:
        words = [f"w{rng.randrange(50_000)}" for _ in range(200)]
        a, b = (shingles(t.encode()) for t in (" ".join(words), changed(rng, words, 5)))
        both = len(np.intersect1d(a, b))
        if 0.8 <= both / (len(a) + len(b) - both) <= 0.82:
            found.append((band_keys(a) == band_keys(b)).any())
    assert np.mean(found) >= 0.998


def test_pipeline_stage_drops_what_a_plain_comparison_drops(spark, parquet_of, tmp_path):
    texts = texts_similar()
    want = {i for i, r in reach(range(len(texts)), plain_links(texts)).items() if i == r}
    kept = corpus_pipeline.drop_near_duplicates(spark, parquet_of(texts), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == want
