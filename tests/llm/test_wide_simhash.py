import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import wide_simhash
from slotwise.llm.minhash import shingles, similar
from slotwise.llm.wide_simhash import (
    RADIUS,
    SEGMENTS,
    bit_sums,
    candidate_groups,
    fingerprints,
    folded,
    in_label_blocks,
    joined_labels,
    keep_dissimilar,
    label_blocks,
    portions,
    sketches,
)
from slotwise.session import workspace
from tests.llm.test_jaccard_dups import changed, plain_links, texts_similar
from tests.llm.test_near_dups import reach, texts_near


@pytest.mark.parametrize("block", [2048, 3])
def test_keeps_what_a_plain_comparison_keeps(spark, parquet_of, edges, block):
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


def sets_at(rng, own, other, both):
    pool = rng.integers(0, (1 << 64) - 1, own + other - both, np.uint64)
    return np.sort(pool[:own]), np.sort(pool[own - both :])


@pytest.mark.parametrize("sizes", [(4, 5, 4), (9, 9, 8), (90, 90, 80), (300, 370, 298), (2250, 2250, 2000)])
def test_recall_of_planted_pairs_at_the_threshold(sizes):
    rng = np.random.default_rng(4)
    pairs = [sets_at(rng, *sizes) for _ in range(1000)]
    assert all(similar(a, b) for a, b in pairs)
    (keys, further), (others, beyond) = (fingerprints(bit_sums([p[i] for p in pairs])) for i in range(2))
    keys, others = (x.reshape(len(pairs), SEGMENTS, -1) for x in (keys, others))
    met = (keys[:, :, :, None] == others[:, :, None, :]).any((1, 2, 3))
    near = np.bitwise_count((further ^ beyond).view(np.uint64)).sum(axis=1) <= RADIUS
    assert (met & near).mean() >= 0.998


def test_a_bit_is_the_sign_of_the_sum_of_what_its_shingles_add():
    sets = [shingles(t.encode()) for t in ("a b c d e f g h", "a b c d e", "", "x " * 9)]
    alone = [bit_sums([np.array([x], np.uint64)])[0] for x in sets[0]]
    sums = bit_sums(sets, portion=2)
    assert np.allclose(sums[0], sum(alone)) and not sums[2].any()
    keys, _ = fingerprints(sums)
    ball = keys.reshape(len(sets), SEGMENTS, -1)
    assert set(np.bitwise_count(ball[:, :, 1:] ^ ball[:, :, :1]).ravel()) == {1}  # radius one around the own value


def test_unlike_texts_are_no_candidates(spark):
    rng = random.Random(8)
    words = [[f"w{rng.randrange(9000)}" for _ in range(150)] for _ in range(300)]
    rows = [(i, i, " ".join(w)) for i, w in enumerate(words)] + [(300 + i, 300 + i, changed(rng, words[i], 2)) for i in range(40)]
    marks = sketches(spark.createDataFrame(rows, "doc_id long, uid long, text string"))
    groups = {r["node"]: r["root"] for r in candidate_groups(marks).collect()}
    assert groups == {i: i % 300 for i in [*range(40), *range(300, 340)]}


def test_folded_edges_join_the_same_and_are_few(spark):
    rng = random.Random(6)
    edges = [(a, b) for a in range(400) for b in rng.sample(range(400), 30) if a % 2 == b % 2]
    few = [tuple(r) for r in folded(folded(spark.createDataFrame(edges, "a long, b long"))).collect()]
    assert reach(range(400), few) == {i: i % 2 for i in range(400)} and len(few) < len(edges) / 5


@pytest.mark.parametrize("block", [2048, 48])
def test_a_large_group_makes_few_links_a_member(spark, tmp_path, monkeypatch, block):
    rng, seen = random.Random(7), []
    words = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = [(i, i, changed(rng, words, 1)) for i in range(300)] + [(300 + i, 300 + i, " ".join(f"u{i}_{k}" for k in range(50))) for i in range(20)]
    path = str(tmp_path / "marks")
    sketches(spark.createDataFrame(rows, "doc_id long, uid long, text string")).write.parquet(path)
    monkeypatch.setattr(wide_simhash, "folded", lambda links: seen.append(links.count()) or folded(links))
    groups = {r["node"]: r["root"] for r in candidate_groups(spark.read.parquet(path), block).collect()}
    assert groups == dict.fromkeys(range(300), 0) and sum(seen) < 10 * 300


def test_blocks_of_labels_meet_and_few_rows_are_made(spark):
    rng = random.Random(3)
    far = rng.getrandbits(62)
    marks = [(1, i, 0 if i < 500 else i, i % 3, 0) for i in range(520)]  # one label for nearly all, all are near
    marks += [(2, i, i, far if i % 2 else ~far, far if i % 2 else ~far) for i in range(60)]  # two halves, each its own label
    marks += [(3, i, 7, 0, 0) for i in range(100)]  # one label
    marks += [(4, i, i // 2, 0, 0) for i in range(5)]  # a small place
    rows = spark.createDataFrame(marks, "key int, uid long, label long, f0 long, f1 long")
    placed = in_label_blocks(rows, label_blocks(rows.where("key < 4"), 10))
    counts = {r["key"]: r["count"] for r in placed.groupBy("key").count().collect()}
    # 500 members meet two blocks of others, and 20 others two of their own and 50 of the frequent label
    assert counts[1] == 500 * 2 + 20 * 52 and counts[2] <= 60 * 7 and counts[4] == 5 and 3 not in counts
    met = {}
    for key, lo, hi, label in placed.select("key", "lo", "hi", "label").distinct().collect():
        met.setdefault((key, lo, hi), set()).add(label)
    want = [(1, [0, *range(500, 520)]), (2, list(range(60))), (4, [0, 1, 2])]
    assert all(any(k[0] == key and {a, b} <= x for k, x in met.items()) for key, labels in want for a in labels for b in labels)
    links = {key: reach(range(520), [tuple(r) for r in joined_labels(placed.where(F.col("key") == key)).collect()]) for key in (1, 2, 4)}
    assert all(links[1][i] == 0 for i in [0, *range(500, 520)]) and {links[2][i] for i in range(60)} == {0, 1}
    assert [links[4][i] for i in range(3)] == [0, 0, 0]


def test_only_the_rows_and_the_kept_ids_stay_stored(spark, parquet_of):
    docs = parquet_of(texts_similar())
    with workspace(spark) as folder:
        before = set(os.listdir(os.path.dirname(folder).removeprefix("file:")))
        kept = keep_dissimilar(docs)
        left = os.listdir(folder.removeprefix("file:"))
        assert len(left) == 2 and set(os.listdir(os.path.dirname(folder).removeprefix("file:"))) - before <= {os.path.basename(folder)}
        assert kept.count() < docs.count()


def test_portions_hold_each_segment_once():
    assert [i for a, b in portions() for i in range(a, b)] == list(range(SEGMENTS))


def test_the_pipeline_stage_finds_its_candidates_by_simhash(spark, parquet_of, tmp_path, monkeypatch):
    called, search = [], wide_simhash.candidate_groups
    monkeypatch.setattr(wide_simhash, "candidate_groups", lambda *a: called.append(1) or search(*a))
    texts = texts_similar()
    want = {i for i, r in reach(range(len(texts)), plain_links(texts)).items() if i == r}
    kept = corpus_pipeline.drop_near_duplicates(spark, parquet_of(texts), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == want and called
