import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from slotwise.llm.decontaminate import best_stretches, contaminated, item_classes, keep_clean, seeds, short_blocks
from slotwise.llm.repeats import intervals, remove_repeats, repeat_groups, repeated_ranges, segments


def covered(parts, length):
    counts = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    out = []
    for p in parts:
        mask = np.zeros(len(p), bool)
        for i in range(len(p) - length + 1):
            if counts[p[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("tripled", [0, 2_000_000])
def test_suffix_array_ranges_equal_a_plain_count(monkeypatch, tripled):
    monkeypatch.setattr("slotwise.llm.repeats.TRIPLED", tripled)
    rng = random.Random(3)
    for _ in range(150):
        length, signs = rng.choice([3, 5, 8]), rng.choice([b"ab", b"abc\0"])
        parts = [bytes(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        for got, want in zip(repeated_ranges(parts, length), covered(parts, length), strict=True):
            mask = np.zeros(len(want), bool)
            for s, e in got:
                mask[s:e] = True
            assert (mask == want).all(), parts


def test_maximal_repeats_have_all_occurrences():
    parts = [b"xabcdy", b"zabcdw", b"uabcdy", b"qbcdq"]
    got = {(n, tuple(sorted(where))) for n, where in repeat_groups(parts, 3)}
    assert got == {(5, ((0, 1), (2, 1))), (4, ((0, 1), (1, 1), (2, 1))), (3, ((0, 2), (1, 2), (2, 2), (3, 1)))}
    assert intervals(np.array([0, 4, 4, 0, 3]), 3) == [(4, 0, 2), (3, 3, 4)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    passage = bytes(rng.randrange(97, 110) for _ in range(260))
    texts = [bytes(rng.randrange(97, 110) for _ in range(n)) + passage + b"end" for n in (0, 90, 70_000)]
    for s in range(61):
        found = set()
        for t in texts:
            at = t.index(passage) + s
            for anchors, starts, ends in segments(t):
                own = np.flatnonzero((starts <= at) & (at + 200 <= ends))
                found |= {int(a) for a in anchors[own]}
        assert len(found) == 1


@pytest.mark.parametrize("large", [2000, 1])
def test_remove_repeats(spark, parquet_of, edges, large):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passage, other = letters(300), letters(210)
    texts = [*edges[:-2], letters(500), letters(80) + passage + letters(90), passage + letters(10), other + letters(50) + other, "x" * 700]
    texts += [letters(40) + passage[:199], letters(30) + passage[20:240] + letters(5), texts[8], texts[8]]
    texts += [letters(60) + passage + letters(70) for _ in range(12)]
    rows = remove_repeats(parquet_of(texts), large=large).orderBy("doc_id").collect()
    data = [(t or "").encode() for t in texts]
    for text, mask, r in zip(data, covered(data, 200), rows, strict=True):
        kept = bytes(np.frombuffer(text, np.uint8)[~mask])
        edges_of = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        assert r["n_bytes"] == len(text) and bytes(r["kept"]) == kept
        assert [tuple(s) for s in r["spans"]] == list(zip(edges_of[::2].tolist(), edges_of[1::2].tolist(), strict=True))
    assert hashlib.sha256(b"").hexdigest() and remove_repeats(parquet_of([])).count() == 0


def test_masks_find_any_two_substitutions_in_twelve_tokens():
    rng = np.random.default_rng(0)
    for p, q in itertools.combinations(range(12), 2):
        a = rng.integers(1, 1 << 60, 12).astype(np.uint64)
        b = a.copy()
        b[[p, q]] = [1, 2]
        assert any((x == y).any() for (_, x), (_, y) in zip(seeds(a), seeds(b), strict=True))


def test_best_stretches_equal_a_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 60)) < 0.75
        want = np.zeros(len(equal), bool)
        for s, e in itertools.combinations(range(len(equal) + 1), 2):
            if e - s >= 12 and equal[s:e].sum() >= 0.8 * (e - s) - 1e-9:
                want[s:e] = True
        got = np.zeros(len(equal), bool)
        for s, e in best_stretches(equal, 12, 0.8):
            got[s:e] = True
        assert (got <= want).all() and not (equal & want & ~got).any()


def test_contaminated(spark, docs_of, edges):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(500)]
    said = lambda n: [rng.choice(words) for _ in range(n)]
    items = [said(40) for _ in range(5)] + [said(8), said(5), said(3)]
    changed = list(items[1])
    for i in range(3, 40, 6):
        changed[i] = "other"
    broken = list(items[2])
    for i in range(0, 40, 3):
        broken[i] = "other"
    texts = [*edges, " ".join(said(50) + items[0] + said(50)).upper(), " ".join(said(9) + changed), " ".join(broken), " | ".join(said(30) + items[3][5:20] + said(4))]
    texts += [" ".join(items[4][:9]), " ".join(said(9) + items[5] + said(9)), " ".join(said(3) + items[6]), " ".join(items[7]), " ".join(items[0])]
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(9, None, ""), (10, "", ""), (11, " ".join(items[0]), "")], "item_id long, text string, uid string")
    rows = {r["doc_id"]: r for r in contaminated(docs_of(texts), bench).collect()}
    n = len(edges)
    want = {n: "0,11", n + 1: "1", n + 3: "3", n + 5: "5", n + 6: "6", n + 7: "7", n + 8: "0,11"}
    assert {i: r["item_ids"] for i, r in rows.items() if r["contaminated"]} == want and len(rows) == len(texts)
    assert rows[n]["spans"] == "50:90"
    kept = keep_clean(docs_of(texts), bench)
    assert kept.columns == docs_of(texts).columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if i not in want]
    assert contaminated(docs_of(texts), bench.limit(0)).where("contaminated").count() == 0
    assert contaminated(docs_of(texts).limit(0), bench).count() == 0


def plain_overlap(doc, item):
    """Whether an aligned stretch of the item is in the document, by all shifts."""
    n = len(item)
    for shift in range(-n, len(doc)):
        lo, hi = max(0, -shift), min(n, len(doc) - shift)
        equal = [doc[i + shift] == item[i] for i in range(lo, hi)]
        if n < 12:
            if hi - lo == n and sum(equal) >= n - n // 5:
                return True
            continue
        sums = np.concatenate([[0], np.cumsum(equal)])
        for size in range(12, len(equal) + 1):
            if ((sums[size:] - sums[:-size]) >= 0.8 * size - 1e-9).any():
                return True
    return False


def test_items_of_all_lengths_equal_a_plain_search(spark, docs_of):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    items = [[rng.choice(words) for _ in range(1 + i % 30)] for i in range(60)] + [["rare", "pair"], ["rare"]]
    texts = []
    for i in range(160):
        own = [rng.choice(words[:25]) for _ in range(rng.randrange(0, 30))]
        planted = list(items[i % len(items)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            planted[rng.randrange(len(planted))] = "other"
        cut = rng.randrange(len(own) + 1)
        texts.append(own[:cut] + planted + own[cut:])
    texts += [["rare"], ["rare", "x", "pair"], ["rare", "pair"] * 300]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, "rare pair")], "item_id long, text string")
    rows = contaminated(docs_of([" ".join(t) for t in texts]), bench).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        want = [i for i, x in enumerate(items) if plain_overlap(t, x)]
        assert [int(x) for x in r["item_ids"].split(",") if x] == want, t
    counts = {r["tokens"]: (r["substitutions"], r["n_items"]) for r in item_classes(bench).collect()}
    assert counts[1] == (0, 3) and counts[2] == (0, 4) and counts[7] == (1, 2) and counts[10] == (2, 2) and counts[None] == (None, 38)


def test_one_block_survives_every_allowed_substitution():
    for n in range(1, 12):
        blocks = short_blocks(n)
        assert sum(length for _, length in blocks) == n and max(length for _, length in blocks) <= 5
        for spoiled in itertools.combinations(range(n), n // 5):
            assert any(not set(range(a, a + length)) & set(spoiled) for a, length in blocks)


def test_equal_rows_are_searched_once(spark):
    """Rows alike in id and text repeat as a whole; their number changes neither the spans held nor the work."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2800))
    other = "zz" + text[100:900] + "yy"
    rows = [(1, text)] * 2000 + [(2, other), (3, "short"), (3, "short"), (None, text[:150]), (None, text[:150]), (None, "q" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = remove_repeats(docs).groupBy("doc_id", "n_bytes", "spans").count().collect()
    found = {(r["doc_id"], r["n_bytes"]): ([tuple(s) for s in r["spans"]] if r["spans"] else [], r["count"]) for r in got}
    assert found == {(1, 2800): ([(0, 2800)], 2000), (2, 804): ([(2, 802)], 1), (3, 5): ([], 2), (None, 150): ([], 2), (None, 10): ([], 1)}


def test_join_by_a_common_anchor_is_split(spark):
    """With plain scans on both sides, run-time skew handling may split the rows of one anchor."""
    import slotwise.llm.repeats as repeats

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    plans, kept = [], repeats.stored

    def watched(df):
        out = kept(df)
        plans.append(df)
        return out

    passage = "the same long passage that all documents share and that goes on and on until it has two hundred bytes or more, which takes a while to say in words that mean as little as these do, but here it ends at last, ok."
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(60)) + passage) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        repeats.stored = watched
        remove_repeats(docs).count()
        joined = [p for p in plans if "anchor" in p.columns and "differ" in p.columns and "uid" in p.columns]
        (again,) = joined
        again = again.select("*")
        again.collect()
        assert "skew=true" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        repeats.stored = kept
        for k in settings:
            spark.conf.unset(k)
