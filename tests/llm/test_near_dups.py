import os
import random

import duckdb
import numpy as np
import pytest
import xxhash

from slotwise.llm.components import connected_components
from slotwise.llm.embedding_dups import bucket_keys, embedding_components
from slotwise.llm.simhash import fingerprint, keep_one_each, simhash_components
from slotwise.session import workspace


def reach(nodes, links):
    """Smallest node reachable, by plain search."""
    around = {n: set() for n in nodes}
    for a, b in links:
        around[a].add(b)
        around[b].add(a)
    root = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo += around[x]
    return root


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for e in links for x in e}
    assert got == reach(nodes, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_leave_one_small_table(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    parts, merged = (f"spark.sql.{x}" for x in ("shuffle.partitions", "adaptive.coalescePartitions.enabled"))
    before = spark.conf.get(parts)
    spark.conf.set(parts, "40")
    spark.conf.set(merged, "false")
    try:
        with workspace(spark) as folder:
            got = connected_components(links)
            assert len(os.listdir(folder.removeprefix("file:"))) == 1 and len(got.inputFiles()) == 1
            assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(51)}
    finally:
        spark.conf.set(parts, before)
        spark.conf.unset(merged)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts_near():
    random.seed(8)
    base = [" ".join(random.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(120)) for _ in range(12)]
    out = list(base)
    for b in base[:6]:
        for _ in range(12):
            words = b.split()
            words[random.randrange(len(words))] = random.choice("xx yy zz".split())
            out.append(" ".join(words))
    return out + base[:4] + [base[0].upper()] + [base[1]] * 30


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_components(spark, parquet_of, edges, block):
    texts = [*edges, *texts_near()]
    rows = simhash_components(parquet_of(texts), block=block).collect()
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    want = reach(prints, links)
    assert len(links) > 200 and len(rows) == len(texts)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_fingerprints_against_spark_hash(spark):
    text = "One two\tthree  FOUR five"
    words = text.lower().split()
    h = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(" ".join(words[i : i + 3]),) for i in range(3)], "s string").selectExpr("xxhash64(s)").collect()]
    assert fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)


def test_keep_one_each(spark, parquet_of, edges):
    texts = texts_near()
    docs = parquet_of(texts)
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    want = set(simhash_components(docs).where("doc_id = component_id").toPandas()["doc_id"])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in keep_one_each(twice).collect()) == [0, 1]
    assert keep_one_each(twice.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int, keys string, root string"


def vectors():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in range(3):
        for center in rng.standard_normal((25, 16)):
            for _ in range(6):
                rows.append((i, (center + 0.13 * rng.standard_normal(16)).tolist(), label))
                i += 1
    copy = rng.standard_normal(16).tolist()
    for _ in range(40):
        rows.append((i, copy, 1))
        i += 1
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0], [2.0], [1e-200] * 16, [3e200] * 16]
    for e in [*odd, [-0.0] + [1.0] * 15, [0.0] + [1.0] * 15]:
        rows.append((i, e, 0))
        i += 1
    return rows + [(i, copy, None), (i + 1, copy, None)]


@pytest.mark.parametrize("block", [2048, 8])
def test_embedding_components(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    good = [(i, np.array(e) / np.abs(e).max(), label) for i, e, label in rows if label is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = []
    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[k + 1 :]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                links.append((i, j))
    root = reach([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_components(df, block=block).collect()}
    assert len(links) > 1000 and got == {i: (n[i], root[i], root[i] == i) for i in n}
    assert embedding_components(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    found = (bucket_keys(a) == bucket_keys(c)).any(axis=1)
    assert found.mean() >= 0.999 and duckdb.__version__
