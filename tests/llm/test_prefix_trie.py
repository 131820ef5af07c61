import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from slotwise.llm.common import streamed_sha256
from slotwise.llm.prefix_trie import in_shards, pack, sequences, share_heads, traverse, trie_nodes, turn_rows

SCHEMA = "conv_id long, turn long, role string, text string, pos long, key string, seq string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain_nodes(rows):
    """The contract's nodes by dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        return [p] + [x for k in kids.get(p, []) for x in below(k)]

    def words(p):
        return len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        under = below(p)
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(not kids.get(u) for u in under),
            sum((len(members[u]) - 1) * words(u) for u in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations():
    random.seed(13)
    rows = []
    for c in [*range(0, 130), -7, -20, 1 << 40]:
        if c % 20 == 0 and c % 40:
            continue  # no lender
        kind = random.randrange(3)
        for t in range(random.choice([1, 1, 2, 3, 5, 9])):
            role = random.choice(["user", "assistant", None, ""])
            text = f"w{random.randrange(2)} \t\x0b é x" if kind else "same text here"
            rows.append((c, t, role if kind else "user", random.choice([text, None]) if kind else text))
    rows += [(3, None, "system", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", f"hot {t}") for c in range(1000, 1300) for t in range(3)]
    return rows + [(2000, t, "user", f"long {t % 7}" + " many words" * 2000 * (t == 5)) for t in range(200)]


@pytest.mark.parametrize("shard_turns", [3, 40, 4096])
def test_nodes_equal_a_plain_trie(spark, shard_turns):
    rows = conversations()
    df = spark.createDataFrame([(*r, 9, "k", "s") for r in rows], SCHEMA).repartition(5)
    got = trie_nodes(share_heads(turn_rows(df)), shard_turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_nodes(rows)


def test_no_conversations_and_turnless_ones(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie_nodes(share_heads(turn_rows(empty))).count() == 0
    named = spark.createDataFrame([(5, None, None, None), (4, None, None, None)], "conv_id long, pos long, key string, words long")
    assert [tuple(r) for r in trie_nodes(named).collect()] == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,5").hexdigest())]


def test_packed_arrays_hold_exactly_the_paths():
    random.seed(5)
    paths = sorted({tuple(random.randrange(1, 60) for _ in range(random.randrange(0, 6))) for _ in range(400)})
    base, check = pack([list(p) for p in paths])
    nodes = {p[:d] for p in paths for d in range(len(p) + 1)}
    name = {0: ()}
    for state, parent in traverse(check):
        name[state] = (*name[parent], state - int(base[parent]))
    assert sorted(name.values()) == sorted(nodes) and len(name) == len(nodes)
    assert [s for s, _ in traverse(pack([[]])[1])] == []


def test_hot_prefixes_are_cut_again(spark):
    rows = [(c, p, f"k{p}" if p < 5 else f"k{p}-{c}", 1) for c in range(60) for p in range(1, 8)]
    made = sequences(spark.createDataFrame(rows, "conv_id long, pos long, key string, words long"))
    classes = made.select("seq", F.col("conv_id").alias("least"), F.lit(1).alias("n"), "turns")
    placed = in_shards(classes, 50)
    assert placed.count() == 60
    assert placed.groupBy("prefix").agg(F.sum(F.size("turns")).alias("n")).agg(F.max("n")).first()[0] <= 50
    assert {r["cut"] for r in placed.collect()} == {8}


def test_digests_stream_in_order(spark):
    rows = [(f"k{i % 7}", i, str(i)) for i in range(500)]
    got = streamed_sha256(spark.createDataFrame(rows, "k string, o long, p string").repartition(9), "k", "o", "p", "sha").collect()
    assert {r["k"]: r["sha"] for r in got} == {f"k{j}": hashlib.sha256(",".join(str(i) for i in range(500) if i % 7 == j).encode()).hexdigest() for j in range(7)}
