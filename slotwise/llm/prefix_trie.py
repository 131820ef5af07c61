"""Prefix tries of conversations, packed as double arrays.

A conversation is the sequence of its turns, and a node of the trie is a distinct sequence of first turns.  Equal
conversations are counted together first.  The others are dealt out by their first turns: a prefix shard holds all
conversations that start alike, and a prefix with too many turns behind it is cut again after twice as many turns.
Each bucket of shards numbers its turns densely, packs BASE and CHECK, and traverses them for its nodes.  Nodes at or
below the cut belong to one shard and are final; the nodes above it are shared, and their parts from all buckets
are merged.  Only digests of turns are moved, no texts.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import stored, streamed_sha256, text_of

#: Turns in a bucket of prefix shards, and the most that conversations of one shard have unless they are one.
SHARD_TURNS = 4096
#: Members whose ids are joined into one part are those that agree but for this many low bits.
PART_BITS = 12

NODE_SCHEMA = (
    "shared boolean, key string, parent string, parent_id long, path array<string>, depth long, words long, "
    "conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, seq string"
)


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words) of (conv_id, turn, role, text): the place from 1 on, a digest of role and text, words of the text.

    Null turns come first; rows of equal turn are ordered by role and digest, and repeated rows are turns of their own.
    Null role or text is empty; rows without a conv_id belong to no conversation and are left out.
    """
    role, text = text_of("role"), text_of("text")
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "key")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "key", "words")


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, seq) from (conv_id, pos, key, words); rows with a null ``pos`` only name their conversation."""
    step = F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "words"))
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    turns = F.transform("steps", lambda s: F.struct(s["key"].alias("key"), s["words"].alias("words")))
    made = made.select("conv_id", turns.alias("turns"))
    return made.withColumn("seq", _digest(F.col("turns")))


def _digest(turns: Column) -> Column:
    return F.md5(F.array_join(F.transform(turns, lambda t: t["key"]), ""))


def share_heads(rows: DataFrame, every: int = 20, lengths: int = 4) -> DataFrame:
    """Turns of conversations that take their first turns from another: (conv_id, pos, key, words), one null row for each without turns.

    Conversation ``c`` starts with the first ``h`` turns of ``c - c % every``, as far as there are any, and goes on with its
    own turns after its first ``h``; ``h`` is the crc32 of ``c`` in decimal, modulo ``lengths``.
    """
    rows = stored(rows)
    size = rows.groupBy("conv_id").agg(F.max("pos").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % lengths
    size = stored(size.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), head.alias("h"), "n"))
    lenders = size.where("conv_id = base").select("base", F.col("n").alias("lent"))
    plan = stored(size.join(lenders, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("taken")))
    heads = rows.where((F.col("conv_id") % every == 0) & (F.col("pos") < lengths)).withColumnRenamed("conv_id", "base")
    taken = plan.join(heads, "base").where("pos <= h").select("conv_id", "pos", "key", "words")
    own = rows.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "words")
    none = F.lit(None)
    return taken.union(own).union(size.select("conv_id", none.cast("long"), none.cast("string"), none.cast("long")))


def pack(paths: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of the trie of ``paths``, sorted lists of ids from 1 on; the root is state 0.

    The child of state s by id a is t = BASE[s] + a, if CHECK[t] = s.  Free places have CHECK -1.
    """
    base, check, free = [0], [0], 1
    todo = deque([(0, 0, len(paths), 0)])
    while todo:
        state, lo, hi, depth = todo.popleft()
        while lo < hi and len(paths[lo]) == depth:
            lo += 1
        labels, starts = [], []
        for i in range(lo, hi):
            if not labels or labels[-1] != paths[i][depth]:
                labels.append(paths[i][depth])
                starts.append(i)
        if not labels:
            continue
        while free < len(check) and check[free] >= 0:
            free += 1
        at = free
        while any(at + a - labels[0] < len(check) and check[at + a - labels[0]] >= 0 for a in labels):
            at += 1
        base[state] = at - labels[0]
        longer = base[state] + labels[-1] + 1 - len(check)
        if longer > 0:
            base += [0] * longer
            check += [-1] * longer
        for a, i, j in zip(labels, starts, [*starts[1:], hi], strict=True):
            check[base[state] + a] = state
            todo.append((base[state] + a, i, j, depth + 1))
    return np.array(base, np.int64), np.array(check, np.int64)


def traverse(check: np.ndarray) -> Iterator[tuple[int, int]]:
    """(state, parent) of all states but the root, parents first."""
    order = np.argsort(check, kind="stable")
    begin = np.searchsorted(check[order], np.arange(len(check) + 1))
    todo = deque([0])
    while todo:
        state = todo.popleft()
        for t in order[begin[state] : begin[state + 1]].tolist():
            if t:
                yield t, state
                todo.append(t)


def bucket_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one bucket's trie; rows are distinct conversations (seq, least, n, turns, cut)."""
    rows = table.select(["seq", "least", "n", "turns", "cut"]).to_pylist()
    known = sorted({t["key"] for r in rows for t in r["turns"]})
    number = {key: i + 1 for i, key in enumerate(known)}
    words = {t["key"]: t["words"] for r in rows for t in r["turns"]}
    paths = [[number[t["key"]] for t in r["turns"]] for r in rows]
    order = sorted(range(len(rows)), key=paths.__getitem__)
    base, check = pack([paths[i] for i in order])
    size = len(check)
    members, least, shared, ends = [0] * size, [None] * size, [False] * size, [None] * size
    bases, checks = base.tolist(), check.tolist()
    for i in order:
        row, state, depth = rows[i], 0, 0
        for a in [0, *paths[i]]:
            if a:
                below = bases[state] + a
                assert checks[below] == state
                state, depth = below, depth + 1
            members[state] += row["n"]
            least[state] = row["least"] if least[state] is None else min(least[state], row["least"])
            shared[state] |= depth < row["cut"]
        ends[state] = row["seq"]
    found = [(0, None), *traverse(check)]
    depth, key = {0: 0}, {0: ""}
    kids, leaves, saved, own = [0] * size, [0] * size, [0] * size, [0] * size
    for state, parent in found[1:]:
        turn = known[state - bases[parent] - 1]
        depth[state], own[state] = depth[parent] + 1, words[turn]
        if shared[parent]:  # others are not joined by key
            key[state] = hashlib.md5((key[parent] + turn).encode()).hexdigest()
    for state, parent in reversed(found):
        if not shared[state]:
            leaves[state] += not kids[state]
            saved[state] += (members[state] - 1) * own[state]
        if parent is not None:
            kids[parent] += not shared[state]
            leaves[parent] += leaves[state]
            saved[parent] += saved[state]
    out, path = [], {0: []}
    for state, parent in found:
        if shared[state] and parent is not None:
            path[state] = [*path[parent], key[parent]]
        held = parent is not None and not shared[parent]
        out.append((shared[state], key.get(state) if shared[state] else None, key[parent] if parent is not None and not held else None, least[parent] if held else None,
                    path[state] if shared[state] else None, depth[state], own[state], least[state], members[state], kids[state], leaves[state], saved[state], ends[state]))
    kinds = [pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), *[pa.int64()] * 7, pa.string()]
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def in_shards(classes: DataFrame, shard_turns: int) -> DataFrame:
    """``classes`` with ``prefix`` and ``cut``: conversations of one prefix agree in their first ``cut`` turns, and no others do."""
    placed, pending, cut = [], classes, 1
    while True:
        headed = pending.withColumn("prefix", _digest(F.slice("turns", 1, cut))).withColumn("cut", F.lit(cut))
        size = headed.groupBy("prefix").agg(F.sum(F.size("turns")).alias("turns"), F.count("*").alias("n"))
        large = stored(size.where((F.col("turns") > shard_turns) & (F.col("n") > 1)).select("prefix"))
        if large.isEmpty():
            placed.append(headed)
            break
        placed.append(headed.join(large, "prefix", "left_anti").select(headed.columns))
        pending, cut = stored(headed.join(large, "prefix", "left_semi").select(classes.columns)), 2 * cut
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    return out


def member_digests(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256) of (seq, conv_id): SHA-256 of the ids in decimal, ascending, comma-joined."""
    parts = members.groupBy("seq", F.shiftright("conv_id", PART_BITS).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = parts.select("seq", "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return streamed_sha256(joined, "seq", "part", "ids", "ends_sha256")


def trie_nodes(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of conversations, from turns (conv_id, pos, key, words).

    conv_id: smallest member; depth; parent_conv_id: that of the parent (null at the root); n_convs: members; n_children;
    n_leaves: nodes without children in the subtree; saved_tokens: words of last texts times members less one, over the
    subtree; ends_sha256: members that end here.  A row with a null ``pos`` names a conversation, which may have no turns and
    then ends at the root.  No conversations give no nodes.  The turn ids of one conversation are one value.
    """
    made = stored(sequences(rows))
    grouped = made.groupBy("seq").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.first("turns").alias("turns"))
    classes = stored(grouped)
    turns = classes.agg(F.sum(F.size("turns"))).first()[0] or 0
    buckets = max(1, -(-turns // shard_turns))
    placed = in_shards(classes, shard_turns).withColumn("bucket", F.pmod(F.xxhash64("prefix"), F.lit(buckets)))
    found = stored(placed.select("bucket", "seq", "least", "n", "turns", "cut").groupBy("bucket").applyInArrow(bucket_nodes, NODE_SCHEMA))
    upper = stored(_merged(found.where("shared")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq"]
    names = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    inner = found.where("NOT shared AND parent IS NULL").withColumn("parent_conv_id", F.col("parent_id"))
    border = found.where("NOT shared AND parent IS NOT NULL").join(names, "parent").withColumn("parent_conv_id", F.col("above"))
    top = upper.join(names, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    nodes = inner.select(columns).union(border.select(columns)).union(top.select(columns))
    none = hashlib.sha256(b"").hexdigest()
    nodes = nodes.join(member_digests(made.select("seq", "conv_id")), "seq", "left")
    return nodes.select(*columns[:-1], F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _merged(parts: DataFrame) -> DataFrame:
    """Shared nodes, from their parts in all buckets: sums over what lies below the cuts, then over shared nodes below."""
    same: Callable[[str], Column] = lambda c: F.first(c).alias(c)
    total: Callable[[str], Column] = lambda c: F.sum(c).alias(c)
    nodes = parts.groupBy("key").agg(
        *map(same, ("parent", "path", "depth", "words")), F.min("conv_id").alias("conv_id"), *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("seq").alias("seq")
    )
    nodes = stored(nodes)
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    nodes = stored(nodes.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    leaf, own = (F.col("n_children") == 0).cast("long"), F.col("words") * (F.col("n_convs") - 1)
    up = nodes.select(F.explode(F.array_append("path", F.col("key"))).alias("key"), leaf.alias("leaf"), own.alias("own"))
    up = up.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    joined = nodes.join(up, "key")
    return joined.withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("own")).drop("leaf", "own")
