import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.llm.exact_dups import drop_exact_duplicates, exact_groups, maybe_repeated, merge_page, normal_digest, pages_for, repeated_pages, set_positions

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows):
    """(doc_id, text) to the contract's rows, by dictionaries."""
    norm = [((t or "").translate(LOWER)) for _, t in rows]
    groups = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in enumerate(norm):
        same = groups[t]
        keep = max(same, key=lambda j: (rows[j][0] is not None, rows[j][0] or 0, -j))
        out.append((rows[i][0], rows[keep][0], len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts(edges):
    random.seed(12)
    out = [*edges, "É", "é", "ABC", "abc", "aBc ", "İ", "i̇"]
    return out + [f"text {random.randrange(400)}" for _ in range(900)] + ["same"] * 700 + ["SAME"]


@pytest.mark.parametrize(("rows_per_page", "broadcast_bytes"), [(4096, 64 << 20), (16, 0)])
def test_groups_equal_a_plain_search(spark, parquet_of, edges, rows_per_page, broadcast_bytes):
    given = texts(edges)
    got = exact_groups(parquet_of(given), rows_per_page, broadcast_bytes)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain(list(enumerate(given)))


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a"), (5, "a"), (5, "A"), (None, "b"), (None, "b"), (7, None), (8, ""), (9, "c"), (9, "c"), (9, "d")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    assert sorted([tuple(r) for r in exact_groups(docs).collect()], key=repr) == plain(rows)
    left = [tuple(r) for r in drop_exact_duplicates(docs).collect()]
    kept = [r for r, p in zip(rows, [plain_kept(rows, i) for i in range(len(rows))], strict=True) if p]
    assert sorted(left, key=repr) == sorted(kept, key=repr)
    assert exact_groups(docs.limit(0)).count() == 0 and drop_exact_duplicates(docs.limit(0)).count() == 0


def plain_kept(rows, i):
    same = [j for j, r in enumerate(rows) if (r[1] or "").translate(LOWER) == (rows[i][1] or "").translate(LOWER)]
    return i == max(same, key=lambda j: (rows[j][0] is not None, rows[j][0] or 0, -j))


def test_rows_keep_their_columns(parquet_of, edges):
    given = texts(edges)
    docs = parquet_of(given)
    clash = docs.withColumn("digest", F.lit("x")).withColumn("page", F.lit(1)).withColumn("maybe", F.lit("y")).withColumn("bits", F.lit(0))
    left = drop_exact_duplicates(clash)
    assert left.columns == clash.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i in range(len(given)) if plain_kept(list(enumerate(given)), i)}


def test_filter_finds_every_repeated_digest_and_few_others(spark):
    rows = spark.range(40_000).select(F.sha2(F.when(F.col("id") < 4_000, F.col("id") % 1_000).otherwise(F.col("id")).cast("string"), 256).alias("digest"), "id")
    pages = pages_for(40_000)
    marked = maybe_repeated(rows, "digest", "maybe", pages, repeated_pages(rows.repartition(7), pages), 1 << 30)
    assert marked.where("id < 4000 AND NOT maybe").count() == 0
    assert marked.where("id >= 4000 AND maybe").count() < 0.01 * 36_000


def test_portions_merge_to_the_same_page():
    random.seed(3)
    spots = np.array([random.getrandbits(63) for _ in range(50)] * 2 + [random.getrandbits(63) for _ in range(50)], np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(150, np.int64)), pa.array(spots)], names=["page", "spots"])
    whole = merge_page(pa.Table.from_batches(list(set_positions(iter([batch])))))
    cut = [x for part in (batch.slice(0, 60), batch.slice(60)) for x in set_positions(iter([part]))]
    assert whole == merge_page(pa.Table.from_batches(cut)) and whole.num_rows == 1


def test_unique_rows_are_not_shuffled(parquet_of):
    left = drop_exact_duplicates(parquet_of([f"t{i}" for i in range(50)] + ["t1"]))
    plan = left._jdf.queryExecution().executedPlan().toString()
    union = plan[plan.index("Union") :]
    straight = union[: union.index("Join")] if "Join" in union else union
    assert "Exchange" not in straight.split("Project")[1]


def test_digest_changes_ascii_letters_only(spark):
    row = spark.createDataFrame([("ÀÉZz",)], "text string").select(normal_digest("text")).first()
    assert row[0] == hashlib.sha256("ÀÉzz".encode()).hexdigest()
