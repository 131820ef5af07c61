"""Sketches against numpy: inside their bound, also after merges, with defined results at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators import sketches as k

PROBS = {f"q{i}": ("v", p) for i, p in enumerate([0.0, 0.1, 0.5, 0.99, 1.0])}


def table(spark, groups):
    rows = [(g, part, None if v is None else float(v)) for g, part, values in groups for v in values]
    return spark.createDataFrame(rows, "g string, part int, v double").repartition(5)


def inside(values, estimate, p):
    below, up_to = np.mean(values < estimate), np.mean(values <= estimate)
    return below <= p + k.rank_bound() and up_to >= p - k.rank_bound()


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_merged_quantiles_lie_inside_the_bound(spark, kind):
    rng = np.random.default_rng(5)
    draw = {
        "normal": lambda n: rng.normal(0, 9, n),
        "ties": lambda n: rng.integers(0, 4, n).astype(float),
        "heavy": lambda n: np.exp(rng.normal(0, 4, n)),
    }[kind]
    parts = [draw(n) for n in (1, 10, 4000, 9000)]
    fine = k.sketch_table(table(spark, [("a", i, p) for i, p in enumerate(parts)]), ["g", "part"], ["v"])
    row = k.read_sketches(k.merge_sketches(fine, ["g"]), PROBS).first()
    values = np.concatenate(parts)
    assert (row["n"], row["n_v"], row["n_parts"]) == (len(values), len(values), 4)
    for name, (_, p) in PROBS.items():
        assert inside(values, row[name], p), (name, row[name])
    assert row["q0"] == values.min() and row["q4"] == values.max()


def test_distinct_values_after_merging(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("part"), (F.col("id") % 7000).alias("u"))
    fine = k.sketch_table(rows, ["part"], distinct=["u"])
    found = k.read_sketches(k.merge_sketches(fine, []), {}, {"users": "u"}).first()["users"]
    assert abs(found - 7000) <= k.distinct_bound() * 7000


def test_nulls_nan_and_empty_tables(spark):
    df = table(spark, [("a", 0, [None, None]), ("b", 0, [float("nan"), 2.0]), (None, 0, [5.0])])
    fine = k.sketch_table(df, ["g"], ["v"], ["part"])
    out = {r["g"]: (r["n"], r["n_v"], r["q2"], r["parts"]) for r in k.read_sketches(fine, PROBS, {"parts": "part"}).collect()}
    assert out == {"a": (2, 0, None, 1), "b": (2, 1, 2.0, 1), None: (1, 1, 5.0, 1)}
    merged = k.read_sketches(k.merge_sketches(fine.withColumn("all", F.lit(1)), ["all"]), PROBS).first()
    assert (merged["n"], merged["n_v"], merged["n_parts"]) == (5, 2, 3)
    nothing = k.sketch_table(df.limit(0), ["g"], ["v"])
    assert k.merge_sketches(nothing, ["g"]).count() == 0


def test_rolling_windows_count_each_day_once(spark):
    rows = spark.sql("SELECT date_add(DATE'2024-01-01', CAST(id % 5 AS int)) AS day, double(id) AS v FROM range(50)")
    rows = rows.filter("day <> DATE'2024-01-03'")
    rolled = k.rolling_sketches(k.sketch_table(rows, ["day"], ["v"]), "day", 2)
    assert [(str(r["day"])[-2:], r["n"], r["n_parts"]) for r in rolled.orderBy("day").collect()] == [
        ("01", 10, 1), ("02", 20, 2), ("04", 10, 1), ("05", 20, 2),
    ]
