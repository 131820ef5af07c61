"""Distributed ranks, running sums and quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.functions import ranking as r

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]


def quantiles(spark, values, **kwargs):
    df = spark.createDataFrame([(float(v),) for v in values], "a double").repartition(7)
    row = r.exact_quantiles(df, ["a"], PROBS, **kwargs).first()
    return [row[f"q{i}"] for i in range(len(PROBS))]


@pytest.mark.parametrize(
    "name, values",
    [
        ("one", [4.0]),
        ("two", [1.0, 2.0]),
        ("uniform", list(np.random.default_rng(1).random(5000))),
        ("heavy tie", [3.0] * 4000 + list(np.random.default_rng(2).normal(3, 1, 2000))),
        ("outlier", [1e12, *np.random.default_rng(3).exponential(1.0, 3000)]),
        ("all equal", [7.0] * 1000),
        ("negative", list(-np.arange(1001.0))),
    ],
)
def test_quantiles_equal_numpy(spark, name, values):
    assert np.allclose(quantiles(spark, values), np.quantile(values, PROBS), rtol=1e-12)


def test_quantiles_with_rough_sketches(spark, monkeypatch):
    """Wrong brackets are widened."""
    values = list(np.random.default_rng(4).normal(0, 5, 4000))
    narrow = r._bracket

    def shifted(v, targets, margin, accuracy):
        narrow(v, targets, margin, accuracy)
        if margin < 0.1:
            for t in targets:
                t.low, t.high = 1e6, 2e6

    monkeypatch.setattr(r, "_bracket", shifted)
    assert np.allclose(quantiles(spark, values), np.quantile(values, PROBS), rtol=1e-12)


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "a double, b double"
    )
    out = {row.feature: row.q0 for row in r.exact_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert out == {"a": 2.0, "b": None}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_per_group(spark, descending):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("n")
    )
    out = r.cumulative(df, "k", ["n"], by=["g"], descending=descending).toPandas()
    out = out.sort_values("k", ascending=not descending)
    assert (out.groupby("g").n.cumsum() == out.cum_n).all() and len(out) == 1000


def test_shuffled_rank_is_a_permutation(spark):
    df = spark.range(5000)
    first = r.shuffled_rank(df, ["id"], seed=1, buckets=16).toPandas().sort_values("id")
    again = r.shuffled_rank(df.repartition(13), ["id"], seed=1, buckets=16).toPandas()
    other = r.shuffled_rank(df, ["id"], seed=2, buckets=16).toPandas().sort_values("id")
    assert sorted(first["rank"]) == list(range(5000))
    assert (first["rank"].values == again.sort_values("id")["rank"].values).all()
    assert (first["rank"].values != other["rank"].values).mean() > 0.9
