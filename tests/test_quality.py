"""Lengths, coverage, completeness, profiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators import cleaning as c
from slotwise.operators import encode as n
from slotwise.operators import quality as q
from tests.helpers import at, rows_of


def stays(spark, days):
    rows = [(i, t) for i, d in enumerate(days) for t in (at(), at(24 * d))]
    return spark.createDataFrame(rows, "id bigint, time timestamp_ntz")


def test_length_bounds_are_open_below_and_closed_above(spark):
    days = [1.0, 2.0, 2.5, 3.0, 10.0]
    rows = stays(spark, days)
    # the median is 2.5 exactly
    kept = q.los_filter(rows, "id", "time", low=2.0, pct=0.5)
    assert sorted({r.id for r in kept.collect()}) == [2]
    counts = q.los_counts(q.length_of_stay(rows, "id", "time"), 2.0, 0.5).first()
    assert (counts.bound, counts.n_inside, counts.n_outside) == (2.5, 1, 4)


def test_histogram_puts_the_tail_in_the_last_bin(spark):
    los = q.length_of_stay(stays(spark, [0.5, 1.0, 1.9, 3.0, 50.0]), "id", "time")
    assert rows_of(q.histogram(los, "los", 1.0, 3)) == [(0, 1, 20.0), (1, 2, 40.0), (2, 2, 40.0)]


def test_coverage_of_exactly_the_threshold_is_kept(spark):
    rows = spark.createDataFrame(
        [(i, 1.0 if i < 4 else None, 1.0 if i < 3 else None) for i in range(5)],
        "id bigint, a double, b double",
    )
    coverage = {r.feature: r.coverage for r in q.feature_coverage(rows, "id", ["a", "b"]).collect()}
    assert coverage == {"a": 0.8, "b": 0.6}
    kept, names = q.keep_covered(rows, "id", ["a", "b"], 0.8)
    assert names == ["a"] and kept.columns == ["id", "a"]
    complete = q.keep_complete(rows, "id", ["a", "b"], 1.0)
    assert sorted(r.id for r in complete.collect()) == [0, 1, 2]


def test_profile_and_counts(spark):
    values = [1.0, -2.0, 3.5, None, 10.0]
    rows = spark.createDataFrame([(v, "x") for v in values], "a double, s string")
    row = q.profile(rows).first()
    real = [v for v in values if v is not None]
    assert (row.feature, row.n_rows, row.n_null) == ("a", 5, 1)
    assert np.isclose(row["std"], np.std(real, ddof=1)) and row.q50 == np.median(real)
    assert c.count_negative(rows, ["a"]).first().a == 1
    assert q.n_unique(rows, ["a", "s"]).first() == (4, 1)
    assert q.max_group_size(rows, "s").first().max_size == 5


def test_reports_merge_on_both_sides(spark):
    before = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "feature string, origin double")
    after = spark.createDataFrame([("a", 1.0), ("c", 0.9)], "feature string, after double")
    assert rows_of(q.compare_reports(before, after, "feature")) == [
        ("a", 1.0, 1.0), ("b", 0.5, None), ("c", None, 0.9)
    ]


def test_positive_ratio_by_group(spark):
    rows = spark.createDataFrame(
        [(1, 0, "a"), (1, 2, "a"), (2, 0, "a"), (3, 1, "b")], "id bigint, y int, g string"
    )
    assert rows_of(q.positive_ratio(rows, "id", "y")) == [(3, 2, 2 / 3)]
    assert rows_of(q.positive_ratio(rows, "id", "y", by="g")) == [("a", 2, 1, 0.5), ("b", 1, 1, 1.0)]


def test_one_hot_null_is_all_zeros(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "y z")], "id bigint, c string")
    out = n.one_hot(rows)
    assert out.columns == ["id", "c_x", "c_y z"]
    assert rows_of(out, "id") == [(1, 1, 0), (2, 0, 0), (3, 0, 1)]


def test_one_hot_does_not_depend_on_the_columns_listed(spark):
    rows = spark.range(1500).select("id", F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    assert len(n.find_categories(rows, ["a"])["a"]) == 1500
    assert n.find_categories(rows, ["a"])["a"] == n.find_categories(rows, ["a", "b"])["a"]
    long = n.one_hot_rows(rows, "id", ["a", "b"])
    assert long.count() == 3000 and long.filter("feature = 'a_7'").first()["id"] == 7


def test_top_values_are_exact_whatever_the_summary_holds(spark):
    import random
    from collections import Counter

    from slotwise.operators.quality import frequent_values, top_values

    random.seed(4)
    rows = [(str(int(random.paretovariate(0.6))), i, "a" if i % 3 else None, None) for i in range(6000)]
    df = spark.createDataFrame(rows, "heavy string, unique long, few string, none string").repartition(5)
    for capacity in (4, 64, 4096):
        got = [tuple(r) for r in top_values(df, ["heavy", "few", "none"], 6, capacity).orderBy("feature", "rank").collect()]
        heavy = sorted(Counter(r[0] for r in rows).items(), key=lambda x: (-x[1], x[0]))[:6]
        assert got == [("few", 1, "a", 4000)] + [("heavy", i + 1, v, n) for i, (v, n) in enumerate(heavy)]
        summary = {(r["feature"], r["value"]): r["least"] for r in frequent_values(df, ["heavy"], capacity).collect()}
        error = summary.pop(("heavy", None))
        for v, n in Counter(r[0] for r in rows).items():
            assert summary.get(("heavy", v), 0) <= n <= summary.get(("heavy", v), 0) + error
    unique = top_values(df, ["unique"], 2, 1 << 16).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in unique] == [("0", 1), ("1", 1)]
