"""Curves and metrics against plain loops; permutation importance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators import evaluate as v
from slotwise.plans.learning import evaluate
from tests.helpers import at, rows_of


def scored(spark, pairs):
    rows = [(i, int(y), float(p)) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id bigint, y int, p double")


def tied(seed=1, n=400, steps=20):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return list(zip(y, np.round((rng.random(n) + 0.4 * y) * steps) / steps, strict=True))


def pairwise_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def plain_curve(pairs):
    """(threshold, tp, fp) from the top."""
    return [
        (t, sum(y for y, p in pairs if p >= t), sum(1 - y for y, p in pairs if p >= t))
        for t in sorted({p for _, p in pairs}, reverse=True)
    ]


def test_areas_equal_plain_loops(spark):
    pairs = tied()
    df = scored(spark, pairs)
    assert np.isclose(v.roc_auc(df, "y", "p").first()[0], pairwise_auc(pairs))
    inverted = df.withColumn("p", -F.col("p"))
    assert np.isclose(v.roc_auc(inverted, "y", "p").first()[0], 1 - pairwise_auc(pairs))
    curve = plain_curve(pairs)
    n_pos = curve[-1][1]
    points = [(0.0, 1.0)] + [(tp / n_pos, tp / (tp + fp)) for _, tp, fp in curve]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert np.isclose(v.pr_auc(df, "y", "p").first()[0], area)


def test_roc_curve_starts_at_the_origin(spark):
    pairs = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)]
    curve = v.roc_curve(scored(spark, pairs), "y", "p").orderBy(F.desc("threshold"))
    assert [tuple(r) for r in curve.collect()] == [
        (1.9, 0, 0, 0.0, 0.0), (0.9, 1, 1, 0.5, 0.5), (0.4, 2, 1, 1.0, 0.5), (0.1, 2, 2, 1.0, 1.0)
    ]


def test_best_threshold_prefers_the_highest_on_a_tie(spark):
    # TPR - FPR is 0.5 at 0.9 and again at 0.7
    pairs = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)]
    assert v.best_threshold(scored(spark, pairs), "y", "p").first()[0] == 0.9
    worse = [(0, 0.9), (1, 0.1)]
    assert tuple(v.best_threshold(scored(spark, worse), "y", "p").first()) == (1.9, 0.0, 0.0)


@pytest.mark.parametrize("y", [0, 1])
def test_one_class_gives_null(spark, y):
    df = scored(spark, [(y, 0.2), (y, 0.7)])
    assert v.roc_auc(df, "y", "p").first()[0] is None
    report = evaluate(df).first()
    assert report.roc_auc is None and report.mcc == 0.0


def test_no_predicted_positives(spark):
    df = scored(spark, [(1, 0.5), (0, 0.2)])  # 0.5 is not above 0.5
    assert v.f1_at(df, "y", "p").first()[0] == 0.0
    pred = df.withColumn("pred", F.lit(0))
    report = v.classification_report(pred, "y", "pred", p="p").first()
    assert (report.precision, report.f1, report.mcc, report.recall) == (0.0, 0.0, 0.0, 0.0)
    assert (report.tp, report.fn, report.tn, report.accuracy, report.roc_auc) == (0, 1, 1, 0.5, 1.0)


def test_groups_are_evaluated_apart(spark):
    a, b = tied(2), tied(3)
    df = scored(spark, a).withColumn("g", F.lit("a")).unionByName(
        scored(spark, b).withColumn("g", F.lit("b"))
    )
    report = {r.g: r for r in evaluate(df, by=["g"]).collect()}
    assert np.isclose(report["a"].roc_auc, pairwise_auc(a))
    assert np.isclose(report["b"].roc_auc, pairwise_auc(b))
    alone = evaluate(scored(spark, b)).first()
    assert np.isclose(report["b"].pr_auc, alone.pr_auc)
    assert report["b"].best_threshold == alone.best_threshold and report["b"].f1 == alone.f1


def test_padding_counts_as_negative_pairs(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2), (2, 1, 0.6)], "id bigint, y int, p double")
    padded = v.flatten_pairs(df, "id", "y", "p", "micro_padded", maxlen=3, pad_score=0.1)
    assert padded.count() == 2 * 3 * 2
    assert padded.filter("class = 1 and y = 1").count() == 2
    assert v.flatten_pairs(df, "id", "y", "p", "micro", maxlen=3).count() == 6
    assert rows_of(v.flatten_pairs(df, "id", "y", "p").select("y", "p")) == [(0, 0.2), (1, 0.6), (1, 0.9)]


def test_importance_ranks_the_used_feature_first(spark):
    rng = np.random.default_rng(9)
    rows = []
    for id in range(30):
        for k in range(rng.integers(3, 9)):
            a, b = rng.random(), rng.random()
            rows.append((id, at(6 * k), float(a), float(b), int(a > 0.5)))
    df = spark.createDataFrame(rows, "id bigint, slot timestamp_ntz, a double, b double, y int")

    def score(t):
        return t.withColumn("p", (F.col("a") > 0.5).cast("double"))

    out = v.permutation_importance(df, "id", "slot", ["a", "b"], "y", score, maxlen=10).collect()
    assert [r.feature for r in out] == ["a", "b"]
    assert out[0].mae > 0.2 and out[1].mae == 0.0


def test_donors_are_one_to_one(spark):
    ids = spark.range(500)
    donors = v.permutation_donors(ids, "id", ["a", "b"], seed=3)
    for feature in ("a", "b"):
        part = donors.filter(F.col("feature") == feature)
        assert part.count() == 500
        assert part.select("donor").distinct().count() == 500
    a, b = (donors.filter(F.col("feature") == f).drop("feature") for f in ("a", "b"))
    assert a.exceptAll(b).count() > 400
