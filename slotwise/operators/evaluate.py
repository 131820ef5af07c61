"""Curves, areas, confusion metrics and permutation importance as distributed queries.

Scores are first counted per distinct value; running counts over the distinct scores come from
``functions.ranking.cumulative``, so no step sorts all rows in one task.  Curves that have a
single class give null, not an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.ranking import cumulative, shuffled_rank
from slotwise.operators.encode import last_steps
from slotwise.session import stored


def _score_counts(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, their running counts from the top, and the
    class totals."""
    scored = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    counts = scored.groupBy(*by, F.col(p).cast("double").alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    running = cumulative(counts, "threshold", ["pos", "neg"], by, descending=True)
    return running.select(
        *by,
        "threshold",
        "pos",
        "neg",
        F.col("cum_pos").alias("tps"),
        F.col("cum_neg").alias("fps"),
        F.col("total_pos").cast("double").alias("n_pos"),
        F.col("total_neg").cast("double").alias("n_neg"),
    )


def _rate(count: str, total: str, name: str) -> Column:
    return F.try_divide(F.col(count).cast("double"), F.col(total)).alias(name)


def roc_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, and the start (0, 0) at a threshold above all scores."""
    counts = _score_counts(df, y, p, by)
    zero = F.lit(0).cast("bigint")
    start = (
        counts.groupBy(*by)
        .agg(*[F.max(c).alias(c) for c in ("threshold", "n_pos", "n_neg")])
        .filter(F.col("threshold").isNotNull())
        .withColumns({"threshold": F.col("threshold") + 1.0, "tps": zero, "fps": zero})
    )
    columns = ["threshold", "tps", "fps", "n_pos", "n_neg"]
    points = start.select(*by, *columns).unionByName(counts.select(*by, *columns))
    return points.select(
        *by, "threshold", "tps", "fps", _rate("tps", "n_pos", "tpr"), _rate("fps", "n_neg", "fpr")
    )


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids; tied scores share a step."""
    return curve_metrics(df, y, p, by).select(*by, "roc_auc")


def pr_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per distinct score, and the anchor (recall 0, precision 1)."""
    counts = _score_counts(df, y, p, by)
    tp, fp = F.col("tps").cast("double"), F.col("fps").cast("double")
    points = counts.select(
        *by, "threshold", (tp / (tp + fp)).alias("precision"), _rate("tps", "n_pos", "recall")
    )
    anchor = counts.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return anchor.unionByName(points)


def pr_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the precision-recall curve (not the average precision)."""
    return curve_metrics(df, y, p, by).select(*by, "pr_auc")


def best_threshold(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """The threshold with the largest TPR - FPR; the highest one when several tie."""
    return curve_metrics(df, y, p, by).select(*by, "threshold", "tpr", "fpr")


def curve_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Both areas and the best threshold from one pass over the distinct scores.

    The point before a score follows from the running counts less the score's own, so no look at
    the neighbouring row is needed.  Distances are compared as ``tps * N - fps * P`` in exact
    arithmetic, so rounding cannot break a tie; a curve that never rises above the diagonal has
    its best point at the start, where nothing is predicted positive.
    """
    counts = _score_counts(df, y, p, by)
    tp, fp = F.col("tps").cast("double"), F.col("fps").cast("double")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")

    roc_area = F.col("neg") * (tp0 + F.col("pos") / F.lit(2.0))
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, tp0 + fp0))
    width = F.try_divide(F.col("pos").cast("double"), n_pos)
    pr_area = width * (tp / (tp + fp) + before) / F.lit(2.0)

    whole = "decimal(19,0)"
    distance = F.col("tps").cast(whole) * n_neg.cast(whole) - F.col("fps").cast(
        whole
    ) * n_pos.cast(whole)
    point = F.struct(
        distance.alias("d"),
        F.col("threshold"),
        F.try_divide(tp, n_pos).alias("tpr"),
        F.try_divide(fp, n_neg).alias("fpr"),
    )
    sums = counts.groupBy(*by).agg(
        F.sum(roc_area).alias("_roc"),
        F.sum(pr_area).alias("pr_auc"),
        F.max(point).alias("_best"),
        *[F.max(c).alias(c) for c in ("n_pos", "n_neg", "threshold")],
    )
    above = F.col("_best.d") > 0
    return sums.select(
        *by,
        F.try_divide(F.col("_roc"), n_pos * n_neg).alias("roc_auc"),
        "pr_auc",
        F.when(above, F.col("_best.threshold")).otherwise(F.col("threshold") + 1.0).alias("threshold"),
        F.when(above, F.col("_best.tpr")).when(n_pos > 0, F.lit(0.0)).alias("tpr"),
        F.when(above, F.col("_best.fpr")).when(n_neg > 0, F.lit(0.0)).alias("fpr"),
    )


def _confusion(y: str, predicted: Column) -> list[Column]:
    positive = F.col(y) == 1
    return [
        F.count_if(positive & predicted).alias("tp"),
        F.count_if(~positive & predicted).alias("fp"),
        F.count_if(positive & ~predicted).alias("fn"),
        F.count_if(~positive & ~predicted).alias("tn"),
    ]


def _or_zero(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num, den))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _or_zero(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)


def f1_at(
    df: DataFrame, y: str, p: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """F1 of the prediction ``p > threshold`` (strict)."""
    counts = df.groupBy(*by).agg(*_confusion(y, F.col(p) > F.lit(threshold)))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.select(*by, _f1(tp, fp, fn).alias("f1"))


def classification_report(
    df: DataFrame, y: str, pred: str, by: Sequence[str] = (), p: str | None = None
) -> DataFrame:
    """Confusion counts and the rates made from them, in one pass.

    Precision, recall, F1 and the correlation are 0 where their denominator is 0.  With a score
    column ``p`` the ROC area is added.
    """
    counts = df.groupBy(*by).agg(*_confusion(y, F.col(pred) == 1))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    mcc = _or_zero(
        tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    )
    report = counts.select(
        *by,
        "tp", "fp", "fn", "tn",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _or_zero(tp, tp + fn).alias("recall"),
        mcc.alias("mcc"),
        _or_zero(tp, tp + fp).alias("precision"),
        _f1(tp, fp, fn).alias("f1"),
        F.try_divide(fp, fp + tn).alias("fpr"),
    )
    if p is None:
        return report
    area = roc_auc(df, y, p, by)
    return report.join(area, list(by)) if by else report.withColumn("roc_auc", area.scalar())


def mean_absolute_error(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(p) - F.col(y).cast("double"))).alias("mae"))


def flatten_pairs(
    df: DataFrame,
    id: str,
    y: str,
    p: str,
    mode: str = "positive_class",
    p0: str | None = None,
    maxlen: int | None = None,
    pad_score: float = 0.5,
) -> DataFrame:
    """The evaluation population as rows ``id, class, y, p``.

    ``positive_class`` is one row per step.  ``micro`` adds the negative class of each step
    (truth ``1 - y``, score ``p0`` or ``1 - p``).  ``micro_padded`` also counts the padding of
    every id up to ``maxlen`` steps as negative, with the score the model gives to padding; this
    is the population of a padded tensor, and it flatters the model.
    """
    other = F.col(p0) if p0 else F.lit(1.0) - F.col(p)

    def pairs(truth: Column, score: Column, against: Column) -> Column:
        return F.array(
            F.struct(F.lit(0).alias("class"), (F.lit(1) - truth).alias("y"), against.alias("p")),
            F.struct(F.lit(1).alias("class"), truth.alias("y"), score.alias("p")),
        )

    truth = F.col(y).cast("int")
    if mode == "positive_class":
        return df.select(id, F.lit(1).alias("class"), truth.alias("y"), F.col(p).alias("p"))
    real = df.select(id, F.inline(pairs(truth, F.col(p), other)))
    if mode == "micro":
        return real
    if mode != "micro_padded" or maxlen is None:
        raise ValueError("mode is positive_class, micro, or micro_padded with maxlen")
    missing = df.groupBy(id).agg((F.lit(maxlen) - F.count("*")).cast("int").alias("_missing"))
    steps = missing.filter(F.col("_missing") > 0).select(
        id, F.explode(F.sequence(F.lit(1), F.col("_missing")))
    )
    score = F.lit(float(pad_score))
    padding = steps.select(id, F.inline(pairs(F.lit(0), score, F.lit(1.0) - score)))
    return real.unionByName(padding)


def permutation_donors(
    ids: DataFrame, id: str, feats: Sequence[str], seed: int, fn: str = "xxhash64"
) -> DataFrame:
    """For each feature a random one-to-one map from ids to donor ids: ``feature, id, donor``."""
    base = shuffled_rank(ids, [id], seed, rank="_place", fn=fn)
    listed = F.array(*[F.lit(c) for c in feats])
    per_feature = ids.select(id, F.explode(listed).alias("feature"))
    drawn = shuffled_rank(per_feature, [id], seed + 1, by=["feature"], rank="_place", fn=fn)
    donors = base.select(F.col(id).alias("donor"), "_place")
    return drawn.join(donors, "_place").select("feature", id, "donor")


def permutation_importance(
    df: DataFrame,
    id: str,
    time: str,
    feats: Sequence[str],
    y: str,
    score_fn: Callable[[DataFrame], DataFrame],
    maxlen: int,
    seed: int = 8888,
    pad_value: float = 0.0,
    score: str = "p",
    fn: str = "xxhash64",
) -> DataFrame:
    """Mean absolute error per feature when that feature is permuted across ids.

    Whole sequences change hands: step k of a row takes the donor's value at step k, counted
    from the end as in padded sequences; where the donor is padding it takes ``pad_value``.
    ``score_fn`` adds the column ``score`` to a table with the feature columns.

    Donated values travel alone, one narrow row per (feature, step); a row meets all of them at
    once and is only then repeated per feature, inside its task.  All features are evaluated in
    one job and names travel with the values.
    """
    rows = stored(last_steps(df, id, time, maxlen).select(id, "step", y, *feats))
    donors = permutation_donors(rows.select(id).distinct(), id, feats, seed, fn)
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("_value")) for c in feats]
    given = rows.select(F.col(id).alias("donor"), "step", F.inline(F.array(*pairs)))
    swapped = (
        given.join(donors, ["donor", "feature"])
        .groupBy(id, "step")
        .agg(
            *[
                F.max(F.when(F.col("feature") == c, F.col("_value"))).alias(f"_new{i}")
                for i, c in enumerate(feats)
            ]
        )
    )
    both = rows.join(swapped, [id, "step"], "left")
    listed = F.array(*[F.lit(c) for c in feats])
    variants = both.withColumn("feature", F.explode(listed)).select(
        id,
        "step",
        y,
        "feature",
        *[
            F.when(F.col("feature") == c, F.coalesce(F.col(f"_new{i}"), F.lit(pad_value)))
            .otherwise(F.col(c))
            .alias(c)
            for i, c in enumerate(feats)
        ],
    )
    errors = mean_absolute_error(score_fn(variants), y, score, by=["feature"])
    return errors.orderBy(F.desc("mae"), "feature")
