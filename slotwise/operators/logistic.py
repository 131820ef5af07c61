"""Logistic regression by Newton steps, each one aggregation over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.columns import named, sigmoid


class LogisticModel(NamedTuple):
    """``weights`` has the intercept first; ``gradient`` is the largest component left, per row."""

    features: list[str]
    weights: list[float]
    gradient: float
    steps: int


class Sums(NamedTuple):
    rows: float
    loss: float
    gradient: np.ndarray
    gram: np.ndarray


def newton_sums(
    df: DataFrame, feats: Sequence[str], label: str, weights: np.ndarray, l2: float
) -> Sums:
    """Loss, gradient and Gram matrix of the rows at ``weights``, from one pass.

    Every task sends one vector of sums, whatever it read, so what is shuffled depends on the
    number of columns only.  A null feature or label is an error.
    """
    d = len(feats) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + d + d * d)
        for b in batches:
            values = b.column(0).flatten()
            if values.null_count or b.column(1).null_count:
                raise ValueError("features and labels must not be null")
            x = np.column_stack([np.ones(b.num_rows), values.to_numpy().reshape(b.num_rows, d - 1)])
            y = b.column(1).to_numpy()
            z = x @ weights
            p = 1 / (1 + np.exp(-z))
            loss = np.logaddexp(0, z) - y * z
            total[:2] += b.num_rows, loss.sum()
            total[2 : 2 + d] += x.T @ (p - y)
            total[2 + d :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"]
        )

    rows = df.select(
        F.array(*[named(c).cast("double") for c in feats]).alias("x"), F.col(label).cast("double")
    )
    sums = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 + d + d * d)
    for row in sums:
        total[row["i"]] = row["v"]
    ridge = np.full(d, float(l2))
    ridge[0] = 0
    return Sums(
        total[0],
        total[1] + (ridge * weights**2).sum() / 2,
        total[2 : 2 + d] + ridge * weights,
        total[2 + d :].reshape(d, d) + np.diag(ridge),
    )


def fit_logistic(
    df: DataFrame,
    feats: Sequence[str],
    label: str,
    l2: float = 1.0,
    max_iter: int = 50,
    tolerance: float = 1e-12,
) -> LogisticModel:
    """The weights that minimise the logistic loss plus ``l2 / 2`` times the squared weights.

    The intercept is not penalised.  Newton steps are halved until the loss does not grow; the fit
    ends when no gradient component exceeds ``tolerance`` per row, or after ``max_iter`` steps.
    ``df`` is read once per step, so store it first when it is costly.  Without rows all weights
    are 0; with ``l2=0`` separable classes never reach the tolerance.
    """
    feats = list(feats)
    weights = np.zeros(len(feats) + 1)
    now = newton_sums(df, feats, label, weights, l2)
    steps = 0
    while steps < max_iter and np.abs(now.gradient).max() > tolerance * max(now.rows, 1):
        change = np.linalg.lstsq(now.gram, now.gradient, rcond=None)[0]
        for halving in range(30):
            tried = weights - change / 2**halving
            then = newton_sums(df, feats, label, tried, l2)
            if then.loss <= now.loss + 1e-12 * abs(now.loss):
                break
        better = np.abs(then.gradient).max() < np.abs(now.gradient).max() or then.loss < now.loss
        if not better:  # only rounding is left
            break
        weights, now, steps = tried, then, steps + 1
    left = float(np.abs(now.gradient).max() / max(now.rows, 1))
    return LogisticModel(feats, weights.tolist(), left, steps)


def linear_score(model: LogisticModel) -> Column:
    score = F.lit(model.weights[0])
    for c, w in zip(model.features, model.weights[1:], strict=True):
        score = score + named(c) * F.lit(w)
    return score


def score_logistic(model: LogisticModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Add the probability of the positive class as a column expression."""
    return df.withColumn(out, sigmoid(linear_score(model)))


def save_logistic(spark: SparkSession, model: LogisticModel, path: str) -> None:
    """One row per weight; the intercept has no name."""
    names = [None, *model.features]
    rows = [(i, n, w, model.gradient, model.steps) for i, (n, w) in enumerate(zip(names, model.weights, strict=True))]
    schema = "place int, feature string, weight double, gradient double, steps int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_logistic(spark: SparkSession, path: str) -> LogisticModel:
    rows = spark.read.parquet(path).orderBy("place").collect()
    return LogisticModel(
        [r["feature"] for r in rows[1:]], [r["weight"] for r in rows], rows[0]["gradient"], rows[0]["steps"]
    )
