"""Per-step classifiers: fit, score, choose by validation area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.columns import named, quoted
from slotwise.operators.evaluate import roc_auc
from slotwise.operators.logistic import (
    LogisticModel,
    fit_logistic,
    load_logistic,
    save_logistic,
    score_logistic,
)
from slotwise.operators.series import neighbour_features


def _assembled(feats: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(
        inputCols=[quoted(c) if "." in c else c for c in feats], outputCol="_x", handleInvalid="error"
    )


def fit_step_classifier(
    df: DataFrame,
    feats: Sequence[str],
    label: str,
    hidden: int | None = 32,
    max_iter: int = 50,
    seed: int = 8888,
    l2: float = 1.0,
) -> PipelineModel | LogisticModel:
    """A classifier that sees one step at a time.

    With ``hidden`` units it is a perceptron with one hidden layer (Spark ML), without them a
    logistic model fitted to its optimum.
    """
    if not hidden:
        return fit_logistic(df, feats, label, l2, max_iter)
    train = df.withColumn(label, F.col(label).cast("double"))
    estimator = MultilayerPerceptronClassifier(
        layers=[len(feats), hidden, 2], featuresCol="_x", labelCol=label, maxIter=max_iter,
        seed=seed,
    )
    return Pipeline(stages=[_assembled(feats), estimator]).fit(train)


def fit_neighbour_classifier(
    df: DataFrame,
    id: str,
    time: str,
    feats: Sequence[str],
    label: str,
    lags: Sequence[int] = (1, 0, -1),
    max_iter: int = 50,
    l2: float = 1.0,
    width: str | None = None,
) -> LogisticModel:
    """A logistic model of the previous, current and next step; ``width`` as for ``neighbour_features``.

    Without dropout and inner activation, a width-3 convolution followed by a dense layer is one
    linear map of these three steps.
    """
    wide = neighbour_features(df, id, time, feats, lags, width=width)
    cols = neighbour_names(feats, lags)
    return fit_logistic(wide, cols, label, l2, max_iter)


def neighbour_names(feats: Sequence[str], lags: Sequence[int]) -> list[str]:
    def name(c: str, k: int) -> str:
        return c if k == 0 else f"{c}_{'lag' if k > 0 else 'lead'}{abs(k)}"

    return [name(c, k) for c in feats for k in lags]


def score(model: Model | LogisticModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Add the probability of the positive class; the other columns are kept."""
    if isinstance(model, LogisticModel):
        return score_logistic(model, df, out)
    kept = df.columns
    probability = vector_to_array(F.col("probability"))[1]
    return model.transform(df).select(*map(named, kept), probability.alias(out))


def save_model(spark: SparkSession, model: PipelineModel | LogisticModel, path: str) -> None:
    """Write a fitted model to a folder that all executors reach, in place of an earlier one."""
    if isinstance(model, LogisticModel):
        save_logistic(spark, model, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str, logistic: bool) -> PipelineModel | LogisticModel:
    return load_logistic(spark, path) if logistic else PipelineModel.load(path)


def select_by_auc(
    models: Mapping[str, Model | LogisticModel], val: DataFrame, label: str, path: str | None = None
) -> tuple[str, dict[str, float | None]]:
    """The name of the model with the largest validation ROC area, and all areas.

    All models are scored and evaluated in one job.  With ``path`` the winner is saved there.
    """
    scored = None
    for name, model in models.items():
        part = score(model, val).select(F.lit(name).alias("model"), label, "p")
        scored = part if scored is None else scored.unionByName(part)
    rows = roc_auc(scored, label, "p", by=["model"]).collect()
    areas = {row["model"]: row["roc_auc"] for row in rows}
    best = max(models, key=lambda name: areas.get(name) or 0.0)
    if path:
        save_model(val.sparkSession, models[best], path)
    return best, areas
