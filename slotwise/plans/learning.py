"""From the slot grid to supervised sets, predictions and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.columns import binarize, quoted
from slotwise.operators.cleaning import feature_columns, impute_constant
from slotwise.operators.encode import (
    SPLITS,
    apply_scaler,
    fit_scaler,
    get_split,
    one_hot_labels,
    pad_sequences,
    scaled_zero,
    split_by_id,
)
from slotwise.operators.evaluate import classification_report, curve_metrics
from slotwise.operators.quality import max_group_size
from slotwise.operators.series import shift_label
from slotwise.session import fetched, stored


class SupervisedSet(NamedTuple):
    """``rows`` are labelled, imputed and scaled steps with their split; ``stats`` is what the
    scaler learned from the training split; ``maxlen`` is the longest training series."""

    rows: DataFrame
    stats: DataFrame
    features: list[str]
    maxlen: int
    id: str
    time: str
    label: str

    def split(self, name: str) -> DataFrame:
        return get_split(self.rows, name)

    def sequences(self, name: str) -> DataFrame:
        """One padded sequence per id, with labels as class pairs."""
        padded = pad_sequences(
            self.split(name), self.id, self.time, self.features, self.maxlen, self.label,
            pad=scaled_zero(self.stats, self.features),
        )
        return padded.withColumn("labels", one_hot_labels("labels"))


def supervised_set(
    grid: DataFrame,
    id: str = "stay_id",
    time: str = "charttime",
    label: str = "aki_stage",
    features: Sequence[str] | None = None,
    steps: int = 8,
    weights=SPLITS,
    seed: int = 8888,
    include_padding: bool = True,
    fn: str = "xxhash64",
    width: str | None = None,
) -> SupervisedSet:
    """Shift the label, fill gaps with zero, split by entity and scale by the training split.

    ``width`` is the width of the grid's slots; with it labels are shifted by blocks of slots, so that one
    long entity uses many tasks.

    The labelled rows are stored once; the statistics, the longest series and every later use
    read that table.
    """
    feats = list(features or feature_columns(grid, [id, time, label]))
    narrow = grid.select(id, time, label, *map(quoted, feats))
    labelled = shift_label(narrow, id, time, label, steps, width=width)
    filled = impute_constant(labelled, 0, feats)
    split = stored(split_by_id(filled, id, weights, seed, fn))
    train = get_split(split, "train")
    longest = max_group_size(train, id)
    maxlen = longest.first()["max_size"] or 0
    stats = fetched(fit_scaler(train, feats, id, maxlen, include_padding))
    return SupervisedSet(
        apply_scaler(split, stats, feats), stats, feats, maxlen, id, time, label
    )


def evaluate(
    predictions: DataFrame,
    y: str = "y",
    p: str = "p",
    threshold: float = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Areas, F1, the best cut-off and the confusion metrics of predictions, one row per group."""
    by = list(by)
    curves = curve_metrics(predictions, y, p, by).withColumnsRenamed(
        {"threshold": "best_threshold", "tpr": "best_tpr", "fpr": "best_fpr"}
    )
    pred = predictions.withColumn("_pred", binarize(p, threshold))
    report = classification_report(pred, y, "_pred", by)
    if by:
        return report.join(curves, by)
    names = curves.columns
    one = curves.select(F.struct(*names).alias("c"))
    return report.withColumn("_c", one.scalar()).select("*", "_c.*").drop("_c")


__all__ = ["SupervisedSet", "evaluate", "supervised_set"]
