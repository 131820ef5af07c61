from slotwise.functions.columns import (
    any_of,
    binarize,
    days_between,
    first_nonnull,
    hash_bucket,
    nonzero_mean,
    row_hash,
    sigmoid,
    slot_of,
)
from slotwise.functions.ranking import cumulative, exact_quantiles, quantile, shuffled_rank

__all__ = [
    "any_of", "binarize", "cumulative", "days_between", "exact_quantiles", "first_nonnull",
    "hash_bucket", "nonzero_mean", "quantile", "row_hash", "shuffled_rank", "sigmoid", "slot_of",
]
