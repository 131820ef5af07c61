"""Registered queries, each with the SQL that states the same result independently."""

from slotwise.plans.catalog import (
    evaluation,
    events,
    layout,
    learning,
    quality,
    series,
    sketches,
    storage,
)
from slotwise.plans.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "evaluation", "events", "layout", "learning", "quality", "series", "sketches",
    "storage",
]
