"""Small literal tables for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

DAY0 = datetime(2024, 1, 1)


def at(hours: float = 0.0, **more) -> datetime:
    return DAY0 + timedelta(hours=hours, **more)


def rows_of(df, *order):
    """Rows as tuples, sorted by the given columns (all columns by default)."""
    order = order or df.columns
    return [tuple(r) for r in df.orderBy(*order).collect()]
