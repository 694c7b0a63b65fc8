"""Remove duplicate rows.

``keep='first'/'last'`` by ``order_by`` is an aggregate, not a window:
``min_by(struct(row), order)`` per key is combined map-side, so a key that
holds a third of the table still leaves each map task with one partial row
instead of sending all its rows to one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import OrderBy, order_key

ALL = "all"
FIELDS = "fields"
NONE = "none"


def keep_one_per_key(df: DataFrame, keys: Sequence[str], order_by: OrderBy, keep: str = "first") -> DataFrame:
    """One row per key: the first (or last) in ``order_by``; NULL keys are equal."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(pick(row, order_key(order_by)).alias("_kept")).select("_kept.*")


def dedupe(
    df: DataFrame,
    mode: str = ALL,
    fields: Sequence[str] | None = None,
    keep: str = "first",
    order_by: OrderBy | None = None,
) -> DataFrame:
    """Identical rows collapse (``dropDuplicates``; equal rows are interchangeable).
    D2: one row per ``fields`` value, the first or last by ``order_by``."""
    if mode == NONE:
        return df
    if mode == ALL:
        return df.dropDuplicates()
    if mode != FIELDS:
        raise ValueError(f"Unknown dedupe mode: {mode}")
    fields = list(fields or [])
    if not fields:
        raise ValueError("Deduplication by fields needs at least one field")
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise KeyError(f"Missing deduplication fields: {', '.join(missing)}")
    if order_by is None:
        raise ValueError("Deduplication by fields keeps first/last and needs order_by")
    return keep_one_per_key(df, fields, order_by, keep)
