"""Split a table into labelled groups.

A split never materialises one DataFrame per group.  It returns

* ``rows``: the kept input rows plus ``split_label`` (and ``part_no`` for
  positional splits), ready for one partitioned write;
* ``manifest``: one row per group with ``split_label, part_no, total_parts,
  row_count`` in first-appearance order;
* ``flagged``: every input row with ``_excluded`` (NULL when kept, else the
  reason), the base of the row reconciliation.

Labels are narrow projections, the manifest is a partial + final aggregate
(a hot label costs one partial row per map task; a multi-column order makes
it sort-based), and group numbering runs over the manifest only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import DEFAULT_EMPTY_LABEL, is_blank, text_of
from tessera.operators.ordinals import OrderBy, dense_index, first_appearance_numbers, order_key

LABEL = "split_label"
EXCLUDED = "_excluded"

BLANK_GROUP = "group"
BLANK_SKIP = "skip"


@dataclass
class Split:
    rows: DataFrame
    manifest: DataFrame
    flagged: DataFrame

    def reconciliation(self) -> DataFrame:
        """One row: input_rows, output_rows, excluded_rows (and per reason in ``excluded_by``)."""
        from tessera.plans.reconcile import reconcile_flagged

        return reconcile_flagged(self.flagged)


def _check_fields(df: DataFrame, fields: Sequence[str], what: str = "split") -> list[str]:
    fields = list(fields)
    if not fields:
        raise ValueError(f"At least one {what} field is required")
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise KeyError(f"Missing {what} fields: {', '.join(missing)}")
    return fields


def field_label(
    df: DataFrame,
    fields: Sequence[str],
    empty_label: str = DEFAULT_EMPTY_LABEL,
    style: str = "pairs",
) -> Column:
    """X1/X2/X3 label: ``value``; ``f1=v1 | f2=v2`` (pairs); ``v1__v2`` (joined)."""
    values = []
    for f in fields:
        dtype = df.schema[f].dataType
        values.append(F.when(is_blank(df[f], dtype), F.lit(empty_label)).otherwise(text_of(df[f], dtype)))
    if style == "joined":
        return F.concat_ws("__", *values)
    if style != "pairs":
        raise ValueError(f"Unknown label style: {style}")
    if len(values) == 1:
        return values[0]
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{f}="), v) for f, v in zip(fields, values)])


def group_manifest(rows: DataFrame, order_by: OrderBy, label: str = LABEL) -> DataFrame:
    """O1: one row per label with its size, numbered by first appearance."""
    groups = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(order_key(order_by)).alias("_first")
    )
    numbered = first_appearance_numbers(groups, "_first")
    return numbered.select(label, "part_no", "total_parts", "row_count")


def split_by_fields(
    df: DataFrame,
    fields: Sequence[str],
    order_by: OrderBy,
    empty_label: str = DEFAULT_EMPTY_LABEL,
    blank_policy: str = BLANK_GROUP,
    label_style: str = "pairs",
) -> Split:
    """X1-X3 with P11: label each row by its field values.

    ``blank_policy='group'`` puts blank values under ``empty_label`` (a real
    value equal to the label joins that group); ``'skip'`` excludes rows with
    any blank split field, counted under reason ``blank``.  Values are not
    normalised: ``' A'`` and ``'A'`` are two groups.
    """
    fields = _check_fields(df, fields)
    if blank_policy not in (BLANK_GROUP, BLANK_SKIP):
        raise ValueError(f"Unknown blank policy: {blank_policy}")
    reason = F.lit(None).cast("string")
    if blank_policy == BLANK_SKIP:
        any_blank = F.lit(False)
        for f in fields:
            any_blank = any_blank | is_blank(df[f], df.schema[f].dataType)
        reason = F.when(any_blank, F.lit("blank"))
    flagged = df.withColumn(EXCLUDED, reason).withColumn(
        LABEL, F.when(F.col(EXCLUDED).isNull(), field_label(df, fields, empty_label, label_style))
    )
    rows = flagged.filter(F.col(EXCLUDED).isNull()).drop(EXCLUDED)
    return Split(rows, group_manifest(rows, order_by), flagged)


def _positional(df: DataFrame, order_by: OrderBy, part_of, parts_of) -> Split:
    """Parts by position; ``part_of(idx, total)`` and ``parts_of(total)`` are column rules."""
    indexed = dense_index(df, order_by, name="_row_idx", total="_total")
    total = F.col("_total")
    rows = (
        indexed.withColumn("part_no", part_of(F.col("_row_idx"), total).cast("long"))
        .withColumn("total_parts", parts_of(total).cast("long"))
        .withColumn(LABEL, F.col("part_no").cast("string"))
        .drop("_row_idx", "_total")
    )
    manifest = rows.groupBy(LABEL, "part_no", "total_parts").agg(F.count(F.lit(1)).alias("row_count"))
    manifest = manifest.select(LABEL, "part_no", "total_parts", "row_count")
    # an empty input still gives one (empty) part: a marker row kept only when
    # the manifest has no row (a scalar subquery over at most one row of it)
    spark = df.sparkSession
    has_rows = manifest.limit(1).agg(F.count(F.lit(1))).scalar()
    marker = spark.range(1).select(
        F.lit("1").alias(LABEL), F.lit(1).cast("long").alias("part_no"), F.lit(1).cast("long").alias("total_parts"),
        F.lit(0).cast("long").alias("row_count"),
    )
    manifest = manifest.unionByName(marker.where(has_rows == F.lit(0)))
    flagged = rows.withColumn(EXCLUDED, F.lit(None).cast("string"))
    return Split(rows, manifest, flagged)


def split_fixed_rows(df: DataFrame, rows_per_part: int, order_by: OrderBy, balanced: bool = False) -> Split:
    """X4 (consecutive parts of ``rows_per_part`` rows) and X5 (``balanced``: as few
    near-equal parts as the limit allows)."""
    if rows_per_part <= 0:
        raise ValueError("A part holds one row at least")
    if balanced:
        return _split_parts(df, None, order_by, limit=rows_per_part)
    n = F.lit(int(rows_per_part))
    return _positional(
        df,
        order_by,
        lambda idx, total: F.floor(idx / n) + 1,
        lambda total: F.greatest(F.lit(1), F.ceil(total / n)),
    )


def split_into_parts(df: DataFrame, parts: int, order_by: OrderBy) -> Split:
    """``parts`` near-equal parts; the first ``n mod parts`` get one more row;
    empty parts are omitted (``ntile`` semantics, computed by arithmetic on the index)."""
    if parts <= 0:
        raise ValueError("A table is split into one part at least")
    return _split_parts(df, int(parts), order_by)


def _split_parts(df: DataFrame, parts: int | None, order_by: OrderBy, limit: int | None = None) -> Split:
    def k_of(total: Column) -> Column:
        if parts is None:
            return F.greatest(F.lit(1), F.ceil(total / F.lit(limit))).cast("long")
        return F.lit(parts).cast("long")

    def part_of(idx: Column, total: Column) -> Column:
        k = k_of(total)
        q = F.floor(total / k).cast("long")
        r = total - q * k
        big = r * (q + 1)
        # when q = 0 every row is in the first branch; the guard only avoids 1/0
        return F.when(idx < big, F.floor(idx / (q + 1)) + 1).otherwise(
            r + F.floor((idx - big) / F.greatest(q, F.lit(1))) + 1
        )

    def parts_of(total: Column) -> Column:
        return F.greatest(F.lit(1), F.least(k_of(total), total))

    return _positional(df, order_by, part_of, parts_of)


def split_by_table(tables: Sequence[tuple[str, DataFrame]], strategy: str = "align") -> Split:
    """X7 with S12: each table is its own group; rows carry ``Source_Sheet``."""
    from tessera.operators.stack import stack

    tagged = [df.withColumn("Source_Sheet", F.lit(name)) for name, df in tables]
    combined = stack(tagged, strategy)
    rows = combined.withColumn(LABEL, F.col("Source_Sheet"))
    # every table is an output, empty ones too: start from the (driver-known)
    # table list and attach the counts
    listed = tagged[0].sparkSession.createDataFrame(
        [(name, i + 1) for i, (name, _df) in enumerate(tables)], f"{LABEL} string, part_no long"
    )
    counts = rows.groupBy(LABEL).agg(F.count(F.lit(1)).alias("row_count"))
    manifest = (
        listed.join(counts, LABEL, "left")
        .withColumn("row_count", F.coalesce(F.col("row_count"), F.lit(0)).cast("long"))
        .withColumn("total_parts", F.lit(len(tables)).cast("long"))
    )
    flagged = rows.withColumn(EXCLUDED, F.lit(None).cast("string"))
    return Split(rows, manifest.select(LABEL, "part_no", "total_parts", "row_count"), flagged)
