"""Field renaming and cleaning.

Every string step is a column expression over the string columns (one
projection); NFKC touches non-ASCII rows only (ICU in the JVM by default).
Dropping empty *columns* depends on the data: it runs one aggregate of
non-missing counts (an action) and then a ``select``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import blank_to_null, collapse_ws, is_missing, nfkc, trim_ws


@dataclass
class CleaningOptions:
    trim_whitespace: bool = False
    collapse_whitespace: bool = False
    normalize_width: bool = False
    drop_empty_rows: bool = False
    drop_empty_columns: bool = False
    drop_duplicate_rows: bool = False
    order: str = "live"  # "live": trim -> collapse -> width; "width_first": width -> trim -> collapse


def rename_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``{source: target}`` renames; names not present are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean_strings(
    df: DataFrame, trim: bool = False, collapse: bool = False, width: bool = False, order: str = "live"
) -> DataFrame:
    """P3/P4/P5 (and P9 with ``order='width_first'``) on every string column."""
    if not (trim or collapse or width):
        return df
    if order not in ("live", "width_first"):
        raise ValueError(f"Unknown cleaning order: {order}")
    steps = []
    if order == "width_first" and width:
        steps.append(nfkc)
    if trim:
        steps.append(trim_ws)
    if collapse:
        steps.append(collapse_ws)
    if order == "live" and width:
        steps.append(nfkc)
    exprs = {}
    for name in _string_columns(df):
        c = F.col(name)
        for step in steps:
            c = step(c)
        exprs[name] = c
    return df.withColumns(exprs) if exprs else df


def drop_empty_rows(df: DataFrame, blanks_are_empty: bool = True, hidden: Sequence[str] = ()) -> DataFrame:
    """P6 (and S7 with ``blanks_are_empty=False``): rows whose every cell is missing go.

    With ``blanks_are_empty`` blank strings first become NULL (and stay NULL).
    ``hidden`` columns (a row's ordinal) are not cells.
    """
    shown = [c for c in df.columns if c not in hidden]
    if blanks_are_empty:
        strings = {n: blank_to_null(F.col(n), T.StringType()) for n in _string_columns(df) if n in shown}
        if strings:
            df = df.withColumns(strings)
    # na.drop counts NaN as missing too, like pandas
    return df.na.drop(how="all", subset=shown) if shown else df


def drop_duplicate_rows(df: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    """Equal rows become one; of ``hidden`` columns (a row's ordinal) the smallest stays."""
    hidden = [c for c in df.columns if c in hidden]
    if not hidden:
        return df.dropDuplicates()
    shown = [F.col(f"`{c}`") for c in df.columns if c not in hidden]
    return df.groupBy(*shown).agg(*[F.min(c).alias(c) for c in hidden]).select(*df.columns)


def empty_columns(df: DataFrame) -> list[str]:
    """Columns with no non-missing value (one aggregate job)."""
    if not df.columns:
        return []
    row = df.agg(
        *[F.count(F.when(~is_missing(df[f.name], f.dataType), 1)).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    ).collect()[0]
    return [f.name for i, f in enumerate(df.schema.fields) if row[f"c{i}"] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop all-missing columns (data-dependent schema: runs one job)."""
    gone = set(empty_columns(df))
    return df.select(*[c for c in df.columns if c not in gone]) if gone else df


def clean(df: DataFrame, options: CleaningOptions, hidden: Sequence[str] = ()) -> DataFrame:
    """The cleaning pipeline: strings, empty rows, empty columns, duplicate rows.

    ``hidden`` columns order the rows and are no data: they neither keep an
    empty row nor tell duplicates apart.
    """
    df = clean_strings(
        df, options.trim_whitespace, options.collapse_whitespace, options.normalize_width, options.order
    )
    if options.drop_empty_rows:
        df = drop_empty_rows(df, hidden=hidden)
    if options.drop_empty_columns:
        df = drop_empty_columns(df)
    if options.drop_duplicate_rows:
        df = drop_duplicate_rows(df, hidden)
    return df
