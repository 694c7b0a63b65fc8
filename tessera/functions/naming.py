"""Output naming: path-safe names (F13), table-safe names (F14), templates.

The template is parsed once on the driver; the result is a ``concat`` of
manifest columns and literals, so names are computed for every group in one
projection over the manifest.
"""

from __future__ import annotations

import re
import string
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.unique import Names
from tessera.functions.values import WS_RUN_PATTERN, casefold, col_of, trim_ws
from tessera.session import checkpoint_dir, materialise

# Characters not allowed in file names, and reserved device names.
UNSAFE_PATH_CHARS = '[<>:"/\\\\|?*\\x00-\\x1f]'
RESERVED_NAMES = (
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
MAX_PATH_NAME = 180

TEMPLATE_FIELDS = (
    "original_name", "sheet_name", "split_field", "split_value", "part_no", "total_parts",
    "date", "time", "datetime", "task_name", "row_count", "index", "hierarchy_path",
    "level1_value", "level2_value", "level3_value",
)


def _rstrip_dots(c: Column) -> Column:
    return F.regexp_replace(c, "[. ]+$", "")


def safe_path_name(c: Column | str, fallback: str = "output", max_length: int = MAX_PATH_NAME) -> Column:
    """replace unsafe characters by ``_``, trim, drop trailing dots, guard reserved names."""
    c = F.regexp_replace(col_of(c), UNSAFE_PATH_CHARS, "_")
    c = _rstrip_dots(trim_ws(c))
    c = F.regexp_replace(c, WS_RUN_PATTERN, " ")
    c = F.when(c == "", F.lit(fallback)).otherwise(c)
    c = F.when(F.upper(c).isin(*RESERVED_NAMES), F.concat(F.lit("_"), c)).otherwise(c)
    c = _rstrip_dots(F.substring(c, 1, max_length))
    return F.when(c == "", F.lit(fallback)).otherwise(c)


def safe_table_name(value: str, fallback: str = "Sheet", max_length: int | None = None) -> str:
    """F14 for a name the driver knows: ``\\ / * ? : [ ]`` become ``_``, outer quotes go, nothing is cut by default."""
    kept = "".join("_" if ch in "\\/*?:[]" else ch for ch in value)
    return (kept.strip("'") or fallback)[:max_length]


# What a template field shows when neither the manifest nor the caller gives it.
_TEXT_DEFAULTS = {"original_name": "workbook", "sheet_name": "Sheet", "task_name": "task"}
_NUMBER_DEFAULTS = {"part_no": 1, "total_parts": 1, "index": 1, "row_count": 0}
_CLOCK_FORMATS = {"date": "%Y%m%d", "time": "%H%M%S", "datetime": "%Y%m%d_%H%M%S"}


def _defaults(now: datetime) -> dict[str, object]:
    clock = {field: now.strftime(fmt) for field, fmt in _CLOCK_FORMATS.items()}
    return dict.fromkeys(TEMPLATE_FIELDS, "") | _TEXT_DEFAULTS | _NUMBER_DEFAULTS | clock


_INT_SPEC = re.compile(r"^(0?)(\d*)d$")


def _formatted(value: Column | object, spec: str) -> Column:
    if isinstance(value, Column):
        if not spec:
            return value.cast("string")
        m = _INT_SPEC.match(spec)
        if not m:
            raise ValueError(f"Invalid naming template: unsupported format '{spec}'")
        txt = value.cast("long").cast("string")
        if m.group(2):  # lpad would cut what is longer than the width
            width = int(m.group(2))
            txt = F.when(F.length(txt) < width, F.lpad(txt, width, "0" if m.group(1) else " ")).otherwise(txt)
        return txt
    return F.lit(format(value, spec))


def render_template(
    template: str,
    columns: Mapping[str, Column | str],
    values: Mapping[str, object] | None = None,
    now: datetime | None = None,
) -> Column:
    """name template over manifest columns, made path-safe.

    ``columns`` maps placeholders to manifest columns, ``values`` to constants.
    An unknown placeholder raises ``ValueError`` before any job runs.
    """
    known: dict[str, object] = _defaults(now or datetime.now())
    known.update(values or {})
    for key, c in columns.items():
        known[key] = col_of(c)
    parts: list[Column] = []
    try:
        parsed = list(string.Formatter().parse(template))
    except ValueError as error:
        raise ValueError(f"Invalid naming template: {error}") from error
    for literal, field, spec, conversion in parsed:
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if field not in known:
            raise ValueError(f"Invalid naming template: '{field}'")
        if conversion:
            raise ValueError(f"Invalid naming template: conversion '!{conversion}'")
        parts.append(_formatted(known[field], spec or ""))
    return safe_path_name(F.concat(*parts) if parts else F.lit(""))


#: Parts numbered together inside one name; a name that all groups share is spread over slices of this many.
_SLICE = 10_000


def number_collisions(
    manifest: DataFrame, name: str, order: str, out: str | None = None, max_length: int | None = None
) -> DataFrame:
    """K6: names that coincide (case-folded) get ``_2``, ``_3`` ... in ``order``, skipping endings that are taken.

    ``order`` is a dense integer (the part number).  Where no name looks like
    another one's numbered form, a name's k-th group gets ``_k``: counted over
    slices of the order first, then inside a slice, so a template that names all
    groups alike is spread over tasks.  The few families in which a name equals
    a numbered form of another (``a, A, a_2``) are walked in order, one family
    in one task.  With ``max_length`` the name is cut so that the ending fits.
    """
    out = out or name
    checkpoint_dir(manifest.sparkSession)
    rows = manifest.withColumns({"_same": casefold(F.col(name)), "_at": F.col(order).cast("long")}).withColumns(
        {"_family": F.regexp_replace("_same", "(_[0-9]+)+$", ""), "_slice": F.floor(F.col("_at") / _SLICE)}
    )
    rows = rows.checkpoint(eager=True)
    slices = rows.groupBy("_family", "_same", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    names = slices.groupBy("_family", "_same").agg(F.sum("_n").alias("_n"))
    numbered = names.filter("_n > 1").select(F.col("_same").alias("_base"))
    # a base or family that all names share is one row a task here: the pairs are combined before they are dealt
    bases = names.select("_family", F.regexp_extract("_same", "^(.*)_[0-9]+$", 1).alias("_base")).distinct()
    tangled = bases.join(numbered, "_base", "left_semi").select("_family").distinct()
    tangled = materialise(tangled, "tangled")  # files of known size: few families are broadcast, and no row is dealt by family
    walking = not tangled.isEmpty()
    earlier = Window.partitionBy("_same").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_same", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_same", "_slice").orderBy("_at"))
    plain = rows.join(tangled, "_family", "left_anti") if walking else rows
    simple = plain.withColumn("_k", inside).join(offsets, ["_same", "_slice"])
    ending = F.when(F.col("_k") + F.col("_before") > 1, F.concat(F.lit("_"), (F.col("_k") + F.col("_before")).cast("string")))
    ending = F.coalesce(ending, F.lit(""))
    base = F.col(name)
    if max_length is not None:
        base = F.substring(base, F.lit(1), F.lit(int(max_length)) - F.length(ending))
    simple = simple.select(*manifest.columns, F.concat(base, ending).alias("_unique"))
    if not walking:
        return simple.withColumn(out, F.col("_unique")).drop("_unique")

    columns = list(manifest.columns)

    def walk(frame):
        used = Names(str.casefold, max_length)
        frame = frame.sort_values("_at", kind="stable")
        return frame[columns].assign(_unique=[used.take(n) for n in frame[name]])

    schema = T.StructType([*manifest.schema.fields, T.StructField("_unique", T.StringType())])
    walked = rows.join(tangled, "_family", "left_semi").groupBy("_family").applyInPandas(walk, schema)
    return simple.unionByName(walked).withColumn(out, F.col("_unique")).drop("_unique")
