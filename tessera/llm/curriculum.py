"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time 0..1: a piecewise linear
curve through knots.  Its integral is the source's share of the word demand.
Shares are resolved against ``max_copies`` times each source's size; what is
cut off is shared out again by weight (water filling in closed form over the
source table).  Documents of a source stand in a fixed pseudo-random order;
their words fill the stream ``[0, target)``, pass after pass.  A copy is taken
when the middle of its words lies below the target, and its training position
is the time at which the source's cumulative demand (the integral of its
schedule) reaches that middle: the inverse of a piecewise quadratic.

The running word count is a two-level prefix sum: sums of (source, slice)
first, then a window inside each slice.  Slices are cut by document hash and
hold about ``slice_rows`` rows, so a source with a third of all rows is spread
over as many tasks as its rows need.  Only the table with one row per source
passes through a single task.

Defined cases: a null text has size 0; documents of size 0 are never taken.
A null source is a source of its own, ordered last.  Rows that repeat an id
stand in order of their text hash; rows equal in both are interchangeable.
Columns named like the outputs are replaced.  An empty table yields an empty
table.  A row's share may miss the target by at most half of the one document
at the boundary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialise, without
from tessera.operators.ordinals import dense_index

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Shapes of the schedules, repeating: (time, factor) knots whose integral is 1.
SHAPES = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)),
)
_WORD = r"[^\x20\x09-\x0D]+"
OUTPUTS = ("size", "source_size", "target", "taken", "positions")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _schedule(weights: Sequence[float], shapes: Sequence, named: Mapping[str, Sequence] | None) -> Column:
    """struct(t, w) of knots: by source name if given, else by the source's rank."""

    def knots(points, factor=1.0):
        return F.struct(_array([p[0] for p in points]).alias("t"), _array([p[1] * factor for p in points]).alias("w"))

    rank = F.col("_rank")
    period = len(weights) * len(shapes)
    out = knots(shapes[-1], weights[-1])
    for k in range(period):
        out = F.when(rank % period == k, knots(shapes[k % len(shapes)], weights[k % len(weights)])).otherwise(out)
    for name, points in (named or {}).items():
        out = F.when(F.col("_source").eqNullSafe(F.lit(name)), knots(points)).otherwise(out)
    return out


def source_plan(
    sizes: DataFrame,
    share: float,
    max_copies: int,
    weights: Sequence[float] = WEIGHTS,
    shapes: Sequence = SHAPES,
    schedules: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """One row per source: its size, schedule, the schedule's integral, and its word target.

    ``sizes`` holds ``_skey``, ``_source``, ``_size`` (one row per source).
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn(
        "_rank", F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last())) - 1
    ).withColumn("_sched", _schedule(weights, shapes, schedules))
    t, w = F.col("_sched.t"), F.col("_sched.w")
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(t) - 1),
        lambda i: (F.element_at(t, i + 1) - F.element_at(t, i)) * (F.element_at(w, i + 1) + F.element_at(w, i)) / 2,
    )
    cumulative = F.transform(
        F.sequence(F.lit(0), F.size("_pieces")),
        lambda n: F.aggregate(F.slice("_pieces", 1, n), F.lit(0.0), lambda a, x: a + x),
    )
    planned = (
        ranked.withColumn("_pieces", pieces)
        .withColumn("_cum", cumulative)
        .withColumn("_weight", F.element_at("_cum", -1))
        .withColumn("_cap", (F.col("_size") * max_copies).cast("double"))
        .withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).otherwise(F.lit(0.0)))
    )
    by_ratio = everything.orderBy("_ratio", "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the first source, by cap over weight, that its fair share of the rest does not overfill sets the level
    levelled = (
        planned.withColumn("_demand", F.sum("_size").over(everything) * F.lit(float(share)))
        .withColumn("_rest", F.col("_demand") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_rest") / F.nullif(F.sum("_weight").over(after), F.lit(0.0)))
        .withColumn("_order", F.row_number().over(by_ratio))
        .withColumn(
            "_free",
            F.when((F.col("_weight") > 0) & (F.col("_level") <= F.col("_ratio")), F.struct("_order", "_level")),
        )
        .withColumn("_lambda", F.min("_free").over(everything)["_level"])
    )
    target = F.when(F.col("_weight") <= 0, F.lit(0.0)).otherwise(
        F.least(F.col("_cap"), F.coalesce(F.col("_lambda") * F.col("_weight"), F.col("_cap")))
    )
    return levelled.select("_skey", "_size", "_sched", "_cum", "_weight", target.alias("_target"))


def _position(fill: Column) -> Column:
    """The time at which the schedule's integral reaches ``fill`` (0..1 of its total)."""
    x = F.least(F.greatest(fill, F.lit(0.0)), F.lit(1.0)) * F.col("_weight")
    piece = F.least(F.size(F.filter("_cum", lambda c: c <= x)), F.size("_cum") - 1)
    t, w = F.col("_sched.t"), F.col("_sched.w")
    t0, w0 = F.element_at(t, piece), F.element_at(w, piece)
    t1, w1 = F.element_at(t, piece + 1), F.element_at(w, piece + 1)
    left = x - F.element_at(F.col("_cum"), piece)
    slope = (w1 - w0) / (t1 - t0)
    root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * left, F.lit(0.0)))
    return F.least(t0 + F.when(root > 0, 2 * left / root).otherwise(F.lit(0.0)), t1)


def plan_curriculum(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    max_copies: int = 2,
    weights: Sequence[float] = WEIGHTS,
    shapes: Sequence = SHAPES,
    schedules: Mapping[str, Sequence] | None = None,
    seed: int = 7,
    slice_rows: int = 5000,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` plus size, source_size, target, taken and positions (one training position per copy).

    Without ``keep_text`` the text column goes once its words are counted: the
    sizes are written, and all planning reads those.
    """
    docs = without(docs, *OUTPUTS)
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    key = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    sized = (
        docs.withColumn("size", word_count(text))
        .withColumn("_skey", F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")))
        .withColumn("_order", key)
        .withColumn("_tie", F.xxhash64(text))
    )
    if not keep_text:
        docs = docs.drop(text_col)
        sized = materialise(sized.drop(text_col), "curriculum-sizes")
    slices = max(1, -(-sized.count() // slice_rows))
    place = F.floor(F.col("_order") / F.lit(16.0**13) * slices)
    sized = sized.withColumn("_slice", F.least(place, F.lit(slices - 1).cast("long")))
    sums = sized.groupBy("_skey", "_slice").agg(
        F.first(source.cast("string")).alias("_source"), F.sum("size").alias("_sum")
    )
    sources = source_plan(
        sums.groupBy("_skey").agg(F.first("_source").alias("_source"), F.sum("_sum").alias("_size")),
        share,
        max_copies,
        weights,
        shapes,
        schedules,
    )
    by_slice = Window.partitionBy("_skey").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_skey", "_slice", F.coalesce(F.sum("_sum").over(by_slice), F.lit(0)).alias("_offset")
    ).join(sources, "_skey")
    inside = Window.partitionBy("_skey", "_slice").orderBy("_order", "_tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = (
        sized.join(offsets, ["_skey", "_slice"])
        .withColumn("_mid", F.col("_offset") + F.sum("size").over(inside) - F.col("size") / 2)
        .withColumn(
            "positions",
            F.transform(
                F.filter(
                    F.transform(F.sequence(F.lit(0), F.lit(max_copies - 1)), lambda k: k * F.col("_size") + F.col("_mid")),
                    lambda m: (m < F.col("_target")) & (F.col("size") > 0),
                ),
                lambda m: _position(m / F.col("_target")),
            ),
        )
    )
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "size",
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.size("positions") * F.col("size")).cast("long").alias("taken"),
        "positions",
    )


def stream_places(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``planned`` plus ``places``: where each copy of a document stands (from 0) in the range-sorted training stream."""
    rows = materialise(planned.withColumn("_row", F.monotonically_increasing_id()), "curriculum-plan")
    copies = rows.select("_row", F.col(f"`{id_col}`").alias("_id"), F.posexplode("positions").alias("_copy", "_at"))
    placed = dense_index(copies, ["_at", "_id", "_copy", "_row"], name="_place")
    places = placed.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_copy", "_place"))).alias("_p"))
    none = F.array().cast("array<long>")
    return (
        rows.join(places, "_row", "left")
        .withColumn("places", F.coalesce(F.transform("_p", lambda p: p["_place"]), none))
        .drop("_row", "_p")
    )


def mix_curriculum(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The training stream: one row per copy with ``copy`` and ``position``, range-sorted by position."""
    planned = plan_curriculum(without(docs, "copy", "position"), id_col, **options)
    keep = [F.col(f"`{c}`") for c in planned.columns if c not in OUTPUTS]
    return planned.select(*keep, F.posexplode("positions").alias("copy", "position")).orderBy(
        "position", F.col(f"`{id_col}`"), "copy"
    )
