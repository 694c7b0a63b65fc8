"""Row order for order-dependent operators.

Spark DataFrames have no row order, so every operator whose answer depends on
it (first appearance, keep first/last, fixed-row parts, positional merge)
takes ``order_by``: column names or Columns forming a *total* order.

``dense_index`` numbers rows 0..n-1 in that order without a global window:

1. the rows are range-partitioned on the order columns and sorted, and each one
   is written to the shared checkpoint folder with its partition's number and
   its place in it;
2. the rows of each partition are counted from that column alone, and a prefix
   sum over the counts (one row a partition) gives each partition's offset;
3. a row's index is its offset plus its place.

The plan does not grow with the number of partitions, and no key comes to the
driver.  The places are part of the written rows, so later uses agree on them
whatever is recomputed; for a total order they do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir, materialise

OrderBy = Sequence[str | Column] | str | Column

_PART = "_tessera_part"
_PLACE = "_tessera_place"
_KEY = "_tessera_key"
_OFF = "_tessera_off"
_TOTAL = "_tessera_total"
#: Up to so many groups (rows of a manifest) are numbered by one sorted task.
FEW_GROUPS = 100_000


def order_columns(order_by: OrderBy) -> list[Column]:
    if order_by is None:
        raise ValueError("order_by is required for an order-dependent operator")
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if not cols:
        raise ValueError("order_by must name at least one column")
    return cols


def order_key(order_by: OrderBy) -> Column:
    """One comparable value for the order (a struct compares field by field)."""
    cols = order_columns(order_by)
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def with_source_ordinal(df: DataFrame, name: str = "_ordinal") -> DataFrame:
    """Attach (file, row in file) of a file scan as the ordinal struct.

    Works for file sources that expose ``_metadata.row_index`` (Parquet).
    """
    return df.withColumn(
        name,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ),
    )


def dense_index(
    df: DataFrame,
    order_by: OrderBy,
    name: str = "_row_idx",
    total: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a 0-based dense row index in ``order_by`` order (and the row total if asked).

    The rows are sorted and written at once, by one job.
    """
    keys = [c.alias(f"{_KEY}{i}") for i, c in enumerate(order_columns(order_by))]
    keyed = df.select("*", *keys)
    by = [f"{_KEY}{i}" for i in range(len(keys))]
    ranged = keyed.repartitionByRange(int(num_partitions), *by) if num_partitions else keyed.repartitionByRange(*by)
    # the low 33 bits of the increasing id count the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.sortWithinPartitions(*by).drop(*by).select(
        "*", F.spark_partition_id().alias(_PART), place.alias(_PLACE)
    )
    rows = materialise(placed, "ordered")
    counts = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _PART,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_OFF),
        F.sum("_n").over(Window.partitionBy()).alias(_TOTAL),
    )
    out = rows.join(F.broadcast(offsets), _PART).withColumn(name, (F.col(_OFF) + F.col(_PLACE)).cast("long"))
    if total:
        out = out.withColumn(total, F.col(_TOTAL))
    return out.drop(_PART, _PLACE, _OFF, _TOTAL)


def first_appearance_numbers(
    groups: DataFrame, first: str, name: str = "part_no", total: str = "total_parts"
) -> DataFrame:
    """Number groups 1..k by their first ordinal.

    The groups are checkpointed first (to the shared ``spark.checkpoint.dir``), so
    that the rows behind them are read and grouped once.  Up to ``FEW_GROUPS`` of them, by their
    measured count, are numbered by a window in one task; more (a split by a
    customer id has millions) by ``dense_index``.
    """
    checkpoint_dir(groups.sparkSession)
    groups = groups.checkpoint(eager=True)
    count = groups.count()
    if count <= FEW_GROUPS:
        return groups.select(
            "*",
            F.row_number().over(Window.orderBy(first)).cast("long").alias(name),
            F.lit(count).cast("long").alias(total),
        )
    numbered = dense_index(groups, [first], name="_gidx", total=total)
    return numbered.withColumn(name, (F.col("_gidx") + 1).cast("long")).withColumn(
        total, F.col(total).cast("long")
    ).drop("_gidx")


def numbers_within(groups: DataFrame, within: str, first: str, name: str, total: str) -> DataFrame:
    """Number checkpointed ``groups`` 1..k by their first ordinal for each value of ``within`` (a few values).

    As in ``first_appearance_numbers``, many groups go through one distributed index.
    """
    if groups.count() <= FEW_GROUPS:
        own = Window.partitionBy(within)
        return groups.select(
            "*",
            F.row_number().over(own.orderBy(first)).cast("long").alias(name),
            F.count(F.lit(1)).over(own).cast("long").alias(total),
        )
    numbered = dense_index(groups, [within, first], name="_gidx")
    starts = numbered.groupBy(within).agg(F.min("_gidx").alias("_start"), F.count(F.lit(1)).cast("long").alias(total))
    out = numbered.join(F.broadcast(starts), within)  # one row a value of ``within``
    return out.withColumn(name, (F.col("_gidx") - F.col("_start") + 1).cast("long")).drop("_gidx", "_start")
