"""Split a growing folder of files with Structured Streaming.

The table semantics being reproduced work on finite files; the streaming form
is the same field split (X1-X3 with the blank policy) run incrementally as
files arrive.  Labels are per-row projections, so they need no state.  Each
micro-batch writes

* its rows under ``{output}/data/batch_id=N/split_label=.../`` (overwrite of
  the batch folder, so a replayed batch replaces itself: idempotent), and
* its counts per label and exclusion reason under ``{output}/manifest_log``
  (also keyed by batch), from which ``manifest`` sums the running totals.

First-appearance numbering needs the whole input, so the streaming manifest
orders groups by label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.functions.values import DEFAULT_EMPTY_LABEL, is_blank
from tessera.operators.split import EXCLUDED, LABEL, field_label
from tessera.session import checkpoint_dir


def _flag(df: DataFrame, fields: Sequence[str], empty_label: str, blank_policy: str, label_style: str) -> DataFrame:
    reason = F.lit(None).cast("string")
    if blank_policy == "skip":
        any_blank = F.lit(False)
        for f in fields:
            any_blank = any_blank | is_blank(df[f], df.schema[f].dataType)
        reason = F.when(any_blank, F.lit("blank"))
    return df.withColumn(EXCLUDED, reason).withColumn(
        LABEL, F.when(F.col(EXCLUDED).isNull(), field_label(df, fields, empty_label, label_style))
    )


def split_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    fields: Sequence[str],
    output_dir: str,
    fmt: str = "parquet",
    empty_label: str = DEFAULT_EMPTY_LABEL,
    blank_policy: str = "group",
    label_style: str = "pairs",
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the streaming split; returns the running query."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.load(source_dir)
    flagged = _flag(stream, list(fields), empty_label, blank_policy, label_style)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # rows and counts come from one evaluation
        kept = batch.filter(F.col(EXCLUDED).isNull()).drop(EXCLUDED)
        kept.hint("rebalance", LABEL).write.mode("overwrite").partitionBy(LABEL).parquet(
            f"{output_dir}/data/batch_id={batch_id}"
        )
        counts = batch.groupBy(LABEL, EXCLUDED).agg(F.count(F.lit(1)).alias("rows"))
        counts.write.mode("overwrite").parquet(f"{output_dir}/manifest_log/batch_id={batch_id}")
        batch.unpersist()

    # the same folders always get the same state, in any process
    place = hashlib.sha256(f"{source_dir}\n{output_dir}".encode()).hexdigest()[:32]
    location = checkpoint or f"{checkpoint_dir(spark)}/split_stream/{place}"
    writer = flagged.writeStream.foreachBatch(write_batch).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def manifest(spark: SparkSession, output_dir: str) -> DataFrame:
    """Running totals: split_label, row_count (kept rows) and excluded rows by reason."""
    log = spark.read.parquet(f"{output_dir}/manifest_log")
    kept = log.filter(F.col(EXCLUDED).isNull()).groupBy(LABEL).agg(F.sum("rows").cast("long").alias("row_count"))
    return kept.orderBy(LABEL)


def reconciliation(spark: SparkSession, output_dir: str) -> DataFrame:
    """input_rows, output_rows, excluded_rows over every batch so far."""
    log = spark.read.parquet(f"{output_dir}/manifest_log")
    return log.agg(
        F.sum("rows").cast("long").alias("input_rows"),
        F.coalesce(F.sum(F.when(F.col(EXCLUDED).isNull(), F.col("rows"))), F.lit(0)).cast("long").alias("output_rows"),
        F.coalesce(F.sum(F.when(F.col(EXCLUDED).isNotNull(), F.col("rows"))), F.lit(0)).cast("long").alias("excluded_rows"),
    )
