"""Row reconciliation and run reports.

``flagged`` plans carry ``_excluded`` (NULL for kept rows, else a reason), so
input = output + excluded is one aggregate over one scan, or an
``Observation`` riding along the write (no extra pass).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

EXCLUDED = "_excluded"
#: The reasons for which the operators and sinks leave rows out.
REASONS = ("blank", "out_of_scope", "skipped_existing")


def reconcile_flagged(flagged: DataFrame) -> DataFrame:
    """K9/K10 as one row: input_rows, output_rows, excluded_rows, excluded_by
    (reason -> rows), balanced."""
    by_reason = flagged.groupBy(EXCLUDED).agg(F.count(F.lit(1)).alias("_n"))
    return by_reason.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("input_rows"),
        F.coalesce(F.sum(F.when(F.col(EXCLUDED).isNull(), F.col("_n"))), F.lit(0)).cast("long").alias("output_rows"),
        F.coalesce(F.sum(F.when(F.col(EXCLUDED).isNotNull(), F.col("_n"))), F.lit(0)).cast("long").alias("excluded_rows"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col(EXCLUDED).isNotNull(), F.struct(F.col(EXCLUDED), F.col("_n").cast("long")))))
        ).alias("excluded_by"),
    ).withColumn("balanced", F.col("input_rows") == F.col("output_rows") + F.col("excluded_rows"))


def _counters() -> list:
    why = F.col(EXCLUDED)
    return [
        *[F.count(F.when(why == reason, 1)).alias(f"excluded_{reason}") for reason in REASONS],
        F.count(F.when(why.isNotNull() & ~why.isin(*REASONS), 1)).alias("excluded_other"),
        F.count(F.lit(1)).alias("input_rows"),
        F.count(F.when(why.isNull(), 1)).alias("output_rows"),
        F.count(F.when(why.isNotNull(), 1)).alias("excluded_rows"),
    ]


def observe_flagged(flagged: DataFrame, name: str = "reconciliation") -> tuple[DataFrame, Observation]:
    """Attach the reconciliation counts to a plan, one counter a reason among them; read them after its action."""
    obs = Observation(name)
    return flagged.observe(obs, *_counters()), obs


def observed_counts(obs: Observation, flagged: DataFrame) -> dict[str, int]:
    """The counts of a finished action.

    Where adaptive execution finds that no row is left to write, it drops the
    plan and its counters with it; the rows are then counted by themselves.
    """
    try:
        return {k: int(n) for k, n in obs.get.items()}
    except Py4JJavaError:
        return {k: int(n) for k, n in flagged.agg(*_counters()).first().asDict().items()}


def excluded_by(counts: dict) -> dict[str, int]:
    """The reasons of observed counts that left rows out, with their rows."""
    return {k: int(n) for k, n in counts.items() if k.startswith("excluded_") and k != "excluded_rows" and n}


@dataclass
class Reconciliation:
    input_rows: int
    output_rows: int
    excluded_rows: int = 0

    @property
    def balanced(self) -> bool:
        return self.input_rows == self.output_rows + self.excluded_rows

    def warning(self) -> str | None:
        if self.balanced:
            return None
        return (
            f"{self.input_rows} rows came in, but {self.output_rows} went out and {self.excluded_rows} were left out"
        )


def reconcile_rows(input_rows: int, output_rows: int, excluded_rows: int = 0) -> Reconciliation:
    """K9."""
    return Reconciliation(int(input_rows), int(output_rows), int(excluded_rows))


@dataclass
class RunReport:
    operation: str
    started: datetime
    finished: datetime
    outputs: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    field_mapping: dict[str, str] = field(default_factory=dict)
    reconciliation: Reconciliation | None = None
    details: dict[str, int] = field(default_factory=dict)

    @property
    def status(self) -> str:
        """``failed`` with errors and no output, ``partial`` with both, else ``success``."""
        if self.errors and not self.outputs:
            return "failed"
        if self.errors:
            return "partial"
        return "success"


REPORT_SCHEMA = (
    "operation string, status string, started timestamp, finished timestamp, seconds double, "
    "outputs array<string>, warnings array<string>, errors array<string>, field_mapping string, "
    "input_rows long, output_rows long, excluded_rows long, balanced boolean, details map<string,bigint>"
)


def report_frame(spark: SparkSession, report: RunReport) -> DataFrame:
    """The run as one row of the run-metrics table."""
    rec = report.reconciliation
    row = (
        report.operation,
        report.status,
        report.started,
        report.finished,
        (report.finished - report.started).total_seconds(),
        list(report.outputs),
        list(report.warnings),
        list(report.errors),
        json.dumps(report.field_mapping, ensure_ascii=False),
        rec.input_rows if rec else None,
        rec.output_rows if rec else None,
        rec.excluded_rows if rec else None,
        rec.balanced if rec else None,
        {k: int(v) for k, v in report.details.items()},
    )
    return spark.createDataFrame([row], REPORT_SCHEMA)


def append_report(spark: SparkSession, report: RunReport, path: str) -> None:
    """Append the run to a Parquet run-metrics table (all runs kept)."""
    report_frame(spark, report).write.mode("append").parquet(path)
