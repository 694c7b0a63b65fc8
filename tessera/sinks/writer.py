"""Sinks: all groups in one write job, output names, existing-output policy,
size guards (K1-K8, F12, F13-F15).

* separate outputs (K1): ``write.partitionBy(label)`` after a ``REBALANCE``
  hint on the label, so AQE splits a label holding a third of the data into
  many tasks and packs small labels together — one job for every group;
* one combined output (K2): the rows with their label column;
* CSV (K3) writes nested values as JSON text; Parquet (K4) keeps them;
* ``existing``: ``rename`` probes ``name_2, name_3 ...`` through the Hadoop
  FileSystem, ``overwrite``, or ``skip`` (nothing written, reported).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.naming import number_collisions, render_template
from tessera.functions.values import casefold
from tessera.plans.reconcile import EXCLUDED, excluded_by, observe_flagged, observed_counts

# Largest table a spreadsheet output can hold.
MAX_OUTPUT_ROWS = 1_048_576
MAX_OUTPUT_COLUMNS = 16_384
#: Column (and folder) of an output's name.
OUTPUT = "output_name"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def unique_output_path(spark: SparkSession, path: str) -> str:
    """K5 RENAME: ``path`` if free, else ``path_2``, ``path_3`` ..."""
    if not path_exists(spark, path):
        return path
    stem, dot, ext = path.rpartition(".") if "." in path.rsplit("/", 1)[-1] else (path, "", "")
    index = 2
    while True:
        candidate = f"{stem}_{index}{dot}{ext}" if dot else f"{path}_{index}"
        if not path_exists(spark, candidate):
            return candidate
        index += 1


def json_nested(df: DataFrame) -> DataFrame:
    """array / map / struct columns as JSON text (for text sinks)."""
    nested = {
        f.name: F.to_json(F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    }
    return df.withColumns(nested) if nested else df


def check_output_size(manifest: DataFrame, columns: int, max_rows: int = MAX_OUTPUT_ROWS, max_columns: int = MAX_OUTPUT_COLUMNS) -> None:
    """K7 guard: raise when a group exceeds the row or column limit (reads the manifest)."""
    if columns > max_columns:
        raise ValueError(f"Output has {columns} columns; the limit is {max_columns}")
    too_big = oversized(manifest, max_rows).limit(1).collect()
    if too_big:
        raise ValueError(f"Group '{too_big[0]['split_label']}' has {too_big[0]['row_count']} rows; the limit is {max_rows}")


def oversized(manifest: DataFrame, max_rows: int = MAX_OUTPUT_ROWS) -> DataFrame:
    """K7: the groups that no single output of ``max_rows`` rows could hold."""
    return manifest.filter(F.col("row_count") > max_rows)


@dataclass
class WriteResult:
    path: str | None
    written: bool
    counts: dict | None
    warning: str | None = None
    #: Excluded rows by reason (``excluded_blank`` ...), those that left rows out.
    reasons: dict = field(default_factory=dict)


def _result(path: str, observed: dict, warning: str | None = None) -> WriteResult:
    counts = {k: observed[k] for k in ("input_rows", "output_rows", "excluded_rows")}
    return WriteResult(path, True, counts, warning, excluded_by(observed))


def write_split(
    flagged: DataFrame,
    path: str,
    fmt: str = "parquet",
    separate: bool = True,
    label: str = "split_label",
    existing: str = "rename",
    max_rows_per_file: int | None = None,
) -> WriteResult:
    """K1-K5, K7, K9: write every kept row of a flagged split in one job.

    ``flagged`` is ``Split.flagged`` (rows + label + ``_excluded``); the row
    reconciliation is observed during the same job.
    """
    spark = flagged.sparkSession
    mode = "error"
    if existing == "rename":
        path = unique_output_path(spark, path)
    elif existing == "overwrite":
        mode = "overwrite"
    elif existing == "skip":
        if path_exists(spark, path):
            return WriteResult(None, False, None, f"Skipped existing output: {path}")
    else:
        raise ValueError(f"Unknown existing-output policy: {existing}")
    observed, obs = observe_flagged(flagged)
    rows = observed.filter(F.col(EXCLUDED).isNull()).drop(EXCLUDED)
    if fmt == "csv":
        rows = json_nested(rows)
    if separate:
        rows = rows.hint("rebalance", label)
    writer = rows.write.mode(mode)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", int(max_rows_per_file))
    if separate:
        writer = writer.partitionBy(label)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unknown output format: {fmt}")
    return _result(path, observed_counts(obs, flagged))


def _written_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the outputs that ``path`` holds (a listing of folders)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    unquote = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    folders = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return [unquote(name.partition("=")[2]) for name in folders if name.startswith(f"{OUTPUT}=")]


def write_named(
    flagged: DataFrame,
    names: DataFrame,
    path: str,
    fmt: str = "parquet",
    label: str = "split_label",
    existing: str = "rename",
    max_rows_per_file: int | None = None,
    keep_label: bool = True,
) -> tuple[WriteResult, DataFrame]:
    """K1, K5, K8: every group under its own output name, the label kept as a column unless told otherwise.

    ``names`` is the manifest with ``output_name``.  Group by group: an output
    that exists gets a new name (``rename``), is replaced (``overwrite``) or is
    left alone, its rows excluded as ``skipped_existing`` (``skip``); others are
    written beside it.  Returns the manifest as written.
    """
    if existing not in ("rename", "overwrite", "skip"):
        raise ValueError(f"Unknown existing-output policy: {existing}")
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"Unknown output format: {fmt}")
    spark = flagged.sparkSession
    there = [] if existing == "overwrite" else _written_names(spark, path)
    if there:
        old = spark.createDataFrame([(n, -1 - i) for i, n in enumerate(there)], f"{OUTPUT} string, part_no long")
        if existing == "rename":  # what exists comes first, so new groups take the next free names
            both = names.unionByName(old, allowMissingColumns=True)
            names = number_collisions(both, OUTPUT, "part_no").filter(F.col("part_no") > 0)
        else:
            folded = old.select(casefold(F.col(OUTPUT)).alias("_same"), F.lit(True).alias("_skipped")).distinct()
            marked = names.withColumn("_same", casefold(F.col(OUTPUT))).join(folded, "_same", "left")
            names = marked.withColumn("_skipped", F.coalesce("_skipped", F.lit(False))).drop("_same")
    if "_skipped" not in names.columns:
        names = names.withColumn("_skipped", F.lit(False))
    warning = f"Outputs that exist were skipped in {path}" if existing == "skip" and there else None
    if there and names.filter("not _skipped").isEmpty():
        n = flagged.count()
        counts = {"input_rows": n, "output_rows": 0, "excluded_rows": n}
        return WriteResult(path, False, counts, warning, {"excluded_skipped_existing": n} if n else {}), names
    # groups with the same label text share one output
    target = names.groupBy(label).agg(F.min_by(F.struct(OUTPUT, "_skipped"), "part_no").alias("_to"))
    rows = flagged.join(target.withColumnRenamed(label, "_label"), F.col(label) == F.col("_label"), "left").drop("_label")
    reason = F.when(F.col(EXCLUDED).isNull() & F.col("_to._skipped"), F.lit("skipped_existing")).otherwise(F.col(EXCLUDED))
    rows = rows.withColumn(EXCLUDED, reason).withColumn(OUTPUT, F.col(f"_to.{OUTPUT}")).drop("_to")
    observed, obs = observe_flagged(rows)
    kept = observed.filter(F.col(EXCLUDED).isNull()).drop(EXCLUDED)
    if not keep_label:
        kept = kept.drop(label)
    if fmt == "csv":
        kept = json_nested(kept)
    writer = kept.hint("rebalance", OUTPUT).write.partitionBy(OUTPUT)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", int(max_rows_per_file))
    if existing == "overwrite":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    return _result(path, observed_counts(obs, rows), warning), names


def output_names(
    manifest: DataFrame,
    template: str = "{original_name}_{split_value}",
    values: dict | None = None,
    split_value: str = "split_label",
    max_length: int | None = None,
) -> DataFrame:
    """K8 with F15 + K6: one path-safe output name per group; names that coincide
    case-insensitively are numbered ``_2``, ``_3`` in part order."""
    columns = {"split_value": split_value, "part_no": "part_no", "total_parts": "total_parts", "row_count": "row_count"}
    for extra in ("split_field", "hierarchy_path", "level1_value", "level2_value", "level3_value"):
        if extra in manifest.columns:
            columns[extra] = extra
    named = manifest.withColumn("_name", render_template(template, columns, values))
    return number_collisions(named, "_name", "part_no", out="output_name", max_length=max_length).drop("_name")
