"""Task-level plans: split, merge and join runs from a configuration.

A task reads its sources (per-source fault isolation: a source whose schema
cannot be resolved is reported and the rest proceed), applies renaming and
cleaning, runs one operator, writes every output in one job per dataset with
the row reconciliation observed during the write, and returns a
``RunReport`` (optionally appended to a run-metrics table).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from pathlib import PurePath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.values import to_number
from tessera.operators import aggregate as A
from tessera.operators import dedupe as D
from tessera.operators import hierarchy as H
from tessera.operators import joins as J
from tessera.operators import split as X
from tessera.operators import stack as U
from tessera.operators.cleaning import CleaningOptions, clean, rename_fields
from tessera.operators.ordinals import with_source_ordinal
from tessera.plans.reconcile import RunReport, append_report, excluded_by, reconcile_rows
from tessera.sinks.writer import MAX_OUTPUT_COLUMNS, MAX_OUTPUT_ROWS, check_output_size, output_names, write_named, write_split
from tessera.session import checkpoint_dir
from tessera.sources.files import delimited_grid
from tessera.sources.grid import TableStructure, read_grid_table

ORDINAL = "_ordinal"


@dataclass
class SourceSpec:
    """One input table.  ``format``: parquet, csv, tsv, json or orc.

    ``order_by`` gives row order for first/last semantics; Parquet sources
    default to (file, row in file) through ``_metadata``, delimited ones to the
    line.  ``structure`` says where a delimited table's header and data stand
    (the first row by default); ``options`` may hold ``sep`` and ``multiLine``.
    Columns of a delimited table that are numbers throughout become numbers
    unless ``infer_types`` is off.
    """

    path: str
    format: str = "parquet"
    table: str | None = None
    order_by: Sequence[str] | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    structure: TableStructure | None = None
    infer_types: bool = True

    @property
    def name(self) -> str:
        return self.table or PurePath(self.path).stem


@dataclass
class OutputSpec:
    directory: str
    format: str = "parquet"
    separate: bool = True
    existing: str = "rename"
    max_rows_per_file: int | None = None
    name: str = "result"
    #: Refuse outputs that no spreadsheet could hold; by default those of text formats, which one may open.
    spreadsheet_limits: bool | None = None

    @property
    def limited(self) -> bool:
        return self.format in ("csv", "tsv") if self.spreadsheet_limits is None else self.spreadsheet_limits


@dataclass
class Loaded:
    spec: SourceSpec
    df: DataFrame
    order: list
    #: Where the rows are read from, if that is not the source itself.
    staged: str | None = None


def _typed(df: DataFrame) -> DataFrame:
    """Text columns that hold nothing but numbers as numbers (one aggregate over the table)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    checks = []
    for k, name in enumerate(text):
        cell = F.col(f"`{name}`")
        checks += [
            F.count(cell).alias(f"n{k}"),
            F.count(F.when(cell.rlike("^[+-]?[0-9]{1,18}$"), 1)).alias(f"i{k}"),
            F.count(to_number(cell, StringType())).alias(f"d{k}"),
        ]
    if not checks:
        return df
    found = df.agg(*checks).first()
    changed = {}
    for k, name in enumerate(text):
        if found[f"n{k}"] and found[f"i{k}"] == found[f"n{k}"]:
            changed[name] = F.col(f"`{name}`").try_cast("long")  # rows cut below may hold other text
        elif found[f"n{k}"] and found[f"d{k}"] == found[f"n{k}"]:
            changed[name] = to_number(F.col(f"`{name}`"), StringType())
    return df.withColumns(changed) if changed else df


def _delimited(spark: SparkSession, spec: SourceSpec, fmt: str) -> DataFrame:
    """A delimited file through the grid: header modes, ranges, bottom rows; the line number orders the rows."""
    sep = spec.options.get("sep") or ("\t" if fmt == "tsv" else None)
    multi_line = str(spec.options.get("multiLine", "false")).lower() == "true"
    grid = delimited_grid(spark, spec.path, sep, spec.name, multi_line)
    files = [r["source_file"] for r in grid.select("source_file").distinct().limit(2).collect()]
    if len(files) != 1:
        raise ValueError(f"{spec.path} is not one readable file; list its files one by one")
    structure = spec.structure or TableStructure(header_mode="row_number")
    table = read_grid_table(grid, files[0], spec.name, structure, row_no=ORDINAL)
    return _typed(table) if spec.infer_types else table


def load_sources(
    spark: SparkSession, specs: Sequence[SourceSpec], errors: list[str]
) -> list[Loaded]:
    """Each source is resolved on its own; failures become report errors."""
    loaded = []
    for spec in specs:
        try:
            fmt = spec.format.lower()
            order = list(spec.order_by) if spec.order_by else [ORDINAL]
            if fmt in ("csv", "tsv"):
                df = _delimited(spark, spec, fmt)
            else:
                df = spark.read.options(**dict(spec.options)).format(fmt).load(spec.path)
                if not spec.order_by and fmt != "parquet":
                    raise ValueError("order_by is required for sources without row numbers")
                if fmt == "parquet":
                    df = with_source_ordinal(df, ORDINAL)
            df.schema  # resolve now so a broken source fails here, not mid-run
            loaded.append(Loaded(spec, df, order))
        except Exception as error:  # noqa: BLE001 - reported, the run goes on
            errors.append(f"{spec.path}: {error}")
    return loaded


def _drop_ordinal(df: DataFrame) -> DataFrame:
    return df.drop(ORDINAL) if ORDINAL in df.columns else df


@dataclass
class SplitTask:
    sources: Sequence[SourceSpec]
    output: OutputSpec
    mode: str = "field"  # field | rows | parts | hierarchy | sheet
    fields: Sequence[str] = ()
    rows_per_part: int = 0
    balanced: bool = False
    parts: int = 0
    hierarchy_fields: Sequence[str] = ()
    hierarchy_filters: Mapping[str, object] = field(default_factory=dict)
    empty_label: str = "EMPTY"
    blank_policy: str = "group"
    label_style: str = "pairs"
    field_mapping: Mapping[str, str] = field(default_factory=dict)
    cleaning: CleaningOptions = field(default_factory=CleaningOptions)
    naming_template: str = "{original_name}_{split_value}"
    add_source_file: bool = False
    add_source_sheet: bool = False
    report_path: str | None = None


def _split_one(task: SplitTask, df: DataFrame, order) -> X.Split:
    if task.mode == "field":
        return X.split_by_fields(df, task.fields, order, task.empty_label, task.blank_policy, task.label_style)
    if task.mode == "rows":
        return X.split_fixed_rows(df, task.rows_per_part, order, task.balanced)
    if task.mode == "parts":
        return X.split_into_parts(df, task.parts, order)
    if task.mode == "hierarchy":
        return H.split_by_hierarchy(
            df, task.hierarchy_fields, task.hierarchy_filters, task.hierarchy_fields[-1], order,
            task.empty_label, task.blank_policy,
        )
    raise ValueError(f"Unknown split mode: {task.mode}")


def run_split(spark: SparkSession, task: SplitTask) -> RunReport:
    """Split every source; one write job per source holds all of its groups, each under its rendered name.

    ``sheet`` mode makes every source table one group of a single dataset.
    """
    started, errors, outputs, warnings = datetime.now(), [], [], []
    totals = dict.fromkeys(("input_rows", "output_rows", "excluded_rows"), 0)
    reasons: dict[str, int] = {}
    jobs = []
    for item in load_sources(spark, task.sources, errors):
        try:
            df = clean(rename_fields(item.df, task.field_mapping), task.cleaning, hidden=[ORDINAL])
            source = U.Source(item.spec.path, item.spec.name, df)
            df = U.with_provenance(source, task.add_source_file, task.add_source_sheet)
            jobs.append((item, df))
        except Exception as error:  # noqa: BLE001
            errors.append(f"{item.spec.path}: {error}")
    if task.mode == "sheet" and jobs:
        work = [(task.output.name, ", ".join(i.spec.path for i, _ in jobs), jobs)]
    else:
        work = [(i.spec.name, i.spec.path, [(i, df)]) for i, df in jobs]
    for name, path, members in work:
        try:
            raw = sum(i.df.count() for i, _ in members) if _drops_rows(task.cleaning) else None
            if task.mode == "sheet":
                split = X.split_by_table([(i.spec.name, _drop_ordinal(df)) for i, df in members])
            else:
                split = _split_one(task, members[0][1], members[0][0].order)
            manifest = output_names(split.manifest, task.naming_template, {"original_name": name})
            flagged = _drop_ordinal(split.flagged)
            if task.output.limited:
                check_output_size(manifest, len(flagged.columns) - 2, MAX_OUTPUT_ROWS, MAX_OUTPUT_COLUMNS)
            target = f"{task.output.directory}/{name}_{task.output.name}"
            if task.output.separate:
                res, manifest = write_named(
                    flagged, manifest, target, task.output.format, existing=task.output.existing,
                    max_rows_per_file=task.output.max_rows_per_file,
                )
            else:
                res = write_split(
                    flagged, target, task.output.format, False, existing=task.output.existing,
                    max_rows_per_file=task.output.max_rows_per_file,
                )
            if res.warning:
                warnings.append(res.warning)
            counts, why = res.counts, dict(res.reasons)
            if counts is None:  # one combined output that exists: every row stays out
                n = flagged.count()
                counts, why = {"input_rows": n, "output_rows": 0, "excluded_rows": n}, {"excluded_skipped_existing": n}
            if counts["excluded_rows"] and res.warning:
                warnings.append(f"{counts['excluded_rows']} rows of {path} excluded: skipped_existing")
            if raw is not None:  # rows that cleaning took out
                cleaned = raw - counts["input_rows"]
                counts = counts | {"input_rows": raw, "excluded_rows": counts["excluded_rows"] + cleaned}
                why["excluded_cleaning"] = cleaned
            for key in totals:
                totals[key] += counts[key]
            for key, n in excluded_by(why).items():
                reasons[key] = reasons.get(key, 0) + n
            if res.written:
                outputs.append(res.path)
                # K8: the manifest (groups, sizes, output names) next to the data
                listed = manifest.filter("not _skipped").drop("_skipped") if "_skipped" in manifest.columns else manifest
                listed.withColumn("source", F.lit(path)).write.mode("overwrite").parquet(f"{res.path}_manifest")
        except Exception as error:  # noqa: BLE001
            errors.append(f"{path}: {error}")
    rec = reconcile_rows(*totals.values())
    if rec.warning():
        warnings.append(rec.warning())
    report = RunReport("split", started, datetime.now(), outputs, warnings, errors, dict(task.field_mapping), rec, reasons)
    if task.report_path:
        append_report(spark, report, task.report_path)
    return report


def _drops_rows(options: CleaningOptions) -> bool:
    return options.drop_empty_rows or options.drop_duplicate_rows


def _staged(loaded: list[Loaded], errors: list[str]) -> list[Loaded]:
    """K12 while running: every source copied by a job of its own to the shared folder.

    A source that cannot be read to its end becomes a report error; the others
    are read from their copies from now on.
    """
    out = []
    for item in loaded:
        spark = item.df.sparkSession
        place = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
        try:
            item.df.write.parquet(place)
            out.append(replace(item, df=spark.read.schema(item.df.schema).parquet(place), staged=place))
        except Exception as error:  # noqa: BLE001
            errors.append(f"{item.spec.path}: {str(error)[:500]}")
    return out


def _isolated(run, loaded: list[Loaded], errors: list[str], least: int = 1):
    """Run over all sources; if that fails, once more over the copies of those that can be read."""
    try:
        return run(loaded)
    except Exception:  # noqa: BLE001
        good = _staged(loaded, errors)
        if len(good) == len(loaded) or len(good) < least:
            raise
        return run(good)


@dataclass
class MergeTask:
    sources: Sequence[SourceSpec]
    output: OutputSpec
    mode: str = "stack"  # stack | same_name | catalog | aggregate
    strategy: str = U.ALIGN
    dedupe_mode: str = D.NONE
    dedupe_fields: Sequence[str] = ()
    dedupe_keep: str = "first"
    group_fields: Sequence[str] = ()
    value_fields: Sequence[str] = ()
    method: str = "sum"
    target_table: str | None = None
    conflict: str = U.RENAME
    add_source_file: bool = True
    add_source_sheet: bool = True
    report_path: str | None = None


def run_merge(spark: SparkSession, task: MergeTask) -> RunReport:
    """U1-U8, D1-D2, A1-A7 as one run.

    ``stack`` and ``aggregate`` write one dataset.  ``same_name`` and ``catalog``
    write every table under its own name (``output_name=...`` folders) with its
    own columns and types: sources of one schema are scanned together and written
    by one job, so the plans grow with the schemas, not with the files.

    Rows are counted where they pass: read from each source, stacked, left by
    the dedupe, written.  What the dedupe or the aggregation removes, or a name
    conflict leaves out, is excluded by that reason; a row lost anywhere else
    unbalances the report.
    """
    started, errors = datetime.now(), []
    report = _isolated(
        lambda loaded: _merge(spark, task, loaded, started, errors), load_sources(spark, task.sources, errors), errors
    )
    if task.report_path:
        append_report(spark, report, task.report_path)
    return report


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _scan_key(item: Loaded) -> tuple:
    """Sources with equal keys can be scanned as one."""
    if item.spec.format.lower() != "parquet" or item.spec.order_by:
        return (id(item),)
    return ("parquet", item.df.schema.json(), tuple(sorted(dict(item.spec.options).items())))


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as ``_metadata.file_path`` writes it (local ones with one slash)."""
    given = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = given.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:/", store.makeQualified(given).toUri().toString()).rstrip("/")


def scan_together(spark: SparkSession, items: Sequence[tuple[str, Loaded]], label: str) -> DataFrame:
    """The rows of sources with one schema, each with its ``label``: one scan over all their paths.

    A row finds its source by its file, or by the nearest folder above it that is
    a source; a source that is listed under two names gives its rows to both.
    """
    first = items[0][1]
    if len(items) == 1:
        return first.df.withColumn(label, F.lit(items[0][0]))
    places = [(_qualified(spark, item.staged or item.spec.path), name) for name, item in items]
    known = spark.createDataFrame(places, "_place string, _name string").groupBy("_place").agg(F.collect_list("_name").alias("_names"))
    deepest = max(path.count("/") for path, _ in places)
    least = min(path.count("/") for path, _ in places)
    paths = list(dict.fromkeys(item.staged or item.spec.path for _, item in items))
    df = spark.read.options(**dict(first.spec.options)).schema(first.df.drop(ORDINAL).schema).parquet(*paths)
    df = with_source_ordinal(df, ORDINAL)
    file = F.regexp_replace(F.col(f"{ORDINAL}.file"), "^file:/+", "file:/")
    levels = [F.substring_index(file, "/", n + 1) for n in range(deepest, least - 1, -1)]
    # one row a source
    found = F.broadcast(known.agg(F.map_from_entries(F.collect_list(F.struct("_place", "_names"))).alias("_sources")))
    df = df.crossJoin(found)  # with one row
    named = F.coalesce(*[F.element_at("_sources", level) for level in levels])
    return df.withColumn(label, F.explode(named)).drop("_sources")


def _write_tables(
    spark: SparkSession, output: OutputSpec, groups: Sequence[tuple[Sequence[str], DataFrame]]
) -> tuple[str, dict, list[str], list[dict], bool]:
    """Write tables under their names, each group of them (one schema, rows with ``split_label``) by one job.

    Returns the folder, the summed counts, warnings, rows by table and whether anything was written.
    """
    target = f"{output.directory}/{output.name}"
    total: dict[str, int] = {}
    warnings, manifest, written, part = [], [], False, 0
    plans = []
    for names, df in groups:
        rows = {r["split_label"]: r["count"] for r in df.groupBy("split_label").count().collect()}  # one row a table
        listed = []
        for name in names:
            part += 1
            listed.append((name, part, rows.get(name, 0)))
        listed = spark.createDataFrame(listed, "split_label string, part_no long, row_count long")
        if output.limited:
            check_output_size(listed, len(df.columns) - 1, MAX_OUTPUT_ROWS, MAX_OUTPUT_COLUMNS)
        plans.append((listed, df))
    for listed, df in plans:
        named = listed.withColumn("output_name", F.col("split_label"))
        flagged = df.withColumn("_excluded", F.lit(None).cast("string"))
        res, done = write_named(
            flagged, named, target, output.format, existing=output.existing, max_rows_per_file=output.max_rows_per_file,
            keep_label=False,
        )
        written = written or res.written
        if res.warning and res.warning not in warnings:
            warnings.append(res.warning)
        for key, n in (res.counts | res.reasons).items():
            total[key] = total.get(key, 0) + n
        manifest += [r.asDict() for r in done.select("split_label", "part_no", "row_count", "output_name", "_skipped").collect()]
    return target, total, warnings, manifest, written


def _merge_tables(spark: SparkSession, task: MergeTask, loaded: list[Loaded], started, errors: list[str]) -> RunReport:
    """Every table an output of its own schema."""
    sources = [U.Source(item.spec.path, item.spec.name, item.df) for item in loaded]
    at = {id(s): k for k, s in enumerate(sources)}
    excluded: dict[str, int] = {}
    groups: list[tuple[list[str], DataFrame]] = []
    if task.mode == "catalog":
        targets = U.catalog_targets(sources, task.conflict)
        used = [at[id(s)] for _, s in targets]
        by_schema: dict[tuple, list[tuple[str, Loaded]]] = {}
        for name, source in targets:
            item = loaded[at[id(source)]]
            by_schema.setdefault(_scan_key(item), []).append((name, item))
        for members in by_schema.values():
            groups.append(([n for n, _ in members], _drop_ordinal(scan_together(spark, members, "split_label"))))
        counted = None
    else:
        wanted = task.target_table.casefold() if task.target_table else None
        used = [k for k, s in enumerate(sources) if wanted in (None, s.table.casefold())]
        before: list[Observation] = []

        def dedupe(df):
            df, seen = _counted(df, f"stacked_{len(before)}")
            before.append(seen)
            if task.dedupe_mode == D.ALL:
                return D.dedupe(_drop_ordinal(df), D.ALL)
            order = [ORDINAL] if ORDINAL in df.columns else None
            return D.dedupe(df, task.dedupe_mode, task.dedupe_fields, task.dedupe_keep, order)

        tables = U.consolidate_same_name(
            sources, task.strategy, task.target_table, None if task.dedupe_mode == D.NONE else dedupe,
            task.add_source_file, task.add_source_sheet,
        )
        groups = [([name], _drop_ordinal(df).withColumn("split_label", F.lit(name))) for name, df in tables]
        counted = before
    target, counts, warnings, manifest, written = _write_tables(spark, task.output, groups)
    rows_of = [item.df.count() for item in loaded]  # footers only
    total = sum(rows_of)
    left_out = sum(n for k, n in enumerate(rows_of) if k not in set(used))
    if left_out:
        excluded["table_left_out"] = left_out
    stacked = total - left_out if task.mode != "catalog" else None
    if stacked is not None and counted and stacked > counts.get("input_rows", 0):
        excluded["duplicate"] = stacked - counts["input_rows"]
    excluded |= {k.removeprefix("excluded_"): n for k, n in excluded_by(counts).items()}
    rec = reconcile_rows(total, counts.get("output_rows", 0), sum(excluded.values()))
    if written:
        # K8: rows per source and the outputs next to the data
        spark.createDataFrame(
            [(s.file, s.table, n) for s, n in zip(sources, rows_of)], "source_file string, source_table string, rows long"
        ).write.mode("overwrite").parquet(f"{target}_sources")
        kept = [(r["split_label"], r["part_no"], r["row_count"], r["output_name"]) for r in manifest if not r["_skipped"]]
        spark.createDataFrame(kept, "split_label string, part_no long, row_count long, output_name string").write.mode(
            "overwrite"
        ).parquet(f"{target}_manifest")
    warnings += [w for w in [rec.warning()] if w]
    return RunReport(
        "merge", started, datetime.now(), [target] if written else [], warnings, errors, {}, rec,
        {f"excluded_{reason}": n for reason, n in excluded.items()},
    )


def _merge(spark: SparkSession, task: MergeTask, loaded: list[Loaded], started, errors: list[str]) -> RunReport:
    if task.mode in ("catalog", "same_name"):
        return _merge_tables(spark, task, loaded, started, errors)
    sources, reads = [], []
    for item in loaded:
        df, seen = _counted(item.df, f"input_{len(reads)}")
        reads.append(seen)
        sources.append(U.Source(item.spec.path, item.spec.name, df))
    order = [ORDINAL] if all(ORDINAL in s.df.columns for s in sources) else None
    stacked: list[Observation] = []
    single: list[Observation] = []

    def dedupe(df):
        df, seen = _counted(df, f"stacked_{len(stacked)}")
        stacked.append(seen)
        if task.dedupe_mode == D.ALL:
            # the row ordinal is not data: identical rows from one file are duplicates
            df = D.dedupe(_drop_ordinal(df), D.ALL)
        else:
            df = D.dedupe(df, task.dedupe_mode, task.dedupe_fields, task.dedupe_keep, order)
        df, seen = _counted(df, f"single_{len(single)}")
        single.append(seen)
        return df

    merged = dedupe(U.stack_sources(sources, task.strategy, task.add_source_file, task.add_source_sheet))
    if task.mode == "aggregate":
        merged = A.aggregate(merged, task.group_fields, task.value_fields, task.method)
    flagged = _drop_ordinal(merged).withColumns({"split_label": F.lit(task.output.name), "_excluded": F.lit(None).cast("string")})
    if task.output.limited:
        _check_whole(flagged, task.output.name)
    res = write_split(flagged, f"{task.output.directory}/{task.output.name}", task.output.format, task.output.separate, existing=task.output.existing)
    excluded: dict[str, int] = {}
    if res.written:
        # rows were counted during the write
        rows_of = [int(seen.get.get("rows", 0)) for seen in reads]
        per_source = [(s.file, s.table, n) for s, n in zip(sources, rows_of)]
        rows_in = [sum(int(o.get.get("rows", 0)) for o in seen) for seen in (stacked, single)]
        if stacked and rows_in[0] > rows_in[1]:
            excluded["duplicate"] = rows_in[0] - rows_in[1]
        if task.mode == "aggregate":
            excluded["aggregated"] = rows_in[1] - res.counts["output_rows"]
        # K8: rows per source next to the merged output
        spark.createDataFrame(per_source, "source_file string, source_table string, rows long").write.mode(
            "overwrite"
        ).parquet(f"{res.path}_sources")
        rec = reconcile_rows(sum(rows_of), res.counts["output_rows"], sum(excluded.values()))
    else:
        n = sum(item.df.count() for item in loaded)
        excluded["skipped_existing"] = n
        rec = reconcile_rows(n, 0, n)
    warnings = [w for w in (res.warning, rec.warning()) if w]
    return RunReport(
        "merge", started, datetime.now(), [res.path] if res.written else [], warnings, errors, {}, rec,
        {f"excluded_{reason}": n for reason, n in excluded.items()},
    )


def _check_whole(flagged: DataFrame, name: str) -> None:
    """K7 for a run with one output."""
    one = flagged.agg(F.count(F.lit(1)).alias("row_count")).withColumn("split_label", F.lit(name))
    check_output_size(one, len(flagged.columns) - 2, MAX_OUTPUT_ROWS, MAX_OUTPUT_COLUMNS)


@dataclass
class JoinTask:
    sources: Sequence[SourceSpec]
    output: OutputSpec
    spec: J.JoinSpec | None = None
    side_by_side: bool = False
    prefix: bool = False
    gap: int = 0
    field_mapping: Mapping[str, str] = field(default_factory=dict)
    cleaning: CleaningOptions = field(default_factory=CleaningOptions)
    report_path: str | None = None


def run_join(spark: SparkSession, task: JoinTask) -> RunReport:
    """J1-J17 as one run over two or more inputs (left fold or side by side).

    The report's input is the main table's rows, its output the rows written;
    a join may make or lose rows by design, which the diagnostics of each step
    (``details``) explain.
    """
    started, errors = datetime.now(), []
    loaded = load_sources(spark, task.sources, errors)
    if len(loaded) < 2:
        errors.append("A join needs at least two readable inputs")
        return RunReport("join", started, datetime.now(), [], [], errors)
    report = _isolated(lambda items: _join(spark, task, items, started, errors), loaded, errors, least=2)
    if task.report_path:
        append_report(spark, report, task.report_path)
    return report


def _join(spark: SparkSession, task: JoinTask, loaded: list[Loaded], started, errors: list[str]) -> RunReport:
    frames = [clean(rename_fields(item.df, task.field_mapping), task.cleaning, hidden=[ORDINAL]) for item in loaded]
    orders = [item.order for item in loaded]
    diag, steps = None, []
    if task.side_by_side:
        labels = [item.spec.name for item in loaded]
        result = J.side_by_side(frames, orders, labels, task.prefix, task.gap, hidden=(ORDINAL,))
    elif len(frames) == 2:
        # J13 diagnostics are observed during the write
        joined = J.key_join(frames[0], frames[1], task.spec, orders[0], orders[1])
        steps = [joined]
        result, diag = joined.observed()
        result = result.drop(*[c for c in result.columns if c.startswith(ORDINAL)])
    else:
        result, steps = J.chain_join_steps(frames, task.spec, orders)
        result = result.drop(*[c for c in result.columns if c.startswith(ORDINAL)])
    flagged = result.withColumn("split_label", F.lit(task.output.name)).withColumn("_excluded", F.lit(None).cast("string"))
    if task.output.limited:
        _check_whole(flagged, task.output.name)
    res = write_split(flagged, f"{task.output.directory}/{task.output.name}", task.output.format, False, existing=task.output.existing)
    rec, details = None, {}
    if res.written:
        rec = reconcile_rows(frames[0].count(), res.counts["output_rows"])
        if diag is not None:
            details = dict(diag.get) | {"duplicates": steps[0].duplicates.first()["duplicates"]}
        elif steps:
            for k, step in enumerate(steps, 1):
                details |= {f"step{k}_{name}": n for name, n in step.diagnostics.first().asDict().items()}
    return RunReport(
        "join", started, datetime.now(), [res.path] if res.written else [], [res.warning] if res.warning else [],
        errors, dict(task.field_mapping), rec, details,
    )
