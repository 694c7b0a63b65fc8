"""File sources: collection, inventory, delimited scans, grids of delimited
files, table selection (S1-S3, S10, S12).

Listing goes through the Hadoop file system (names and sizes only), because
Spark's file index skips names starting with ``_`` or ``.``, which the table
semantics being reproduced keep.  An inventory reads the text files, to tell
damaged ones.

Delimited files are read in splits, those with line feeds inside quotes too: a
line maps "inside quotes or not" before it to the same after it, so each split is
first read from both states, the states at the splits' beginnings follow by a
prefix over the splits (one row each), and only records that cross a boundary are
put together from pieces.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import sys
from collections.abc import Sequence
from pathlib import PurePath
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import casefold
from tessera.sources.grid import GRID_SCHEMA

# Accepted file extensions.
SPREADSHEET_EXTENSIONS = (".xlsx", ".xlsm", ".xls", ".xlsb")
TEXT_EXTENSIONS = (".csv", ".tsv")


def _listed(spark: SparkSession, paths: Sequence[str], recursive: bool) -> list[tuple[str, int, int]]:
    """(path, length, modified in ms) of all files, names with a leading ``_`` or ``.`` too (Spark's own listing hides them)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        given = jvm.org.apache.hadoop.fs.Path(path)
        store = given.getFileSystem(conf)
        found = store.globStatus(given)
        if not found:
            raise FileNotFoundError(path)
        waiting = [(status, True) for status in found]
        while waiting:
            status, inside = waiting.pop()
            if status.isFile():
                out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
            elif inside:
                waiting += [(s, recursive) for s in store.listStatus(status.getPath())]
    return out


def collect_input_files(
    spark: SparkSession,
    paths: Sequence[str],
    recursive: bool = False,
    include_text_files: bool = True,
    ignore_hidden: bool = True,
    ignore_temp_files: bool = True,
    name_contains: str = "",
    name_excludes: str = "",
) -> DataFrame:
    """(path, name, extension, length, modified) of the accepted files,
    deduped by case-folded path and sorted by it."""
    extensions = list(SPREADSHEET_EXTENSIONS) + (list(TEXT_EXTENSIONS) if include_text_files else [])
    listing = spark.createDataFrame(
        _listed(spark, paths, recursive), "path string, length long, modified_ms long"
    ).select("path", "length", F.timestamp_millis("modified_ms").alias("modified"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    files = listing.withColumn("name", name).withColumn("extension", ext).filter(F.col("extension").isin(extensions))
    if ignore_temp_files:
        files = files.filter(~F.col("name").startswith("~$"))
    if ignore_hidden:
        files = files.filter(~F.col("name").startswith("."))
    folded = casefold(F.col("name"))
    if name_contains:
        files = files.filter(folded.contains(name_contains.casefold()))
    if name_excludes:
        files = files.filter(~folded.contains(name_excludes.casefold()))
    files = files.withColumn("_key", casefold(F.col("path")))
    files = files.groupBy("_key").agg(F.max_by(F.struct("path", "name", "extension", "length", "modified"), "path").alias("f"))
    return files.select("_key", "f.*").orderBy("_key").drop("_key")


def _probe(limit: int | None):
    """What is wrong with each text file, or with its first ``limit`` bytes (null: nothing)."""

    def damage_of(path: str) -> str | None:
        try:
            uri = quote(re.sub("^(file):/+", "\\1:///", path), safe="/:")
            store, place = fs.FileSystem.from_uri(uri)
            decoder, left = codecs.getincrementaldecoder("utf-8")(), limit
            with store.open_input_stream(place, compression=None) as stream:
                while left is None or left > 0:
                    part = stream.read(1 << 20 if left is None else min(left, 1 << 20))
                    if not part:
                        decoder.decode(b"", final=True)
                        break
                    if b"\0" in part:
                        return "damaged: holds null bytes"
                    decoder.decode(part)
                    left = None if left is None else left - len(part)
        except (OSError, ValueError) as error:
            return f"damaged: {error}"
        return None

    def run(batches):
        for batch in batches:
            kinds = zip(batch.column("path").to_pylist(), batch.column("extension").to_pylist(), strict=True)
            damage = [damage_of(path) if extension in TEXT_EXTENSIONS else None for path, extension in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(damage, pa.string())], names=[*batch.schema.names, "damage"])

    return run


def inventory(spark: SparkSession, files: DataFrame, probe_bytes: int | None = None) -> DataFrame:
    """One record per file with its tables and a status.

    Delimited files hold one visible table named after the file stem; one that
    cannot be opened, or is no UTF-8 text, gets status ``error`` and a warning
    instead of failing the scan.  So do spreadsheet containers, which have no
    codec here.  Files are read to their end (a file a row, spread over tasks);
    with ``probe_bytes`` only their beginning is, and the status of those that
    look well is ``probed`` instead of ``ready``.
    """
    probed = T.StructType([*files.schema.fields, T.StructField("damage", T.StringType())])
    spread = max(1, min(files.count(), 8 * spark.sparkContext.defaultParallelism))
    files = files.repartition(spread, "path").mapInArrow(_probe(probe_bytes), probed).orderBy("path")
    well = "ready" if probe_bytes is None else "probed"
    stem = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1)
    text = F.col("extension").isin(*TEXT_EXTENSIONS)
    table = F.struct(stem.alias("name"), F.lit("visible").alias("state"))
    return files.select(
        "path",
        "name",
        "extension",
        "length",
        "modified",
        F.when(text & F.col("damage").isNull(), F.array(table))
        .otherwise(F.array().cast("array<struct<name:string,state:string>>"))
        .alias("tables"),
        F.when(text & F.col("damage").isNull(), F.lit(well)).otherwise(F.lit("error")).alias("status"),
        F.when(text, F.col("damage"))
        .otherwise(F.lit("no spreadsheet codec: land the cells in the grid schema"))
        .alias("warning"),
    )


def _separator(path: str, sep: str | None) -> str:
    if sep:
        return sep
    return "\t" if PurePath(path).suffix.casefold() == ".tsv" else ","


def read_delimited(
    spark: SparkSession,
    path: str,
    header: bool = True,
    infer_schema: bool = True,
    sep: str | None = None,
    schema=None,
) -> DataFrame:
    """S3: a ``.csv`` / ``.tsv`` table; separator from the extension; without a
    header the columns are ``Column_1..n``.  Malformed rows are kept
    (PERMISSIVE) instead of failing the read."""
    reader = spark.read.option("sep", _separator(path, sep)).option("header", str(header).lower()).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", str(infer_schema).lower())
    df = reader.csv(path)
    if not header:
        df = df.toDF(*[f"Column_{i}" for i in range(1, len(df.columns) + 1)])
    return df


_CELL = pa.struct([("kind", pa.string()), ("text", pa.string())])
#: Lines as a reader of whole files sees them: each with its end (line feed, carriage return or both).
_UNIT = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)")


def _cells(text: str, sep: str) -> list:
    """The cells of one record; an empty field is a missing cell."""
    csv.field_size_limit(sys.maxsize)
    record = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])
    return [None if field == "" else {"kind": "string", "text": field} for field in record]


def quoted_after(line: str, sep: str, quoted: bool) -> bool:
    """Whether the end of ``line`` is inside quotes, if its beginning is (``quoted``) or is not.

    A quote opens a field only as its first character, a doubled one inside
    quotes is text, and what follows a closing quote belongs to the field.
    """
    if '"' not in line:
        return quoted
    at, n = 0, len(line)
    while True:
        if quoted:
            at = line.find('"', at) + 1
            if not at:
                return True
            if line.startswith('"', at):
                at += 1
                continue
            quoted = False
        elif line.startswith('"', at):
            quoted, at = True, at + 1
            continue
        at = line.find(sep, at) + 1  # the next field
        if not at or at > n:
            return False


def _units(value: str) -> list[str]:
    line = value + "\n"
    return [line] if "\r" not in value else _UNIT.findall(line)


def _states(sep: str):
    """One row a split: for either state at its beginning, the state at its end and the records that begin in it."""

    def run(batches):
        place, ends, begun, out = None, [], [], []
        for batch in batches:
            for file, start, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, start) != place:
                    if place is not None:
                        out.append((*place, *ends, *begun))
                    place, ends, begun = (file, start), [False, True], [0, 0]
                    value = value.removeprefix("\ufeff") if start == 0 else value
                for unit in _units(value):
                    for k in (0, 1):
                        begun[k] += not ends[k]
                    if '"' in unit:
                        ends = [quoted_after(unit, sep, e) for e in ends]
        if place is not None:
            out.append((*place, *ends, *begun))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        names = ["source_file", "start", "end0", "end1", "n0", "n1"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _beginnings(splits):
    """The state and the number of records in front of each split of a file."""
    splits = splits.sort_values("start")
    quoted, records, out = False, 0, []
    for r in splits.itertuples():
        out.append((r.source_file, r.start, quoted, records))
        records += r.n1 if quoted else r.n0
        quoted = bool(r.end1 if quoted else r.end0)
    return type(splits)(out, columns=["source_file", "start", "quoted", "records"])


def _split_records(sep: str):
    """Records that lie in one split as cells, the others as numbered pieces of text."""

    def run(batches):
        place, state, number, held, whole = None, False, 0, [], True
        for batch in batches:
            rows = []

            def done(complete, rows=rows):
                if held:
                    text = "".join(held)
                    piece = None if complete and whole else text
                    rows.append((place[0], number, _cells(text, sep) if piece is None else None, place[1], piece))

            for file, start, value, quoted, records in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, start) != place:
                    done(False if state else True)
                    place, state, number, held, whole = (file, start), quoted, records, [], not quoted
                for unit in _units(value):
                    if not state:
                        done(True)
                        number += 1
                        held, whole = [], True
                        if number == 1:
                            unit = unit.removeprefix("\ufeff")
                    held.append(unit)
                    state = quoted_after(unit, sep, state)
            # a record may go on in the next batch: only those before it are done
            yield _grid_batch(rows)
        rows = []
        if held:
            text = "".join(held)
            rows.append((place[0], number, None, place[1], text) if state or not whole else (place[0], number, _cells(text, sep), place[1], None))
        yield _grid_batch(rows)

    return run


def _grid_batch(rows):
    kinds = [pa.string(), pa.int64(), pa.list_(_CELL), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    names = ["source_file", "row_no", "cells", "start", "piece"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _joined_pieces(sep: str):
    def run(batches):
        for batch in batches:
            cells = [_cells(text, sep) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(_CELL))], names=["source_file", "row_no", "cells"])

    return run


def _line_cells(sep: str):
    """Grid rows of numbered lines that are records of their own."""

    def run(batches):
        for batch in batches:
            rows = []
            for number, line in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows.append(_cells(line.removeprefix("\ufeff") if number == 1 else line, sep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(_CELL))], names=["source_file", "row_no", "cells"])

    return run


def _quoted_rows(spark: SparkSession, path: str, sep: str, schema: T.StructType) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    splits = lines.mapInArrow(_states(sep), "source_file string, start long, end0 boolean, end1 boolean, n0 long, n1 long")
    begin = splits.groupBy("source_file").applyInPandas(_beginnings, "source_file string, start long, quoted boolean, records long")
    # one row a split, and the lines keep their order
    told = lines.join(F.broadcast(begin), ["source_file", "start"]).select("source_file", "start", "value", "quoted", "records")
    parsed = T.StructType([*schema.fields, T.StructField("start", T.LongType()), T.StructField("piece", T.StringType())])
    found = told.mapInArrow(_split_records(sep), parsed)
    whole = found.filter(F.col("piece").isNull()).select(*schema.names)
    pieces = found.filter(F.col("piece").isNotNull()).groupBy("source_file", "row_no").agg(
        F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("_p")
    )
    joined = pieces.select("source_file", "row_no", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("text"))
    return whole.unionByName(joined.mapInArrow(_joined_pieces(sep), schema))


def delimited_grid(
    spark: SparkSession, path: str, sep: str | None = None, sheet: str | None = None, multi_line: bool = False
) -> DataFrame:
    """A delimited file (or folder of them) as grid rows, so header rows, data
    start, ranges and bottom skips apply to delimited files too.

    Every record keeps all of its cells, however wide the others are, and blank
    lines are rows without cells.  Files are split by lines: a line's number is
    its place within its split plus the lines of the splits before (one count
    per split).  With ``multi_line`` quotes may hold line feeds; files are split
    all the same, and only records that cross a split's end meet in a shuffle.
    (A quote that nothing closes takes all that follows, and one line feed.)
    """
    schema = T.StructType([f for f in GRID_SCHEMA.fields if f.name != "source_sheet"])
    sep = _separator(path, sep)
    if multi_line:
        rows = _quoted_rows(spark, path, sep, schema)
    else:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"),
            "value",
        )
        splits = lines.groupBy("source_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        before = Window.partitionBy("source_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.select(
            "source_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
        )
        number = (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("row_no")
        numbered = lines.join(splits, ["source_file", "_start"]).select("source_file", number, "value")
        rows = numbered.mapInArrow(_line_cells(sep), schema)
    stem = F.regexp_extract("source_file", r"([^/]*?)(\.[^./]*)?$", 1)
    return rows.select("source_file", (F.lit(sheet) if sheet else stem).alias("source_sheet"), "row_no", "cells")


def select_tables(
    tables: DataFrame,
    mode: str = "all",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """S10 over an exploded inventory (path, table, state, table_no): all, visible
    only, named (case-folded; an explicit list wins), or the first per file."""
    if names:
        wanted = [n.casefold() for n in names]
        return tables.filter(casefold(F.col("table")).isin(wanted))
    if mode == "all":
        return tables
    if mode == "visible":
        return tables.filter(F.col("state") == "visible")
    if mode == "first":
        return tables.filter(F.col("table_no") == 1)
    raise ValueError(f"Unknown table selection: {mode}")
