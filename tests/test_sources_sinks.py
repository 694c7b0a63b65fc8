import csv
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import split as X
from tessera.sinks import writer as W
from tessera.sources import files as S
from tessera.sources import grid as G


def _grid(spark, rows, source="f.xlsx", sheet="Sheet1"):
    data = []
    for i, row in enumerate(rows, start=1):
        cells = []
        for v in row:
            if v is None:
                cells.append(None)
            elif isinstance(v, str):
                cells.append(("string", v))
            else:
                cells.append(("number" if isinstance(v, (int, float)) else "date", str(v)))
        data.append((source, sheet, i, cells))
    return spark.createDataFrame(data, G.GRID_SCHEMA)


def test_multi_row_header_and_formula_text(spark):
    grid = _grid(spark, [["Orchard", "Harvest"], ["Plot", "Crates"], [7, "=B2*4"]])
    names = G.unique_headers(G.header_parts(grid, 1, 2))
    got = [r["name"] for r in names.orderBy("pos").collect()]
    assert got == ["Orchard_Plot", "Harvest_Crates"]
    table = G.grid_table(grid, "f.xlsx", "Sheet1", got, 3)
    assert table.collect()[0]["Harvest_Crates"] == "=B2*4"


def test_header_detection(spark):
    import datetime as dt

    grid = _grid(spark, [["Plots of the north orchard", None, None], ["Plot id", "Tree name", "Planted date"], [11, "Boskoop", dt.date(2019, 4, 3)], [12, "Gala", dt.date(2021, 10, 9)]])
    found = G.detect_headers(grid).collect()[0]
    assert found["header_row"] == 2 and found["confidence"] >= 0.8


def test_header_detection_empty_table(spark):
    grid = _grid(spark, [[None, ""], []])
    found = G.detect_headers(grid).collect()[0]
    assert (found["header_row"], found["confidence"]) == (1, 0.0)


def test_unique_headers_iterate():
    assert G.finalize_names(["A", "A", "A_2", None, " "]) == ["A", "A_2", "A_2_2", "Column_4", "Column_5"]


def test_blank_header_cells_become_column_i(spark):
    grid = _grid(spark, [["A", None, "A"], [1, 2, 3]])
    got = [r["name"] for r in G.unique_headers(G.header_parts(grid, 1)).orderBy("pos").collect()]
    assert got == ["A", "Column_2", "A_2"]


def test_slice_grid(spark):
    grid = _grid(spark, [["h1", "h2", "h3"], [1, 2, 3], [4, 5, 6], ["total", None, None]])
    out = G.slice_grid(grid, start_row=2, start_col=2, end_col=3, skip_bottom=1)
    rows = out.orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == [2, 3]
    assert [[c["text"] for c in r["cells"]] for r in rows] == [["2", "3"], ["5", "6"]]


def test_table_to_grid_and_preview(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "ID long, Name string")
    grid = G.table_to_grid(df, "t.parquet", "t", ["ID"], leading_rows=[["Title"]])
    rows = grid.orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == [1, 2, 3, 4]
    assert rows[1]["cells"][0]["text"] == "ID" and rows[2]["cells"][0]["kind"] == "number"
    assert [r["ID"] for r in G.preview(df, ["ID"], 1).collect()] == [1]


def test_preview_with_totals_and_header(spark):
    rows = [["Plots of the north orchard"], ["Plot id", "Tree name", "Planted date", "Status"]]
    rows += [[k, f"t{k}", 20.5, "x"] + (["late"] if k == 30 else []) for k in range(1, 41)]
    grid = _grid(spark, rows)
    got = G.preview_grid(grid, "f.xlsx", "Sheet1", rows=5)
    assert (got.columns, got.total_rows, got.total_columns, got.header_row) == (["Plot id", "Tree name", "Planted date", "Status"], 40, 5, 2)
    assert got.confidence > 0.7 and [(r.row_no, r["Plot id"]) for r in got.rows.orderBy("row_no").collect()] == [(k + 2, str(k)) for k in range(1, 6)]
    chosen = G.preview_grid(grid, "f.xlsx", "Sheet1", G.TableStructure(header_mode="multi_row", header_row=1, header_end_row=2), rows=3)
    assert chosen.columns[0] == "Plots of the north orchard_Plot id" and (chosen.total_rows, chosen.header_row) == (40, 1)
    bare = G.preview_grid(grid, "f.xlsx", "Sheet1", G.TableStructure(header_mode="none"), rows=3)
    assert bare.columns == [f"Column_{i}" for i in range(1, 6)] and bare.total_rows == 42 and bare.rows.count() == 3
    none = G.preview_grid(grid, "f.xlsx", "Missing")
    assert (none.columns, none.total_rows, none.rows.count()) == ([], 0, 0)


def test_profile_and_fields(spark):
    df = spark.createDataFrame([(1, "b"), (2, " "), (3, "a"), (4, "b"), (5, None)], "ID long, v string")
    top, summary = G.profile_field(df, "v", ["ID"], top=2)
    assert [(r["value"], r["count"]) for r in top.collect()] == [("b", 2), ("(Blank)", 2)]
    s = summary.collect()[0]
    assert (s["distinct_values"], s["total_rows"]) == (3, 5)
    df2 = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, "x", "q"), (4, "z", "r")], "ID long, `Unnamed: 1` string, V string")
    fields = G.discover_fields([("f.csv", "f", df2, ["ID"])], samples=2).orderBy("position").collect()
    assert [r["field"] for r in fields] == ["ID", "V"]
    assert fields[1]["samples"] == ["p", "q"]


def _whole_csv(path, sep=","):
    with open(path, encoding="utf-8-sig", newline="") as fh:
        return [[None if c == "" else c for c in r] for r in csv.reader(fh, delimiter=sep)]


def test_quotes_over_many_splits_equal_a_reader_of_the_whole_file(spark, tmp_path):
    rnd = random.Random(3)
    field = lambda: "".join(rnd.choice(["a", "bc", "é", " ", ",", "\n", "\r\n", "\r", '"', "x" * 40]) for _ in range(rnd.randint(0, 5)))

    def written(f):
        plain = not set(f) & set(',"\r\n')
        return f if plain and rnd.random() < 0.7 else '"' + f.replace('"', '""') + '"' + rnd.choice(["", "", "tail"])

    os.makedirs(tmp_path / "d")
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        lines = [",".join(written(field()) for _ in range(rnd.randint(0, 4))) + end for _ in range(150)]
        lines[7] = 'in"side,"x"y",z"' + end  # quotes that open nothing, and a tail after a closing one
        lines[20] = '"' + "long line\n" * 60 + '",end' + end  # over many splits
        with open(tmp_path / "d" / f"f{k}.csv", "w", encoding="utf-8", newline="") as fh:
            fh.write(("\ufeff" if k == 1 else "") + ('"first\nfield",1' + end if k == 1 else "") + "".join(lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("97", "500", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            grid = S.delimited_grid(spark, str(tmp_path / "d"), multi_line=True)
            got = {}
            for r in grid.orderBy("source_file", "row_no").collect():
                got.setdefault(os.path.basename(r.source_file), []).append((r.row_no, [c and c["text"] for c in r.cells]))
            tasks = grid.select(F.spark_partition_id()).distinct().count()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        for name, rows in got.items():
            assert rows == list(enumerate(_whole_csv(tmp_path / "d" / name), 1))
        assert set(got) == {"f0.csv", "f1.csv", "f2.csv"} and (size == "128m" or tasks > 5)


def test_state_of_quotes_line_by_line():
    for line, from_out, from_in in [
        ("a,b\n", False, True), ('"a\n', True, False), ('a,"b\n', True, False), ('a",b\n', False, False), ('""\n', False, True),
        ('"a""b\n', True, False), ('x"y\n', False, False), ('"a"b,"c\n', True, True), ('a"\n', False, False), ('",\n', True, False),
    ]:
        assert (S.quoted_after(line, ",", False), S.quoted_after(line, ",", True)) == (from_out, from_in), line


def test_inventory_reads_to_the_end(spark, tmp_path):
    with open(tmp_path / "late.csv", "wb") as fh:
        fh.write(b"a,b\n" * 60_000 + b"\xff\xfe\n")
    with open(tmp_path / "nulls.csv", "wb") as fh:
        fh.write(b"a,b\n" * 60_000 + b"\0\n")
    with open(tmp_path / "cut.csv", "wb") as fh:
        fh.write("a,é".encode()[:-1])
    with open(tmp_path / "good.csv", "wb") as fh:
        fh.write(b"a,b\n" * 60_000)
    files = S.collect_input_files(spark, [str(tmp_path)])
    assert {r.name: r.status for r in S.inventory(spark, files).collect()} == {"late.csv": "error", "nulls.csv": "error", "cut.csv": "error", "good.csv": "ready"}
    assert {r.name: r.status for r in S.inventory(spark, files, probe_bytes=2).collect()} == dict.fromkeys(["late.csv", "nulls.csv", "cut.csv", "good.csv"], "probed")


@pytest.mark.parametrize("head", [1, 3, 500])
def test_first_distinct_values_of_whole_columns(spark, head):
    rows = [(i, "same", None if i % 4 else " ", f" v{i // 40} ", i % 2 == 0, 1.5 if i < 190 else 2.0) for i in range(200)]
    df = spark.createDataFrame(rows, "o long, a string, b string, c string, d boolean, e double").repartition(5)
    got = G.first_distinct(df, ["a", "b", "c", "d", "e", "o"], ["o"], 3, head=head)
    assert got == {"a": ["same"], "b": [], "c": ["v0", "v1", "v2"], "d": ["True", "False"], "e": ["1.5", "2.0"], "o": ["0", "1", "2"]}
    assert G.first_distinct(df.limit(0), ["a"], ["o"], 3) == {"a": []}


def test_a_bad_source_is_a_warning_of_field_discovery(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "ID long, V string")
    gone = lambda: spark.read.parquet(str(tmp_path / "gone"))
    bad = df.withColumn("V", F.raise_error(F.lit("unreadable cell")))
    warnings = []
    out = G.discover_fields([("a", "a", df, ["ID"]), ("b", "b", gone, ["ID"]), ("c", "c", bad, ["ID"])], warnings=warnings)
    assert [(r.source_file, r.field, r.samples) for r in out.orderBy("position").collect()] == [("a", "ID", ["1"]), ("a", "V", ["x"])]
    assert len(warnings) == 2 and warnings[0].startswith("b / b") and "unreadable cell" in warnings[1]
    with pytest.raises(Exception, match="unreadable cell"):
        G.discover_fields([("c", "c", bad, ["ID"])])


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_inventory_and_delimited(spark):
    root = tempfile.mkdtemp(prefix="tessera-src-")
    _write(f"{root}/a.csv", "Plot,Tree\n11,Gala\n12,\n13,Boskoop\n")
    _write(f"{root}/b.TSV", "Plot\tCrates\n11\t40\n")
    _write(f"{root}/~$open-elsewhere.csv", "x\n")
    _write(f"{root}/notes.txt", "x\n")
    _write(f"{root}/book.xlsx", "not really\n")
    _write(f"{root}/nested/c.csv", "Plot\n14\n")
    flat = S.collect_input_files(spark, [root])
    assert [r["name"] for r in flat.collect()] == ["a.csv", "b.TSV", "book.xlsx"]
    deep = S.collect_input_files(spark, [root], recursive=True)
    assert "c.csv" in [r["name"] for r in deep.collect()]
    inv = {r["name"]: r for r in S.inventory(spark, flat).collect()}
    assert inv["a.csv"]["status"] == "ready" and inv["a.csv"]["tables"][0]["name"] == "a"
    assert inv["book.xlsx"]["status"] == "error"
    only = S.collect_input_files(spark, [root], name_contains="A", name_excludes="book")
    assert [r["name"] for r in only.collect()] == ["a.csv"]
    df = S.read_delimited(spark, f"{root}/a.csv")
    assert df.columns == ["Plot", "Tree"] and df.count() == 3
    tsv = S.read_delimited(spark, f"{root}/b.TSV", header=False, infer_schema=False)
    assert tsv.columns == ["Column_1", "Column_2"]
    grid = S.delimited_grid(spark, f"{root}/a.csv")
    assert [r["row_no"] for r in grid.orderBy("row_no").collect()] == [1, 2, 3, 4]


def test_write_split_csv_and_reconcile(spark):
    out = tempfile.mkdtemp(prefix="tessera-out-")
    df = spark.createDataFrame([(1, "A", [1]), (2, None, [2]), (3, "B", [3])], "ID long, Branch string, tags array<int>")
    split = X.split_by_fields(df, ["Branch"], ["ID"], blank_policy="skip")
    res = W.write_split(split.flagged, f"{out}/result", fmt="csv")
    assert res.counts == {"input_rows": 3, "output_rows": 2, "excluded_rows": 1}
    back = spark.read.option("header", "true").csv(res.path)
    assert back.count() == 2 and sorted(r["split_label"] for r in back.collect()) == ["A", "B"]
    assert sorted(os.listdir(res.path)).count("split_label=A") == 1
    again = W.write_split(split.flagged, f"{out}/result", fmt="parquet")
    assert again.path.endswith("result_2")
    skipped = W.write_split(split.flagged, f"{out}/result", existing="skip")
    assert not skipped.written and skipped.warning
    W.write_split(split.flagged, f"{out}/result", existing="overwrite")


def test_size_guard(spark):
    m = spark.createDataFrame([("a", 5)], "split_label string, row_count long")
    with pytest.raises(ValueError):
        W.check_output_size(m, 2, max_rows=4)
    with pytest.raises(ValueError):
        W.check_output_size(m, 20000)
    W.check_output_size(m, 2)


def test_output_names_collide_case_insensitively(spark):
    m = spark.createDataFrame([("North", 1, 1, 1), ("north", 2, 2, 1)], "split_label string, part_no long, total_parts long, row_count long")
    got = [r["output_name"] for r in W.output_names(m, "{split_value}").orderBy("part_no").collect()]
    assert got == ["North", "north_2"]


def test_reconcile_and_report(spark):
    from datetime import datetime

    from tessera.plans.reconcile import RunReport, reconcile_rows, report_frame

    r = reconcile_rows(5, 3, 1)
    assert not r.balanced and "left out" in r.warning()
    rep = RunReport("split", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 2), outputs=["x"], errors=["bad"], reconciliation=reconcile_rows(3, 3))
    assert rep.status == "partial"
    row = report_frame(spark, rep).collect()[0]
    assert row["seconds"] == 2.0 and row["balanced"] is True
    assert F is not None


def test_read_grid_table_modes(spark):
    grid = _grid(spark, [["Quarterly report", None, None], ["ID", "Name", "Date"], [1, "A", "2026-01-01"], [2, "B", None], [None, None, None], ["Total", None, None]])
    auto = G.read_grid_table(grid, "f.xlsx", "Sheet1", G.TableStructure(skip_bottom_rows=1))
    assert auto.columns == ["ID", "Name", "Date"]
    assert [tuple(r) for r in auto.collect()] == [("1", "A", "2026-01-01"), ("2", "B", None)]
    none = G.read_grid_table(grid, "f.xlsx", "Sheet1", G.TableStructure(header_mode="none", data_start_row=3, drop_empty_rows=False))
    assert none.columns == ["Column_1", "Column_2", "Column_3"] and none.count() == 4
    multi = G.read_grid_table(grid, "f.xlsx", "Sheet1", G.TableStructure(header_mode="multi_row", header_row=1, header_end_row=2))
    assert multi.columns[0] == "Quarterly report_ID"


def test_csv_with_title_row_through_the_grid(spark):
    root = tempfile.mkdtemp(prefix="tessera-csvgrid-")
    _write(f"{root}/report.csv", "Monthly report,,\nID,Name,Amount\n1,North,10\n2,South,20\n")
    grid = S.delimited_grid(spark, f"{root}/report.csv")
    files = [r["source_file"] for r in grid.select("source_file").distinct().collect()]
    table = G.read_grid_table(grid, files[0], "report")
    assert table.columns == ["ID", "Name", "Amount"]
    assert sorted(tuple(r) for r in table.collect()) == [("1", "North", "10"), ("2", "South", "20")]


def test_ragged_and_blank_lines_survive(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Report\n\nid,name,amount\n1,"x, y",5\n2,z,6,more\n', encoding="utf-8")
    rows = S.delimited_grid(spark, str(tmp_path / "r.csv")).orderBy("row_no").collect()
    cells = [[c and c["text"] for c in r["cells"]] for r in rows]
    assert cells == [["Report"], [], ["id", "name", "amount"], ["1", "x, y", "5"], ["2", "z", "6", "more"]]
    assert [r["row_no"] for r in rows] == [1, 2, 3, 4, 5]


def test_line_numbers_across_splits_and_records_over_lines(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f"{i},{'x' * 40}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        grid = S.delimited_grid(spark, str(tmp_path / "big.csv"))
        assert grid.rdd.getNumPartitions() > 1
        off = grid.filter("cells[0].text <> string(row_no - 1)")
        assert off.count() == 0 and grid.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "q.csv").write_text('a,"two\nlines"\nb,c\n')
    rows = S.delimited_grid(spark, str(tmp_path / "q.csv"), multi_line=True).orderBy("row_no").collect()
    assert [[c["text"] for c in r["cells"]] for r in rows] == [["a", "two\nlines"], ["b", "c"]]


def test_hidden_looking_names_are_listed_and_damage_is_told(spark, tmp_path):
    (tmp_path / "_x.csv").write_text("a,b\n")
    (tmp_path / "bad.csv").write_bytes(b"a,\xff\xfe\x00b\n")
    (tmp_path / "ẞ.CSV").write_text("a\n")
    files = S.collect_input_files(spark, [str(tmp_path)])
    assert {r["name"] for r in files.collect()} == {"_x.csv", "bad.csv", "ẞ.CSV"}
    assert [r["name"] for r in S.collect_input_files(spark, [str(tmp_path)], name_contains="SS").collect()] == ["ẞ.CSV"]
    status = {r["name"]: (r["status"], len(r["tables"])) for r in S.inventory(spark, files).collect()}
    assert status == {"_x.csv": ("ready", 1), "bad.csv": ("error", 0), "ẞ.CSV": ("ready", 1)}


def test_headers_that_look_numbered_stay_apart(spark):
    grid = _grid(spark, [["A", "A", "A_2", None, "A"], [1, 2, 3, 4, 5]])
    got = [r["name"] for r in G.unique_headers(G.header_parts(grid, 1)).orderBy("pos").collect()]
    assert got == ["A", "A_2", "A_2_2", "Column_4", "A_3"]
