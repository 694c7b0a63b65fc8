import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators.joins import JoinSpec
from tessera.plans import tasks as T

SF = "/root/testdata/sf0.001"


def _out():
    return tempfile.mkdtemp(prefix="tessera-task-")


def test_split_task_by_field_with_report(spark):
    out = _out()
    task = T.SplitTask(
        sources=[T.SourceSpec(f"{SF}/orders.parquet"), T.SourceSpec(f"{out}/missing.parquet")],
        output=T.OutputSpec(out),
        fields=["o_orderstatus"],
        report_path=f"{out}/runs",
    )
    rep = T.run_split(spark, task)
    assert rep.status == "partial" and len(rep.errors) == 1
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert (rep.reconciliation.input_rows, rep.reconciliation.output_rows) == (n, n)
    written = spark.read.parquet(rep.outputs[0])
    assert written.count() == n and "_ordinal" not in written.columns
    assert spark.read.parquet(f"{out}/runs").count() == 1
    manifest = spark.read.parquet(f"{rep.outputs[0]}_manifest")
    assert sum(r["row_count"] for r in manifest.collect()) == n
    assert {r["output_name"] for r in manifest.collect()} == {f"orders_{s}" for s in ("F", "O", "P")}


def test_split_task_hierarchy_excludes_out_of_scope(spark, frame):
    out = _out()
    src = f"{out}/h.parquet"
    frame([("A", "x", 1), ("A", "y", 2), ("B", "x", 3)], "p string, c string, v long").write.parquet(src)
    task = T.SplitTask(
        sources=[T.SourceSpec(src)], output=T.OutputSpec(out), mode="hierarchy",
        hierarchy_fields=["p", "c"], hierarchy_filters={"p": "a"},
    )
    rep = T.run_split(spark, task)
    r = rep.reconciliation
    assert (r.input_rows, r.output_rows, r.excluded_rows, r.balanced) == (3, 2, 1, True)


def test_merge_task_dedupe_and_aggregate(spark, frame):
    out = _out()
    a, b = f"{out}/a.parquet", f"{out}/b.parquet"
    frame([("A", 10), ("B", 5)], "Branch string, Amount long").write.parquet(a)
    frame([("A", 7), ("B", 8), ("B", 8)], "Branch string, Amount long").write.parquet(b)
    rep = T.run_merge(spark, T.MergeTask([T.SourceSpec(a), T.SourceSpec(b)], T.OutputSpec(out, name="agg"), mode="aggregate",
                                         group_fields=["Branch"], value_fields=["Amount"], add_source_file=False, add_source_sheet=False))
    got = {r["Branch"]: r["Amount"] for r in spark.read.parquet(rep.outputs[0]).collect()}
    assert got == {"A": 17, "B": 21}
    assert rep.reconciliation.input_rows == 5
    per_source = {r["source_table"]: r["rows"] for r in spark.read.parquet(f"{rep.outputs[0]}_sources").collect()}
    assert per_source == {"a": 2, "b": 3}
    dd = T.run_merge(spark, T.MergeTask([T.SourceSpec(a), T.SourceSpec(b)], T.OutputSpec(out, name="dd"), dedupe_mode="all",
                                        add_source_file=False, add_source_sheet=False))
    assert spark.read.parquet(dd.outputs[0]).count() == 4


def test_join_task_and_side_by_side(spark, frame):
    out = _out()
    a, b = f"{out}/a.parquet", f"{out}/b.parquet"
    frame([(1, "A"), (2, "B")], "ID long, Name string").write.parquet(a)
    frame([(1, 10)], "ID long, Amount long").write.parquet(b)
    rep = T.run_join(spark, T.JoinTask([T.SourceSpec(a), T.SourceSpec(b)], T.OutputSpec(out, name="j"), JoinSpec(["ID"], ["ID"])))
    df = spark.read.parquet(rep.outputs[0])
    assert df.count() == 2 and not [c for c in df.columns if "ordinal" in c]
    assert rep.details == {"matched": 1, "main_only": 1, "related_only": 0, "duplicates": 0}
    assert (rep.reconciliation.input_rows, rep.reconciliation.output_rows) == (2, 2)
    rep2 = T.run_join(spark, T.JoinTask([T.SourceSpec(a), T.SourceSpec(b)], T.OutputSpec(out, name="s"), side_by_side=True, gap=1))
    s = spark.read.parquet(rep2.outputs[0])
    assert [c for c in s.columns if c != "split_label"] == ["ID", "Name", "__gap_1_1", "ID_2", "Amount"]
    assert s.filter(F.col("ID_2").isNull()).count() == 1


def test_skipped_existing_output_is_reconciled(spark):
    out = _out()
    task = T.SplitTask(sources=[T.SourceSpec(f"{SF}/orders.parquet")], output=T.OutputSpec(out, existing="skip"), fields=["o_orderstatus"])
    first = T.run_split(spark, task)
    assert first.outputs
    again = T.run_split(spark, task)
    r = again.reconciliation
    assert not again.outputs and r.output_rows == 0 and r.excluded_rows == r.input_rows > 0 and r.balanced
    assert any("skipped_existing" in w for w in again.warnings)


def _csv(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return f"{folder}/{name}"


def test_delimited_sources_keep_line_order_header_and_every_cell(spark):
    out = _out()
    path = _csv(out, "report.csv", "Report\n\nid,name,amount\n2,x,5\n1,y,6,late\n,,\n2,x,5\ntotal,,11\n")
    from tessera.sources.grid import TableStructure

    spec = T.SourceSpec(path, "csv", structure=TableStructure(header_mode="auto", skip_bottom_rows=1))
    task = T.SplitTask(
        [spec], T.OutputSpec(out), fields=["id"], cleaning=T.CleaningOptions(drop_duplicate_rows=True, drop_empty_rows=True),
        add_source_file=True, add_source_sheet=True,
    )
    rep = T.run_split(spark, task)
    assert not rep.errors and rep.reconciliation.balanced
    got = spark.read.parquet(rep.outputs[0])
    rows = {(r["id"], r["name"], r["amount"], r["Source_File"], r["Source_Sheet"], r["output_name"]) for r in got.collect()}
    assert rows == {(2, "x", 5, "report.csv", "report", "report_2"), (1, "y", 6, "report.csv", "report", "report_1")}
    manifest = [r["split_label"] for r in spark.read.parquet(f"{rep.outputs[0]}_manifest").orderBy("part_no").collect()]
    assert manifest == ["2", "1"]  # by line


def test_cleaning_looks_at_data_and_not_at_the_row_number(spark, frame):
    out = _out()
    src = f"{out}/d.parquet"
    frame([("a", 1), ("a", 1), (None, None), ("b", 2), (" ", None)], "k string, v long").write.parquet(src)
    options = T.CleaningOptions(drop_empty_rows=True, drop_duplicate_rows=True)
    rep = T.run_split(spark, T.SplitTask([T.SourceSpec(src)], T.OutputSpec(out), fields=["k"], cleaning=options))
    r = rep.reconciliation
    assert (r.input_rows, r.output_rows, r.excluded_rows) == (5, 2, 3)
    assert spark.read.parquet(rep.outputs[0]).count() == 2


def test_sheet_mode_makes_each_table_an_output(spark, frame):
    out = _out()
    for name in ("north", "south"):
        frame([(1, name)], "id long, region string").write.parquet(f"{out}/{name}.parquet")
    specs = [T.SourceSpec(f"{out}/{n}.parquet") for n in ("north", "south")]
    rep = T.run_split(spark, T.SplitTask(specs, T.OutputSpec(out), mode="sheet", naming_template="{split_value}"))
    got = spark.read.parquet(rep.outputs[0])
    assert sorted((r["output_name"], r["region"]) for r in got.collect()) == [("north", "north"), ("south", "south")]


def test_existing_outputs_are_handled_one_by_one(spark, frame):
    out = _out()
    src = f"{out}/t.parquet"
    frame([("001", 1), ("B", 2)], "k string, v long").write.parquet(src)
    task = lambda how: T.SplitTask(
        [T.SourceSpec(src)], T.OutputSpec(out, existing=how), fields=["k"], naming_template="{split_value}"
    )
    first = T.run_split(spark, task("rename"))
    read = lambda: sorted((r["output_name"], r["k"], r["v"]) for r in spark.read.option("recursiveFileLookup", "false").parquet(first.outputs[0]).selectExpr("string(output_name) output_name", "k", "v").collect())
    assert [k for _, k, _ in read()] == ["001", "B"]  # labels keep their zeros
    frame([("B", 3), ("C", 4)], "k string, v long").write.mode("overwrite").parquet(src)
    skipped = T.run_split(spark, task("skip"))
    assert (skipped.reconciliation.output_rows, skipped.reconciliation.excluded_rows) == (1, 1) and skipped.reconciliation.balanced
    assert [x for x in read() if x[0] in ("B", "C")] == [("B", "B", 2), ("C", "C", 4)]
    T.run_split(spark, task("overwrite"))
    assert [x for x in read() if x[0] in ("B", "C")] == [("B", "B", 3), ("C", "C", 4)]
    T.run_split(spark, task("rename"))
    assert [x for x in read() if x[0].startswith("B")] == [("B", "B", 3), ("B_2", "B", 3)]


def test_spreadsheet_limits_are_checked_on_request(spark, frame, monkeypatch):
    out = _out()
    src = f"{out}/t.parquet"
    frame([("a", i) for i in range(5)], "k string, v long").write.parquet(src)
    monkeypatch.setattr(T, "MAX_OUTPUT_ROWS", 4)
    rep = T.run_split(spark, T.SplitTask([T.SourceSpec(src)], T.OutputSpec(out, spreadsheet_limits=True), fields=["k"]))
    assert rep.status == "failed" and "limit is 4" in rep.errors[0]


def test_merge_counts_what_leaves_by_reason(spark, frame):
    out = _out()
    for name, rows in (("a", [(1, 5), (1, 5)]), ("b", [(1, 5), (2, 5)])):
        frame(rows, "k long, v long").write.parquet(f"{out}/{name}.parquet")
    specs = [T.SourceSpec(f"{out}/{n}.parquet") for n in "ab"]
    plain = dict(add_source_file=False, add_source_sheet=False)
    rep = T.run_merge(spark, T.MergeTask(specs, T.OutputSpec(out, name="m"), dedupe_mode="all", **plain))
    assert rep.details == {"excluded_duplicate": 2} and rep.reconciliation.balanced
    agg = T.run_merge(
        spark, T.MergeTask(specs, T.OutputSpec(out, name="g"), mode="aggregate", group_fields=["k"], value_fields=["v"], method="count", **plain)
    )
    assert agg.details == {"excluded_aggregated": 2} and agg.reconciliation.output_rows == 2
    same = [T.SourceSpec(f"{out}/a.parquet", table="T"), T.SourceSpec(f"{out}/a.parquet", table="t")]
    left = T.run_merge(spark, T.MergeTask(same, T.OutputSpec(out, name="c"), mode="catalog", conflict="skip"))
    assert left.details == {"excluded_table_left_out": 2} and left.reconciliation.balanced


def test_an_unreadable_file_does_not_stop_a_merge(spark, frame):
    out = _out()
    for name in "ab":
        frame([(i, "x" * 50) for i in range(100)], "v long, t string").coalesce(1).write.parquet(f"{out}/{name}.parquet")
    part = next(n for n in os.listdir(f"{out}/b.parquet") if n.startswith("part-"))
    path = f"{out}/b.parquet/{part}"
    data = bytearray(open(path, "rb").read())
    data[4:400] = bytes(396)  # pages are damaged, the footer is not
    open(path, "wb").write(data)
    for crc in [n for n in os.listdir(f"{out}/b.parquet") if n.endswith(".crc")]:
        os.unlink(f"{out}/b.parquet/{crc}")
    rep = T.run_merge(spark, T.MergeTask([T.SourceSpec(f"{out}/{n}.parquet") for n in "ab"], T.OutputSpec(out, name="m")))
    assert rep.status == "partial" and len(rep.errors) == 1 and "b.parquet" in rep.errors[0]
    assert spark.read.parquet(rep.outputs[0]).count() == 100
    frame([(1, "y")], "v long, t string").write.parquet(f"{out}/c.parquet")
    specs = [T.SourceSpec(f"{out}/{n}.parquet") for n in "abc"]
    own = T.run_merge(spark, T.MergeTask(specs, T.OutputSpec(out, name="k"), mode="catalog"))
    assert own.status == "partial" and len(own.errors) == 1 and own.reconciliation.output_rows == 101
    assert spark.read.parquet(f"{own.outputs[0]}/output_name=a_a").columns == ["v", "t"]
    assert [r.t for r in spark.read.parquet(f"{own.outputs[0]}/output_name=c_c").collect()] == ["y"]


def test_chained_join_reports_every_step(spark, frame):
    out = _out()
    for name, rows in (("a", [(1,), (2,)]), ("b", [(1,)]), ("c", [(2,), (3,)])):
        frame(rows, "id long").write.parquet(f"{out}/{name}.parquet")
    specs = [T.SourceSpec(f"{out}/{n}.parquet") for n in "abc"]
    rep = T.run_join(spark, T.JoinTask(specs, T.OutputSpec(out, name="j"), JoinSpec(["id"], ["id"])))
    assert not rep.errors, rep.errors
    assert {k: v for k, v in rep.details.items() if v} == {
        "step1_matched": 1, "step1_main_only": 1, "step2_matched": 1, "step2_main_only": 1
    }


def test_catalog_runs_keep_each_tables_own_schema(spark, frame, monkeypatch):
    out = _out()
    frame([(1, "x"), (2, "y")], "id long, v string").write.parquet(f"{out}/a.parquet")
    frame([(3, "z")], "id long, v string").coalesce(1).write.parquet(f"{out}/b.parquet")
    frame([("k", 1.5)], "id string, w double").write.parquet(f"{out}/c.parquet")
    frame([], "id long, v string").write.parquet(f"{out}/e.parquet")
    specs = [T.SourceSpec(f"{out}/{n}.parquet") for n in "abce"] + [T.SourceSpec(f"{out}/a.parquet", table="again")]
    spec = lambda how="rename": T.MergeTask(specs, T.OutputSpec(out, name="all", existing=how), mode="catalog")
    rep = T.run_merge(spark, spec())
    assert rep.reconciliation.balanced and rep.reconciliation.output_rows == 6 and not rep.errors
    read = lambda name: spark.read.parquet(f"{rep.outputs[0]}/output_name={name}")
    assert read("a_a").dtypes == [("id", "bigint"), ("v", "string")] and read("c_c").dtypes == [("id", "string"), ("w", "double")]
    assert sorted(r.id for r in read("a_a").collect()) == [1, 2] == sorted(r.id for r in read("a_again").collect())
    assert [r.id for r in read("b_b").collect()] == [3] and [tuple(r) for r in read("c_c").collect()] == [("k", 1.5)]
    listed = {r.output_name: r.row_count for r in spark.read.parquet(f"{rep.outputs[0]}_manifest").collect()}
    assert listed == {"a_a": 2, "b_b": 1, "c_c": 1, "e_e": 0, "a_again": 2}
    # output by output: what exists stays, the rest is written
    specs.append(T.SourceSpec(f"{out}/c.parquet", table="new"))
    again = T.run_merge(spark, spec("skip"))
    assert again.reconciliation.output_rows == 1 and again.details["excluded_skipped_existing"] == 6 and again.reconciliation.balanced
    assert [r.w for r in read("c_new").collect()] == [1.5]
    T.run_merge(spark, spec("overwrite"))
    assert read("a_a").count() == 2 and read("c_new").count() == 1
    # one scan a schema, however many files
    items = [("n" + str(k), i) for k, i in enumerate(T.load_sources(spark, [T.SourceSpec(f"{out}/{n}.parquet") for n in "abe"] * 20, []))]
    plan = T.scan_together(spark, items, "l")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and len({T._scan_key(i) for _, i in items}) == 1
    monkeypatch.setattr(T, "MAX_OUTPUT_ROWS", 1)
    limited = T.MergeTask(specs, T.OutputSpec(out, format="csv", name="big"), mode="catalog")
    try:
        T.run_merge(spark, limited)
        raise AssertionError("the size is not checked")
    except ValueError as error:
        assert "limit is 1" in str(error) and not os.path.exists(f"{out}/big")


def test_same_name_runs_write_each_group_with_its_own_schema(spark, frame):
    out = _out()
    for folder, rows, kind in (("p", [(1, "x"), (1, "x")], "id long, v string"), ("q", [(2.5, "y")], "id double, v string")):
        frame(rows, kind).write.parquet(f"{out}/{folder}/T.parquet")
    frame([("only",)], "u string").write.parquet(f"{out}/U.parquet")
    specs = [T.SourceSpec(f"{out}/p/T.parquet"), T.SourceSpec(f"{out}/q/T.parquet"), T.SourceSpec(f"{out}/U.parquet")]
    plain = dict(add_source_file=False, add_source_sheet=False)
    rep = T.run_merge(spark, T.MergeTask(specs, T.OutputSpec(out, name="m"), mode="same_name", dedupe_mode="all", **plain))
    read = lambda name: spark.read.parquet(f"{rep.outputs[0]}/output_name={name}")
    assert read("T_Combined").dtypes == [("id", "double"), ("v", "string")] and read("U_Combined").columns == ["u"]
    assert sorted(tuple(r) for r in read("T_Combined").collect()) == [(1.0, "x"), (2.5, "y")]
    assert rep.details == {"excluded_duplicate": 1} and rep.reconciliation.balanced
    one = T.run_merge(spark, T.MergeTask(specs, T.OutputSpec(out, name="t"), mode="same_name", target_table="t", **plain))
    assert one.details == {"excluded_table_left_out": 1} and one.reconciliation.output_rows == 3


def test_split_reports_say_why_rows_are_left_out(spark, frame):
    from tessera.plans.reconcile import reconcile_flagged

    out = _out()
    src = f"{out}/h.parquet"
    rows = [("A", "x"), ("A", " "), ("B", "x"), ("B", None), ("A", "y"), (None, None)]
    frame(rows, "p string, c string").write.parquet(src)
    blank = T.run_split(spark, T.SplitTask([T.SourceSpec(src)], T.OutputSpec(out), fields=["c"], blank_policy="skip"))
    assert blank.details == {"excluded_blank": 3} and blank.reconciliation.balanced
    task = T.SplitTask(
        [T.SourceSpec(src)], T.OutputSpec(out), mode="hierarchy", hierarchy_fields=["p", "c"], hierarchy_filters={"p": "a"}, blank_policy="skip",
    )
    scoped = T.run_split(spark, task)
    df = spark.read.parquet(src).withColumn("o", F.monotonically_increasing_id())
    flagged = T.H.split_by_hierarchy(df, ["p", "c"], {"p": "a"}, "c", ["o"], "EMPTY", "skip").flagged
    want = reconcile_flagged(flagged).first().excluded_by
    assert {k.removeprefix("excluded_"): n for k, n in scoped.details.items()} == want and len(want) == 2
    cleaned = T.SplitTask([T.SourceSpec(src)], T.OutputSpec(out, name="c"), fields=["p"], cleaning=T.CleaningOptions(drop_empty_rows=True))
    assert T.run_split(spark, cleaned).details == {"excluded_cleaning": 1}
