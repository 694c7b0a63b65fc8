import os
from pyspark.sql import Window
from tessera.operators.ordinals import dense_index
import pytest
from pyspark.sql import functions as F

from tessera.operators import split as X


def _sizes(split):
    rows = split.manifest.orderBy("part_no").collect()
    return [r["row_count"] for r in rows]


def test_fixed_rows_2400_in_500(spark):
    ids = spark.range(2400).withColumnRenamed("id", "ID")
    assert _sizes(X.split_fixed_rows(ids, 500, ["ID"])) == [500, 500, 500, 500, 400]


def test_balanced_2400_limit_500(spark):
    ids = spark.range(2400).withColumnRenamed("id", "ID")
    assert _sizes(X.split_fixed_rows(ids, 500, ["ID"], balanced=True)) == [480] * 5


def test_five_parts_of_2400(spark):
    ids = spark.range(2400).withColumnRenamed("id", "ID")
    assert _sizes(X.split_into_parts(ids, 5, ["ID"])) == [480] * 5


def test_seven_rows_three_parts_like_ntile(spark):
    ids = spark.range(7).withColumnRenamed("id", "ID")
    split = X.split_into_parts(ids, 3, ["ID"])
    assert _sizes(split) == [3, 2, 2]
    parts = [r["part_no"] for r in split.rows.orderBy("ID").collect()]
    assert parts == [1, 1, 1, 2, 2, 3, 3]


def test_more_parts_than_rows_omits_empty_parts(spark):
    ids = spark.range(2).withColumnRenamed("id", "ID")
    split = X.split_into_parts(ids, 5, ["ID"])
    assert _sizes(split) == [1, 1]
    assert {r["total_parts"] for r in split.rows.collect()} == {2}


def test_fixed_rows_follow_order_not_storage(spark):
    ids = spark.createDataFrame([(5,), (1,), (4,), (2,), (3,)], "ID long")
    split = X.split_fixed_rows(ids, 2, ["ID"])
    got = {r["ID"]: r["part_no"] for r in split.rows.collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}


def test_ids_5_two_per_part(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "ID long")
    assert _sizes(X.split_fixed_rows(ids, 2, ["ID"])) == [2, 2, 1]


def test_one_million_rows_ten_parts(spark):
    ids = spark.range(1_000_000).withColumnRenamed("id", "ID")
    assert _sizes(X.split_fixed_rows(ids, 100_000, ["ID"])) == [100_000] * 10


def test_invalid_sizes(spark):
    ids = spark.range(3)
    with pytest.raises(ValueError):
        X.split_fixed_rows(ids, 0, ["id"])
    with pytest.raises(ValueError):
        X.split_into_parts(ids, 0, ["id"])


def test_joined_labels_area_branch(frame):
    df = frame([(1, "A", "1"), (2, "A", "2"), (3, "B", "1"), (4, None, "")], "o long, Area string, Branch string")
    split = X.split_by_fields(df, ["Area", "Branch"], ["o"], label_style="joined")
    labels = [r["split_label"] for r in split.manifest.orderBy("part_no").collect()]
    assert labels == ["A__1", "A__2", "B__1", "EMPTY__EMPTY"]
    assert sum(r["row_count"] for r in split.manifest.collect()) == 4


def test_pairs_label_and_first_appearance(frame):
    df = frame([(1, "B", 1), (2, "A", 2), (3, "B", 2)], "o long, Area string, Code int")
    split = X.split_by_fields(df, ["Area", "Code"], ["o"])
    labels = [r["split_label"] for r in split.manifest.orderBy("part_no").collect()]
    assert labels == ["Area=B | Code=1", "Area=A | Code=2", "Area=B | Code=2"]


def test_branch_amount_groups_and_reconciliation(frame):
    df = frame([(1, "North", 10), (2, "South", 20), (3, "North", 30)], "ID long, Branch string, Amount long")
    split = X.split_by_fields(df, ["Branch"], ["ID"])
    got = {r["split_label"]: r["row_count"] for r in split.manifest.collect()}
    assert got == {"North": 2, "South": 1}
    rec = split.reconciliation().collect()[0]
    assert (rec["input_rows"], rec["output_rows"], rec["excluded_rows"], rec["balanced"]) == (3, 3, 0, True)


def test_blank_skip_counts_excluded(frame):
    df = frame([(1, "A"), (2, None), (3, "B")], "ID long, Branch string")
    split = X.split_by_fields(df, ["Branch"], ["ID"], blank_policy="skip")
    assert split.rows.count() == 2
    rec = split.reconciliation().collect()[0]
    assert (rec["input_rows"], rec["output_rows"], rec["excluded_rows"]) == (3, 2, 1)
    assert rec["excluded_by"] == {"blank": 1}


def test_blank_group_and_empty_label_value_join(frame):
    df = frame([(1, "  "), (2, "EMPTY"), (3, None), (4, "x")], "ID long, Branch string")
    got = {r["split_label"]: r["row_count"] for r in X.split_by_fields(df, ["Branch"], ["ID"]).manifest.collect()}
    assert got == {"EMPTY": 3, "x": 1}


def test_no_normalisation_in_field_split(frame):
    df = frame([(1, " A"), (2, "A")], "ID long, Branch string")
    assert X.split_by_fields(df, ["Branch"], ["ID"]).manifest.count() == 2


def test_numbers_and_booleans_label_like_python(frame):
    df = frame([(1, 1.0, True), (2, 2.5, False)], "ID long, v double, b boolean")
    labels = {r["split_label"] for r in X.split_by_fields(df, ["v", "b"], ["ID"]).manifest.collect()}
    assert labels == {"v=1.0 | b=True", "v=2.5 | b=False"}


def test_missing_and_empty_fields(frame):
    df = frame([(1, "a")], "ID long, B string")
    with pytest.raises(ValueError):
        X.split_by_fields(df, [], ["ID"])
    with pytest.raises(KeyError):
        X.split_by_fields(df, ["nope"], ["ID"])


def test_split_by_table(spark, frame):
    a = frame([(1,), (2,)], "ID long")
    b = frame([(3, "x")], "ID long, Extra string")
    empty = frame([], "ID long")
    split = X.split_by_table([("Details", a), ("Summary", b), ("Empty", empty)])
    got = {r["split_label"]: (r["part_no"], r["row_count"]) for r in split.manifest.collect()}
    assert got == {"Details": (1, 2), "Summary": (2, 1), "Empty": (3, 0)}
    assert set(split.rows.columns) == {"ID", "Extra", "Source_Sheet", "split_label"}
    assert split.rows.filter(F.col("Source_Sheet") == "Summary").count() == 1


def test_first_appearance_with_ties_and_nulls_in_order(frame):
    df = frame(
        [("x", 1, 5), ("x", 1, 3), ("y", None, 9), ("y", 0, 1), ("z", 2, None), ("z", 2, 7)],
        "g string, a int, b int",
    )
    split = X.split_by_fields(df, ["g"], ["a", "b"])
    # NULL sorts first in the order, so y (a NULL) comes before x (1, 3) and z (2, NULL)
    assert [r["split_label"] for r in split.manifest.orderBy("part_no").collect()] == ["y", "x", "z"]


def test_empty_input_gives_one_empty_part(spark):
    empty = spark.range(0).withColumnRenamed("id", "ID")
    assert [(r["part_no"], r["row_count"]) for r in X.split_fixed_rows(empty, 10, ["ID"]).manifest.collect()] == [(1, 0)]
    assert X.split_into_parts(empty, 3, ["ID"]).manifest.count() == 1
    assert _sizes(X.split_fixed_rows(spark.range(5).withColumnRenamed("id", "ID"), 2, ["ID"])) == [2, 2, 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
@pytest.mark.parametrize("files", [1, 16])
def test_dense_index_over_whole_rows(spark, tmp_path, files):
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    if files > 1:
        orders.repartition(files).write.parquet(str(tmp_path / "orders"))
        orders = spark.read.parquet(str(tmp_path / "orders"))
    indexed = dense_index(orders, ["o_orderdate", "o_orderkey"], name="i", total="n")
    n = orders.count()
    got = indexed.agg(F.count("*"), F.count_distinct("i"), F.min("i"), F.max("i"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (n, n, 0, n - 1, n, n)
    misplaced = indexed.withColumn("w", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")) - 1).filter("w <> i")
    assert misplaced.count() == 0
    split = X.split_into_parts(orders, 7, ["o_orderkey"])
    split.rows.write.parquet(str(tmp_path / "parts"))
    written = dict(spark.read.parquet(str(tmp_path / "parts")).groupBy("part_no").count().collect())
    assert written == {r["part_no"]: r["row_count"] for r in split.manifest.collect()}
    assert max(written.values()) - min(written.values()) <= 1
