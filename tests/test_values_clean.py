import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import naming as N
from tessera.functions import values as V
from tessera.operators import cleaning as C


def _one(spark, value, ddl, fn):
    df = spark.createDataFrame([(value,)], f"v {ddl}")
    return df.select(fn(df["v"], df.schema["v"].dataType).alias("r")).collect()[0]["r"]


def test_blank_detection_unicode(spark):
    df = spark.createDataFrame([("　  ",), ("\x1c",), (" a ",), (None,), ("",)], "v string")
    got = [r["b"] for r in df.select(V.is_blank(df["v"], df.schema["v"].dataType).alias("b")).collect()]
    assert got == [True, True, False, True, True]


def test_trim_and_collapse_like_python(spark):
    texts = ["　 A  B\t\n", "x\x1fy", "  plain  "]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select(V.trim_ws("v").alias("t"), V.collapse_ws("v").alias("c")).collect()
    import re

    assert [r["t"] for r in rows] == [t.strip() for t in texts]
    assert [r["c"] for r in rows] == [re.sub(r"\s+", " ", t) for t in texts]


def test_nfkc_and_casefold_match_python(spark):
    texts = ["Ｎａｍｅ（ID）", "Straße", "ﬁle", "ABC", "ǅ", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select(V.nfkc("v").alias("n"), V.casefold("v").alias("f"), V.fold_key("v").alias("k")).collect()
    for t, r in zip(texts, rows):
        if t is None:
            assert r["n"] is None and r["k"] is None
            continue
        assert r["n"] == unicodedata.normalize("NFKC", t)
        assert r["f"] == t.casefold()
        assert r["k"] == unicodedata.normalize("NFKC", t).strip().casefold()


def test_field_name_normalisation():
    assert V.normalize_field_name("Ｎａｍｅ  （ID）") == "name (id)"


def test_display_values(spark):
    assert _one(spark, 3.0, "double", V.display_value) == "3"
    assert _one(spark, 2.5, "double", V.display_value) == "2.5"
    assert _one(spark, float("nan"), "double", V.display_value) == "EMPTY"
    assert _one(spark, True, "boolean", V.display_value) == "True"
    assert _one(spark, dt.datetime(2024, 1, 2, 3, 4, 5, 678), "timestamp", V.display_value) == "2024-01-02 03:04:05"
    assert _one(spark, dt.date(2024, 1, 2), "date", V.display_value) == "2024-01-02"
    assert _one(spark, " Ａ ", "string", V.display_value) == "A"
    assert _one(spark, 1e20, "double", V.display_value) == str(int(1e20))


def test_canonical_values(spark):
    assert _one(spark, " Ａb ", "string", V.canonical_value) == "ab"
    assert _one(spark, "empty", "string", V.canonical_value) == "empty"
    assert _one(spark, "EMPTY", "string", V.canonical_value) == V.EMPTY_KEY
    assert _one(spark, "  ", "string", V.canonical_value) == V.EMPTY_KEY
    assert V.selection_key("EMPTY") == V.EMPTY_KEY and V.selection_key(" Ａb") == "ab"


def test_key_text(spark):
    assert _one(spark, None, "string", V.key_text) == ""
    assert _one(spark, float("nan"), "double", V.key_text) == ""
    assert _one(spark, 1, "long", V.key_text) == "1"
    assert _one(spark, 1.0, "double", V.key_text) == "1.0"


def test_to_number(spark):
    df = spark.createDataFrame([(s,) for s in ["1", " 2.5 ", "1e3", "1d", "abc", ".5", "-3", None]], "v string")
    got = [r["n"] for r in df.select(V.to_number(df["v"], df.schema["v"].dataType).alias("n")).collect()]
    assert got == [1.0, 2.5, 1000.0, None, None, 0.5, -3.0, None]


def test_similarity_matches_difflib(spark):
    import difflib

    pairs = [("Nroth", "North"), ("abc", "abd"), ("", "x"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["s"] for r in df.select(V.similarity("a", "b").alias("s")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert got[0] == 0.8


def test_safe_names(spark):
    df = spark.createDataFrame([("bad:folder*name.",), ("con",), ("  ",), ("a|b  c",)], "v string")
    got = [r["n"] for r in df.select(N.safe_path_name("v").alias("n")).collect()]
    assert got == ["bad_folder_name", "_con", "output", "a_b c"]
    assert N.safe_table_name("a/b[1]:" + "x" * 40) == "a_b_1__" + "x" * 40  # nothing is cut by default
    assert N.safe_table_name("'a/b[1]:'" + "x" * 40, max_length=31) == "a_b_1__'" + "x" * 23
    assert N.safe_table_name("''") == "Sheet"


def test_part_numbers_beyond_the_width_stay_whole(spark):
    df = spark.createDataFrame([(7,), (999,), (1000,), (1002,)], "part_no long")
    named = df.select(N.render_template("x_{part_no:03d}", {"part_no": "part_no"}).alias("n"))
    assert [r["n"] for r in named.collect()] == ["x_007", "x_999", "x_1000", "x_1002"]


def test_colliding_names_never_coincide(spark):
    rows = [(i + 1, n) for i, n in enumerate(["a", "A", "a_2", "b", "c", "C", "c", "a_2_2", "a"])]
    df = spark.createDataFrame(rows, "part_no long, name string")
    got = [r["out"] for r in N.number_collisions(df, "name", "part_no", out="out").orderBy("part_no").collect()]
    assert got == ["a", "A_2", "a_2_2", "b", "c", "C_2", "c_3", "a_2_2_2", "a_3"]
    same = spark.range(1, 25_001).selectExpr("id as part_no", "'part' as name")
    out = N.number_collisions(same, "name", "part_no", out="out")
    assert out.select("out").distinct().count() == 25_000
    assert out.filter("part_no = 12345").first()["out"] == "part_12345"


def test_names_of_one_template_are_not_dealt_by_their_family(spark):
    """Numbers in a template give all names one family; the rows must not meet in its task."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(1, 2001, numPartitions=4).select(F.concat(F.lit("orders_"), "id").alias("name"), F.col("id").alias("part_no"))
    out = N.number_collisions(rows, "name", "part_no", out="out")
    assert out.where("out = name").count() == 2000
    assert not re.search(r"hashpartitioning\(_family#\d+, \d+", plan(out))
    odd = spark.createDataFrame([("a", 2001), ("A", 2002), ("a_2", 2003)], "name string, part_no long")
    out = N.number_collisions(rows.unionByName(odd), "name", "part_no", out="out")
    assert re.search(r"BroadcastHashJoin \[_family#\d+\], \[_family#\d+\], LeftAnti", plan(out))
    got = {r["part_no"]: r["out"] for r in out.collect()}
    assert [got.pop(k) for k in (2001, 2002, 2003)] == ["a", "A_2", "a_2_2"]
    assert got == {k: f"orders_{k}" for k in range(1, 2001)}


def test_real_text_is_pythons(spark):
    values = [0.0, 1.5, -2.25, 1e-6, 2.5e-7, 0.0005, 0.00012345, 0.1, 12345678.5, 1e7, 1e15, 123456789012345.6, 1e16, 1.5e20, -3.25e-9, 1e100]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["t"] for r in df.select("i", V.text_of(df["v"], df.schema["v"].dataType).alias("t")).orderBy("i").collect()]
    assert got == [str(v) for v in values]


def test_template_and_errors(spark):
    import pytest

    m = spark.createDataFrame([("North", 1, 2, 5)], "split_label string, part_no long, total_parts long, row_count long")
    out = m.select(N.render_template("{original_name}-{split_value}-{part_no:03d}of{total_parts}", {"split_value": "split_label", "part_no": "part_no", "total_parts": "total_parts"}, {"original_name": "sales"}).alias("n"))
    assert out.collect()[0]["n"] == "sales-North-001of2"
    with pytest.raises(ValueError):
        N.render_template("{nope}", {})


def test_clean_trim_collapse_dedupe(spark):
    df = spark.createDataFrame([("  A   B ",), ("  A   B ",)], "Name string")
    out = C.clean(df, C.CleaningOptions(trim_whitespace=True, collapse_whitespace=True, drop_duplicate_rows=True))
    assert [r["Name"] for r in out.collect()] == ["A B"]


def test_clean_orders_differ_only_in_place_of_width(spark):
    df = spark.createDataFrame([("　Ａ　　B",)], "v string")
    live = C.clean_strings(df, trim=True, collapse=True, width=True).collect()[0]["v"]
    first = C.clean_strings(df, trim=True, collapse=True, width=True, order="width_first").collect()[0]["v"]
    assert first == "A B"
    assert live == unicodedata.normalize("NFKC", "Ａ B")


def test_drop_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(" ", None, None), ("a", None, 1.0), (None, None, float("nan"))], "s string, n string, d double")
    rows = C.drop_empty_rows(df)
    assert rows.count() == 1
    assert C.empty_columns(df) == ["n"]
    assert C.drop_empty_columns(df).columns == ["s", "d"]
    assert C.rename_fields(df, {"s": "S", "zz": "q"}).columns == ["S", "n", "d"]


def test_json_text(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1})], "a array<int>, m map<string,int>")
    row = df.select(V.json_text(df["a"], df.schema["a"].dataType).alias("a"), V.json_text(df["m"], df.schema["m"].dataType).alias("m")).collect()[0]
    assert (row["a"], row["m"]) == ("[1,2]", '{"a":1}')
    assert F is not None


def test_python_unicode_backend_agrees(spark):
    texts = ["Ｎａｍｅ（ID）", "Straße", " ﬁle ", "ǅ", "abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")

    def run():
        return [tuple(r) for r in df.select(V.nfkc("v"), V.casefold("v"), V.fold_key("v")).collect()]

    jvm = run()
    V.set_unicode_backend("python")
    try:
        py = run()
    finally:
        V.set_unicode_backend("jvm")
    assert jvm == py


def test_text_of_like_python_str(spark):
    values = [dt.datetime(2024, 1, 1, 0, 0, 7, 179500), dt.datetime(2024, 1, 1, 0, 0, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v timestamp")
    got = [r["t"] for r in df.select(V.text_of(df["v"], df.schema["v"].dataType).alias("t")).collect()]
    assert got == [str(v) for v in values]
    assert _one(spark, float("inf"), "double", V.text_of) == "inf"
    assert _one(spark, False, "boolean", V.text_of) == "False"


def test_names_are_numbered_in_linear_time():
    from tessera.functions.unique import Names

    names = Names(str.casefold)
    wanted = ["a", "A", "a_2", "a_5"] + ["a"] * 60_000 + ["a_2"] * 3
    got = [names.take(n) for n in wanted]
    assert got[:9] == ["a", "A_2", "a_2_2", "a_5", "a_3", "a_4", "a_6", "a_7", "a_8"]
    assert got[-3:] == ["a_2_3", "a_2_4", "a_2_5"] and len({g.casefold() for g in got}) == len(wanted)
    short = Names(limit=4)
    assert [short.take("abcdef") for _ in range(12)][8:] == ["ab_9", "a_10", "a_11", "a_12"]
