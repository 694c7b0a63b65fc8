"""Plan guards: every registered query must plan without all-pairs joins or
row-at-a-time Python, and scans must be pruned."""

import pytest

from tessera.operators.split import split_by_fields
from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_all_pairs_or_row_udfs(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name} plans a {bad}"


def test_split_scan_is_pruned_and_the_manifest_scans_no_more(spark):
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet")
    split = split_by_fields(lineitem, ["l_returnflag"], ["l_orderkey", "l_linenumber"])
    schemas = [line for line in _plan(split.rows.select("split_label")).splitlines() if "ReadSchema" in line]
    assert schemas
    for line in schemas:
        read = line.split("ReadSchema: ", 1)[1]
        assert "l_extendedprice" not in read and "l_shipdate" not in read
    assert "FileScan parquet" not in _plan(split.manifest)  # numbered from its checkpoint


def test_filters_reach_the_scan(spark):
    plan = _plan(QUERIES["u7_same_name"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in plan


def test_header_names_cover_every_column_of_the_report_tables(spark):
    got = {(r["source_sheet"], r["pos"]): r["name"] for r in QUERIES["s5_header_names"](spark, SF).collect()}
    tables = {"region": "r_regionkey", "nation": "n_nationkey", "part": "p_partkey", "orders": "o_orderkey"}
    columns = {t: spark.read.parquet(f"{SF}/{t}.parquet").columns for t in tables}
    assert set(got) == {(t, i) for t in tables for i in range(len(columns[t]))}
    for t, key in tables.items():
        first = spark.read.parquet(f"{SF}/{t}.parquet").orderBy(key).first()
        assert got[t, 0] == f"Report of {t}_{key}_{first[0]}"
        assert all(got[t, i].startswith(f"{c}_") for i, c in enumerate(columns[t]) if i)
