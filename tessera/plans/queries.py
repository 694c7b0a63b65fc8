"""Registered queries over the driver's test tables, with DuckDB oracles.

Every query reads whole tables (``{sf_dir}/{table}.parquet``) and runs the
library's own operator on them.  Where an operator needs inputs the tables
do not have (blank values, text keys, case variants, messy spacing), a small
projection derives them from the table's own columns; that projection only
shapes the input, the operator does the work.  The same derivation appears
in the oracle SQL.

Total orders used for first-appearance semantics: ``o_orderkey``,
``c_custkey``, ``p_partkey``, ``event_id``, ``doc_id``, and for lineitem
``(l_orderkey, l_linenumber, l_partkey, l_suppkey)``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators import aggregate as A
from tessera.operators import cleaning as C
from tessera.operators import dedupe as D
from tessera.operators import hierarchy as H
from tessera.operators import joins as J
from tessera.operators import split as X
from tessera.operators import stack as U
from tessera.operators.ordinals import dense_index
from tessera.sinks.writer import output_names, oversized, write_named, write_split
from tessera.session import checkpoint_dir
from tessera.sources import grid as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_ORDER_SQL = "(l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blank_sql(x: str) -> str:
    return f"({x} IS NULL OR regexp_matches({x}, '^\\s*$'))"


def _numbered_sql(groups: str, extra: str = "") -> str:
    """Manifest numbering in SQL: groups(split_label, row_count, f[, ...])."""
    return (
        f"SELECT split_label, row_number() OVER (ORDER BY f) AS part_no, count(*) OVER () AS total_parts, "
        f"row_count{extra} FROM ({groups})"
    )


# ---------------------------------------------------------------------------
# X: split


def _manifest(split: X.Split) -> DataFrame:
    return split.manifest.select("split_label", "part_no", "total_parts", "row_count")


@query(
    "x1_split_by_field",
    _numbered_sql(
        f"SELECT CASE WHEN {_blank_sql('l_returnflag')} THEN 'EMPTY' ELSE l_returnflag END AS split_label, "
        f"count(*) AS row_count, min({LI_ORDER_SQL}) AS f FROM lineitem GROUP BY 1"
    ),
)
def x1_split_by_field(spark, sf):
    return _manifest(X.split_by_fields(table(spark, sf, "lineitem"), ["l_returnflag"], LI_ORDER))


@query(
    "x2_split_by_fields",
    _numbered_sql(
        f"SELECT 'l_returnflag=' || l_returnflag || ' | l_linestatus=' || l_linestatus AS split_label, "
        f"count(*) AS row_count, min({LI_ORDER_SQL}) AS f FROM lineitem GROUP BY 1"
    ),
)
def x2_split_by_fields(spark, sf):
    return _manifest(X.split_by_fields(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], LI_ORDER))


@query(
    "x3_split_joined_label",
    _numbered_sql(
        f"SELECT l_returnflag || '__' || l_linestatus AS split_label, count(*) AS row_count, "
        f"min({LI_ORDER_SQL}) AS f FROM lineitem GROUP BY 1"
    ),
)
def x3_split_joined_label(spark, sf):
    li = table(spark, sf, "lineitem")
    return _manifest(X.split_by_fields(li, ["l_returnflag", "l_linestatus"], LI_ORDER, label_style="joined"))


def _doc_quality(spark, sf) -> DataFrame:
    """documents with a text quality: NULL when unlabelled, blank when toxic."""
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels")
    q = F.col("quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(q.isNull(), F.lit(None)).when(F.col("toxic") == 1, F.lit("  ")).otherwise(q.cast("string")).alias("quality_text"),
    )


_DOC_QUALITY_SQL = (
    "SELECT doc_id, CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN '  ' "
    "ELSE CAST(l.quality AS VARCHAR) END AS quality_text FROM documents LEFT JOIN labels l USING (doc_id)"
)


@query(
    "p11_split_blank_group",
    _numbered_sql(
        f"SELECT CASE WHEN {_blank_sql('quality_text')} THEN 'EMPTY' ELSE quality_text END AS split_label, "
        f"count(*) AS row_count, min(doc_id) AS f FROM ({_DOC_QUALITY_SQL}) GROUP BY 1"
    ),
)
def p11_split_blank_group(spark, sf):
    return _manifest(X.split_by_fields(_doc_quality(spark, sf), ["quality_text"], ["doc_id"]))


@query(
    "p11_split_blank_skip",
    _numbered_sql(
        f"SELECT quality_text AS split_label, count(*) AS row_count, min(doc_id) AS f "
        f"FROM ({_DOC_QUALITY_SQL}) WHERE NOT {_blank_sql('quality_text')} GROUP BY 1"
    ),
)
def p11_split_blank_skip(spark, sf):
    return _manifest(X.split_by_fields(_doc_quality(spark, sf), ["quality_text"], ["doc_id"], blank_policy="skip"))


@query(
    "k9_reconcile_split_skip",
    f"SELECT count(*) AS input_rows, count(*) FILTER (WHERE NOT {_blank_sql('quality_text')}) AS output_rows, "
    f"count(*) FILTER (WHERE {_blank_sql('quality_text')}) AS excluded_rows, true AS balanced FROM ({_DOC_QUALITY_SQL})",
)
def k9_reconcile_split_skip(spark, sf):
    split = X.split_by_fields(_doc_quality(spark, sf), ["quality_text"], ["doc_id"], blank_policy="skip")
    return split.reconciliation().select("input_rows", "output_rows", "excluded_rows", "balanced")


@query(
    "x4_split_fixed_rows",
    "SELECT *, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS VARCHAR) AS split_label, "
    "(row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS part_no, CAST(greatest(1, ceil(count(*) OVER () / 1000.0)) AS BIGINT) AS total_parts FROM orders",
)
def x4_split_fixed_rows(spark, sf):
    return X.split_fixed_rows(table(spark, sf, "orders"), 1000, ["o_orderkey"]).rows


@query(
    "x4_split_lineitem",
    "SELECT *, CAST((rn - 1) // 7000 + 1 AS VARCHAR) AS split_label, (rn - 1) // 7000 + 1 AS part_no, "
    "CAST(greatest(1, ceil(count(*) OVER () / 7000.0)) AS BIGINT) AS total_parts FROM ("
    "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)",
)
def x4_split_lineitem(spark, sf):
    """X4 over whole rows of the largest table, with the row's number."""
    split = X.split_fixed_rows(table(spark, sf, "lineitem"), 7000, LI_ORDER)
    numbered = dense_index(split.rows, LI_ORDER, name="rn").withColumn("rn", F.col("rn") + 1)
    return numbered.select(*table(spark, sf, "lineitem").columns, "rn", "split_label", "part_no", "total_parts")


@query(
    "x1_manifest_many_groups",
    "SELECT *, 'orders_' || lpad(CAST(part_no AS VARCHAR), greatest(3, length(CAST(part_no AS VARCHAR)))::INT, '0') AS output_name FROM ("
    + _numbered_sql("SELECT CAST(o_orderkey AS VARCHAR) AS split_label, count(*) AS row_count, min(o_orderkey) AS f FROM orders GROUP BY 1")
    + ")",
)
def x1_manifest_many_groups(spark, sf):
    """Thousands of groups numbered and named, with part numbers wider than the template's width."""
    split = X.split_by_fields(table(spark, sf, "orders"), ["o_orderkey"], ["o_orderkey"])
    named = output_names(split.manifest, "{original_name}_{part_no:03d}", {"original_name": "orders"})
    return named.select("split_label", "part_no", "total_parts", "row_count", "output_name")


@query(
    "x1_manifest_by_customer",
    _numbered_sql("SELECT CAST(o_custkey AS VARCHAR) AS split_label, count(*) AS row_count, min(o_orderkey) AS f FROM orders GROUP BY 1"),
)
def x1_manifest_by_customer(spark, sf):
    return _manifest(X.split_by_fields(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"]))


@query(
    "x6_written_parts",
    "SELECT CAST(p AS VARCHAR) AS split_label, count(*) AS row_count, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key "
    "FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1",
)
def x6_written_parts(spark, sf):
    """The rows of each part, counted from the labelled rows themselves."""
    rows = X.split_into_parts(table(spark, sf, "orders"), 7, ["o_orderkey"]).rows
    return rows.groupBy("split_label").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


_K_BALANCED = "(SELECT CAST(greatest(1, ceil(count(*) / 1000.0)) AS BIGINT) FROM orders)"


@query(
    "x5_split_balanced",
    f"SELECT *, CAST(ntile({_K_BALANCED}) OVER (ORDER BY o_orderkey) AS VARCHAR) AS split_label, CAST(ntile({_K_BALANCED}) OVER (ORDER BY o_orderkey) AS BIGINT) AS part_no, "
    f"least({_K_BALANCED}, count(*) OVER ()) AS total_parts FROM orders",
)
def x5_split_balanced(spark, sf):
    return X.split_fixed_rows(table(spark, sf, "orders"), 1000, ["o_orderkey"], balanced=True).rows


@query(
    "x6_split_parts",
    "SELECT *, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS VARCHAR) AS split_label, "
    "CAST(ntile(7) OVER (ORDER BY o_orderkey) AS BIGINT) AS part_no, least(7, count(*) OVER ()) AS total_parts FROM orders",
)
def x6_split_parts(spark, sf):
    return X.split_into_parts(table(spark, sf, "orders"), 7, ["o_orderkey"]).rows


@query(
    "x6_parts_manifest",
    "SELECT CAST(p AS VARCHAR) AS split_label, p AS part_no, CAST(7 AS BIGINT) AS total_parts, count(*) AS row_count "
    "FROM (SELECT CAST(ntile(7) OVER (ORDER BY o_orderkey) AS BIGINT) AS p FROM orders) GROUP BY p",
)
def x6_parts_manifest(spark, sf):
    return X.split_into_parts(table(spark, sf, "orders"), 7, ["o_orderkey"]).manifest


@query(
    "x7_split_by_table",
    "SELECT 'customer' AS split_label, CAST(1 AS BIGINT) AS part_no, CAST(2 AS BIGINT) AS total_parts, count(*) AS row_count FROM customer "
    "UNION ALL SELECT 'supplier', 2, 2, count(*) FROM supplier",
)
def x7_split_by_table(spark, sf):
    split = X.split_by_table([("customer", table(spark, sf, "customer")), ("supplier", table(spark, sf, "supplier"))])
    return split.manifest


# ---------------------------------------------------------------------------
# H: hierarchy over customer -> nation -> region, segment spelled two ways


def _hier(spark, sf) -> DataFrame:
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    seg = F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select("c_custkey", F.col("r_name").alias("region"), F.col("n_name").alias("nation"), seg.alias("segment"))
    )


_HIER_SQL = (
    "SELECT c_custkey, r_name AS region, n_name AS nation, "
    "CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)


def _canon_sql(x: str) -> str:
    return f"lower(trim({x}))"


def _hier_sql(group_fields, where: str, label: str) -> str:
    keys = ", ".join(_canon_sql(f) for f in group_fields)
    groups = (
        f"SELECT {label} AS split_label, count(*) AS row_count, min(c_custkey) AS f "
        f"FROM ({_HIER_SQL}) WHERE {where} GROUP BY {keys}"
    )
    return _numbered_sql(groups)


def _first(x: str) -> str:
    return f"arg_min(trim({x}), c_custkey)"


H2_FILTERS = {"region": "ASIA"}
H3_FILTERS = {"region": "ASIA", "nation": "NATION_12"}
H4_FILTERS = {"region": ["ASIA", "EUROPE"]}
P10_FILTERS = {"region": ["ASIA", "EUROPE"], "nation": ["NATION_2", "NATION_7", "NATION_3"]}


@query("h2_hierarchy_two_level", _hier_sql(["nation"], "lower(trim(region)) = 'asia'", _first("nation")))
def h2_hierarchy_two_level(spark, sf):
    return _manifest(H.split_by_hierarchy(_hier(spark, sf), ["region", "nation"], H2_FILTERS, "nation", ["c_custkey"]))


@query(
    "h3_hierarchy_three_level",
    _hier_sql(["segment"], "lower(trim(region)) = 'asia' AND lower(trim(nation)) = 'nation_12'", _first("segment")),
)
def h3_hierarchy_three_level(spark, sf):
    df = _hier(spark, sf)
    return _manifest(H.split_by_hierarchy(df, ["region", "nation", "segment"], H3_FILTERS, "segment", ["c_custkey"]))


@query(
    "h4_hierarchy_path",
    _hier_sql(
        ["region", "nation"],
        "lower(trim(region)) IN ('asia', 'europe')",
        "arg_min(trim(region) || '__' || trim(nation), c_custkey)",
    ),
)
def h4_hierarchy_path(spark, sf):
    return _manifest(H.split_by_hierarchy(_hier(spark, sf), ["region", "nation"], H4_FILTERS, "nation", ["c_custkey"]))


@query(
    "p10_hierarchy_or_and",
    _hier_sql(
        ["region", "nation", "segment"],
        "lower(trim(region)) IN ('asia', 'europe') AND lower(trim(nation)) IN ('nation_2', 'nation_7', 'nation_3')",
        "arg_min(trim(region) || '__' || trim(nation) || '__' || trim(segment), c_custkey)",
    ),
)
def p10_hierarchy_or_and(spark, sf):
    df = _hier(spark, sf)
    return _manifest(H.split_by_hierarchy(df, ["region", "nation", "segment"], P10_FILTERS, "segment", ["c_custkey"]))


_CAT_FILTERS = {"region": ["ASIA", "EUROPE"], "nation": ["NATION_2", "NATION_8"]}


def _catalog_level_sql(level: int, field: str, where: str) -> str:
    return (
        f"SELECT {level} AS level, '{field}' AS field, row_number() OVER (ORDER BY f) AS position, value, "
        f"count(*) OVER () AS candidate_count, count(*) OVER () > 500 AS truncated FROM ("
        f"SELECT {_canon_sql(field)} AS k, min(c_custkey) AS f, {_first(field)} AS value "
        f"FROM ({_HIER_SQL}) WHERE {where} GROUP BY 1)"
    )


@query(
    "h8_hierarchy_catalog",
    _catalog_level_sql(1, "region", "true")
    + " UNION ALL "
    + _catalog_level_sql(2, "nation", "lower(trim(region)) IN ('asia', 'europe')"),
)
def h8_hierarchy_catalog(spark, sf):
    cat = H.hierarchy_catalog(_hier(spark, sf), ["region", "nation", "segment"], _CAT_FILTERS, "segment", ["c_custkey"])
    return cat.values


@query(
    "h8_hierarchy_catalog_summary",
    f"SELECT count(*) AS matched_rows, count(DISTINCT ({_canon_sql('region')}, {_canon_sql('nation')}, "
    f"{_canon_sql('segment')})) AS target_count, true AS complete_filters FROM ({_HIER_SQL}) "
    f"WHERE lower(trim(region)) IN ('asia', 'europe') AND lower(trim(nation)) IN ('nation_2', 'nation_8')",
)
def h8_hierarchy_catalog_summary(spark, sf):
    cat = H.hierarchy_catalog(_hier(spark, sf), ["region", "nation", "segment"], _CAT_FILTERS, "segment", ["c_custkey"])
    return cat.summary


@query(
    "h11_hierarchy_manifest",
    "SELECT split_label, part_no, total_parts, row_count, 'segment' AS split_field, 'ASIA__NATION_12' AS hierarchy_path, "
    "level1_value, level2_value, level3_value, 'ASIA__NATION_12_' || split_label AS output_name FROM ("
    "SELECT *, row_number() OVER (ORDER BY f) AS part_no, count(*) OVER () AS total_parts FROM ("
    f"SELECT {_first('segment')} AS split_label, count(*) AS row_count, min(c_custkey) AS f, "
    f"{_first('region')} AS level1_value, {_first('nation')} AS level2_value, {_first('segment')} AS level3_value "
    f"FROM ({_HIER_SQL}) WHERE lower(trim(region)) = 'asia' AND lower(trim(nation)) = 'nation_12' "
    f"GROUP BY {_canon_sql('segment')}))",
)
def h11_hierarchy_manifest(spark, sf):
    df = _hier(spark, sf)
    split = H.split_by_hierarchy(df, ["region", "nation", "segment"], H3_FILTERS, "segment", ["c_custkey"])
    return output_names(split.manifest, "{hierarchy_path}_{split_value}")


@query(
    "k9_reconcile_hierarchy",
    "SELECT count(*) AS input_rows, count(*) FILTER (WHERE lower(trim(region)) = 'asia' AND lower(trim(nation)) = 'nation_12') "
    "AS output_rows, count(*) FILTER (WHERE NOT (lower(trim(region)) = 'asia' AND lower(trim(nation)) = 'nation_12')) "
    f"AS excluded_rows, true AS balanced FROM ({_HIER_SQL})",
)
def k9_reconcile_hierarchy(spark, sf):
    df = _hier(spark, sf)
    split = H.split_by_hierarchy(df, ["region", "nation", "segment"], H3_FILTERS, "segment", ["c_custkey"])
    return split.reconciliation().select("input_rows", "output_rows", "excluded_rows", "balanced")


def _hier_blanks(spark, sf) -> DataFrame:
    """the hierarchy with a blank segment for balances between 0 and 500"""
    h = _hier(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    seg = F.when(F.col("c_acctbal").between(0, 500), F.lit("  ")).otherwise(F.col("segment"))
    return h.select("c_custkey", "region", "nation", seg.alias("segment"))


_HIER_BLANKS_SQL = (
    f"SELECT h.c_custkey, region, nation, CASE WHEN c.c_acctbal BETWEEN 0 AND 500 THEN '  ' ELSE segment END AS segment "
    f"FROM ({_HIER_SQL}) h JOIN customer c USING (c_custkey)"
)


@query(
    "h6_hierarchy_blank_skip",
    _numbered_sql(
        f"SELECT {_first('segment')} AS split_label, count(*) AS row_count, min(c_custkey) AS f FROM ({_HIER_BLANKS_SQL}) "
        "WHERE lower(trim(region)) = 'asia' AND lower(trim(nation)) = 'nation_12' AND trim(segment) <> '' "
        f"GROUP BY {_canon_sql('segment')}"
    ),
)
def h6_hierarchy_blank_skip(spark, sf):
    split = H.split_by_hierarchy(
        _hier_blanks(spark, sf), ["region", "nation", "segment"], H3_FILTERS, "segment", ["c_custkey"], blank_policy="skip"
    )
    return _manifest(split)


@query(
    "k10_excluded_by_reason",
    "SELECT count(*) AS input_rows, "
    "count(*) FILTER (WHERE lower(trim(region)) = 'asia' AND lower(trim(nation)) = 'nation_12' AND trim(segment) <> '') AS output_rows, "
    "count(*) FILTER (WHERE NOT (lower(trim(region)) = 'asia' AND lower(trim(nation)) = 'nation_12')) AS out_of_scope, "
    "count(*) FILTER (WHERE lower(trim(region)) = 'asia' AND lower(trim(nation)) = 'nation_12' AND trim(segment) = '') AS blank "
    f"FROM ({_HIER_BLANKS_SQL})",
)
def k10_excluded_by_reason(spark, sf):
    split = H.split_by_hierarchy(
        _hier_blanks(spark, sf), ["region", "nation", "segment"], H3_FILTERS, "segment", ["c_custkey"], blank_policy="skip"
    )
    rec = split.reconciliation()
    return rec.select(
        "input_rows",
        "output_rows",
        F.coalesce(F.col("excluded_by")["out_of_scope"], F.lit(0)).cast("long").alias("out_of_scope"),
        F.coalesce(F.col("excluded_by")["blank"], F.lit(0)).cast("long").alias("blank"),
    )


@query(
    "k6_output_names",
    "SELECT split_label, part_no, CASE WHEN rn = 1 THEN split_label ELSE split_label || '_' || rn END AS output_name FROM ("
    "SELECT *, row_number() OVER (PARTITION BY lower(split_label) ORDER BY part_no) AS rn FROM ("
    "SELECT split_label, row_number() OVER (ORDER BY f) AS part_no FROM ("
    f"SELECT segment AS split_label, min(c_custkey) AS f FROM ({_HIER_SQL}) GROUP BY 1)))",
)
def k6_output_names(spark, sf):
    split = X.split_by_fields(_hier(spark, sf), ["segment"], ["c_custkey"])
    return output_names(split.manifest, "{split_value}").select("split_label", "part_no", "output_name")


@query(
    "f13_f15_output_names",
    "SELECT split_label, part_no, row_count, "
    "'part_' || regexp_replace(split_label, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g') || '_' || lpad(CAST(part_no AS VARCHAR), 3, '0') "
    "AS output_name FROM ("
    + _numbered_sql(
        "SELECT 'p_brand=' || p_brand || ' | p_type=' || p_type AS split_label, count(*) AS row_count, "
        "min(p_partkey) AS f FROM part GROUP BY 1"
    )
    + ")",
)
def f13_f15_output_names(spark, sf):
    split = X.split_by_fields(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_partkey"])
    named = output_names(split.manifest, "{original_name}_{split_value}_{part_no:03d}", {"original_name": "part"})
    return named.select("split_label", "part_no", "row_count", "output_name")


# ---------------------------------------------------------------------------
# U: stacking customer and supplier


def _cs_sources(spark, sf, supplier_names: dict[str, str] | None = None, customer_cols=None):
    cust = table(spark, sf, "customer")
    if customer_cols:
        cust = cust.select(*customer_cols)
    supp = table(spark, sf, "supplier")
    if supplier_names:
        supp = supp.withColumnsRenamed(supplier_names)
    return [U.Source("customer.parquet", "customer", cust), U.Source("supplier.parquet", "supplier", supp)]


_FULL_RENAME = {"s_suppkey": "c_custkey", "s_name": "c_name", "s_nationkey": "c_nationkey", "s_acctbal": "c_acctbal"}
_PART_RENAME = {"s_suppkey": "c_custkey", "s_name": "c_name", "s_acctbal": "c_acctbal"}
_PROV_C = "'customer.parquet' AS Source_File, 'customer' AS Source_Sheet"
_PROV_S = "'supplier.parquet' AS Source_File, 'supplier' AS Source_Sheet"


@query(
    "u1_stack_strict",
    f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, {_PROV_C} FROM customer UNION ALL "
    f"SELECT s_suppkey, s_name, s_nationkey, s_acctbal, {_PROV_S} FROM supplier",
)
def u1_stack_strict(spark, sf):
    srcs = _cs_sources(spark, sf, _FULL_RENAME, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    return U.stack_sources(srcs, U.STRICT)


@query(
    "u2_stack_align",
    f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS INTEGER) AS s_nationkey, {_PROV_C} "
    f"FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, NULL, s_nationkey, {_PROV_S} FROM supplier",
)
def u2_stack_align(spark, sf):
    return U.stack_sources(_cs_sources(spark, sf, _PART_RENAME), U.ALIGN)


@query(
    "u3_stack_union",
    f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS INTEGER) AS s_nationkey, {_PROV_C} "
    f"FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, NULL, s_nationkey, {_PROV_S} FROM supplier",
)
def u3_stack_union(spark, sf):
    return U.stack_sources(_cs_sources(spark, sf, _PART_RENAME), U.UNION)


@query(
    "u4_stack_intersection",
    f"SELECT c_custkey, c_name, c_acctbal, {_PROV_C} FROM customer UNION ALL "
    f"SELECT s_suppkey, s_name, s_acctbal, {_PROV_S} FROM supplier",
)
def u4_stack_intersection(spark, sf):
    return U.stack_sources(_cs_sources(spark, sf, _PART_RENAME), U.INTERSECTION)


@query(
    "u5_stack_master",
    f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, {_PROV_C} FROM customer UNION ALL "
    f"SELECT s_suppkey, s_name, NULL, s_acctbal, NULL, {_PROV_S} FROM supplier",
)
def u5_stack_master(spark, sf):
    return U.stack_sources(_cs_sources(spark, sf, _PART_RENAME), U.MASTER)


@query(
    "u6_stack_position",
    f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, {_PROV_C} FROM customer UNION ALL "
    f"SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, {_PROV_S} FROM supplier",
)
def u6_stack_position(spark, sf):
    return U.stack_sources(_cs_sources(spark, sf), U.POSITION)


@query(
    "u2_stack_type_conflict",
    "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL "
    "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) FROM lineitem",
)
def u2_stack_type_conflict(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("o_orderstatus"))
    return U.stack([o, li], U.ALIGN)


def _order_slices(spark, sf):
    o = table(spark, sf, "orders")
    return [
        U.Source("orders.parquet", "Orders", o.filter(F.col("o_orderstatus") == "F")),
        U.Source("orders.parquet", "ORDERS", o.filter(F.col("o_orderstatus") == "O")),
        U.Source("orders.parquet", "Pending", o.filter(F.col("o_orderstatus") == "P")),
    ]


@query(
    "u7_same_name",
    "SELECT *, 'orders.parquet' AS Source_File, CASE o_orderstatus WHEN 'F' THEN 'Orders' WHEN 'O' THEN 'ORDERS' ELSE 'Pending' END "
    "AS Source_Sheet, CASE WHEN o_orderstatus = 'P' THEN 'Pending_Combined' ELSE 'Orders_Combined' END AS split_label "
    "FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')",
)
def u7_same_name(spark, sf):
    return U.combine_named(U.consolidate_same_name(_order_slices(spark, sf)))


@query(
    "u7_same_name_dedupe",
    "SELECT DISTINCT *, 'orders.parquet' AS Source_File, 'Orders_Combined' AS split_label FROM orders",
)
def u7_same_name_dedupe(spark, sf):
    """U7 + D1: tables named alike (case-folded) are stacked and deduplicated
    inside their group; the file name takes part in the dedupe, the table name
    is left out."""
    o = table(spark, sf, "orders")
    sources = [
        U.Source("orders.parquet", "Orders", o.filter(F.col("o_orderstatus") == "F")),
        U.Source("orders.parquet", "ORDERS", o),
    ]
    groups = U.consolidate_same_name(sources, dedupe=lambda df: D.dedupe(df, D.ALL), add_sheet=False)
    return U.combine_named(groups)


def _crm_sources(spark, sf):
    return [
        U.Source("crm.parquet", "Accounts", table(spark, sf, "customer")),
        U.Source("crm.parquet", "ACCOUNTS", table(spark, sf, "supplier")),
    ]


def _catalog_counts(spark, sf, conflict):
    return U.consolidate_catalog(_crm_sources(spark, sf), conflict).groupBy("target_table").agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "u8_catalog_rename",
    "SELECT 'crm_Accounts' AS target_table, count(*) AS row_count FROM customer UNION ALL "
    "SELECT 'crm_ACCOUNTS_2', count(*) FROM supplier",
)
def u8_catalog_rename(spark, sf):
    return _catalog_counts(spark, sf, U.RENAME)


@query("u8_catalog_skip", "SELECT 'crm_Accounts' AS target_table, count(*) AS row_count FROM customer")
def u8_catalog_skip(spark, sf):
    return _catalog_counts(spark, sf, U.SKIP)


@query("u8_catalog_replace", "SELECT 'crm_ACCOUNTS' AS target_table, count(*) AS row_count FROM supplier")
def u8_catalog_replace(spark, sf):
    return _catalog_counts(spark, sf, U.REPLACE)


# ---------------------------------------------------------------------------
# D / A: dedupe and aggregate


@query("d1_dedupe_all", "SELECT DISTINCT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders)")
def d1_dedupe_all(spark, sf):
    o = table(spark, sf, "orders")
    return D.dedupe(U.stack([o, o], U.STRICT), D.ALL)


@query(
    "d2_dedupe_fields_first",
    "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
)
def d2_dedupe_fields_first(spark, sf):
    return D.dedupe(table(spark, sf, "events"), D.FIELDS, ["user_id", "event_type"], "first", ["event_id"])


@query(
    "d2_dedupe_fields_last",
    "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
)
def d2_dedupe_fields_last(spark, sf):
    return D.dedupe(table(spark, sf, "events"), D.FIELDS, ["user_id", "event_type"], "last", ["event_id"])


def _li_agg(spark, sf, method):
    return A.aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], method)


@query(
    "a1_agg_sum",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, "
    "round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1, 2",
)
def a1_agg_sum(spark, sf):
    return _li_agg(spark, sf, "sum").select(
        "l_returnflag", "l_linestatus", F.round("l_quantity", 2).alias("l_quantity"), F.round("l_extendedprice", 2).alias("l_extendedprice")
    )


@query(
    "a2_agg_mean",
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity, "
    "round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2",
)
def a2_agg_mean(spark, sf):
    return _li_agg(spark, sf, "mean").select(
        "l_returnflag", "l_linestatus", F.round("l_quantity", 4).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice")
    )


@query(
    "a3_agg_min",
    "SELECT l_returnflag, l_linestatus, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice "
    "FROM lineitem GROUP BY 1, 2",
)
def a3_agg_min(spark, sf):
    return _li_agg(spark, sf, "min")


@query(
    "a4_agg_max",
    "SELECT l_returnflag, l_linestatus, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice "
    "FROM lineitem GROUP BY 1, 2",
)
def a4_agg_max(spark, sf):
    return _li_agg(spark, sf, "max")


@query(
    "a5_agg_count",
    "SELECT l_returnflag, l_linestatus, count(l_quantity) AS l_quantity, count(l_extendedprice) AS l_extendedprice "
    "FROM lineitem GROUP BY 1, 2",
)
def a5_agg_count(spark, sf):
    return _li_agg(spark, sf, "count")


@query(
    "a6_agg_nunique",
    "SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey "
    "FROM lineitem GROUP BY 1, 2",
)
def a6_agg_nunique(spark, sf):
    return A.aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_partkey", "l_suppkey"], "nunique")


def _events_text(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", "event_type", text.alias("value_text"))


_EVENTS_TEXT_SQL = (
    "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN props ELSE CAST(value AS VARCHAR) END AS value_text FROM events"
)


@query(
    "a1_agg_sum_text",
    "SELECT event_type, round(coalesce(sum(TRY_CAST(value_text AS DOUBLE)), 0), 2) AS value_text, "
    f"round(avg(TRY_CAST(value_text AS DOUBLE)), 4) AS mean_value FROM ({_EVENTS_TEXT_SQL}) GROUP BY 1",
)
def a1_agg_sum_text(spark, sf):
    ev = _events_text(spark, sf)
    total = A.aggregate(ev, ["event_type"], ["value_text"], "sum")
    mean = A.aggregate(ev, ["event_type"], ["value_text"], "mean").withColumnRenamed("value_text", "mean_value")
    return total.join(mean, "event_type").select(
        "event_type", F.round("value_text", 2).alias("value_text"), F.round("mean_value", 4).alias("mean_value")
    )


@query(
    "f10_to_number",
    f"SELECT event_id, TRY_CAST(value_text AS DOUBLE) AS number FROM ({_EVENTS_TEXT_SQL})",
)
def f10_to_number(spark, sf):
    ev = _events_text(spark, sf)
    return ev.select("event_id", V.to_number(ev["value_text"], ev.schema["value_text"].dataType).alias("number"))


@query(
    "a7_agg_over_stack",
    "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM ("
    "SELECT DISTINCT * FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders)"
    ") GROUP BY 1",
)
def a7_agg_over_stack(spark, sf):
    o = table(spark, sf, "orders")
    merged = U.stack([o.filter(F.col("o_orderstatus") == "F"), o], U.ALIGN)
    agg = A.aggregate(D.dedupe(merged, D.ALL), ["o_orderpriority"], ["o_totalprice"], "sum")
    return agg.select("o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))


# ---------------------------------------------------------------------------
# J: joins of customer and orders


def _all_customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")


def _order_refs(spark, sf) -> DataFrame:
    """orders with a text reference to the customer name, upper-cased and padded."""
    o = table(spark, sf, "orders")
    ref = F.concat(F.lit(" "), F.upper(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))), F.lit("  "))
    return o.select("o_orderkey", "o_totalprice", ref.alias("cust_ref"))


_CUSTOMERS_SQL = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
_REFS_SQL = "SELECT o_orderkey, o_totalprice, ' ' || upper('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) || '  ' AS cust_ref FROM orders"


def _ref_join_sql(how: str) -> str:
    return (
        f"SELECT c_custkey, c_name, c_mktsegment, o_orderkey, o_totalprice, cust_ref FROM ({_CUSTOMERS_SQL}) m "
        f"{how} JOIN ({_REFS_SQL}) r ON lower(trim(m.c_name)) = lower(trim(r.cust_ref))"
    )


def _ref_join(spark, sf, how):
    spec = J.JoinSpec(["c_name"], ["cust_ref"], how=how)
    return J.key_join(_all_customers(spark, sf), _order_refs(spark, sf), spec)


@query("j1_join_left", _ref_join_sql("LEFT"))
def j1_join_left(spark, sf):
    return _ref_join(spark, sf, "left").df


@query("j2_join_right", _ref_join_sql("RIGHT"))
def j2_join_right(spark, sf):
    return _ref_join(spark, sf, "right").df


@query("j2_join_inner", _ref_join_sql("INNER"))
def j2_join_inner(spark, sf):
    return _ref_join(spark, sf, "inner").df


@query("j2_join_outer", _ref_join_sql("FULL OUTER"))
def j2_join_outer(spark, sf):
    return _ref_join(spark, sf, "outer").df


@query(
    "j13_join_diagnostics",
    "SELECT count(*) FILTER (WHERE m.c_custkey IS NOT NULL AND r.o_orderkey IS NOT NULL) AS matched, "
    "count(*) FILTER (WHERE r.o_orderkey IS NULL) AS main_only, count(*) FILTER (WHERE m.c_custkey IS NULL) AS related_only, "
    f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ({_REFS_SQL}) GROUP BY lower(trim(cust_ref)) HAVING count(*) > 1)) "
    f"AS duplicates FROM ({_CUSTOMERS_SQL}) m FULL OUTER JOIN ({_REFS_SQL}) r ON lower(trim(m.c_name)) = lower(trim(r.cust_ref))",
)
def j13_join_diagnostics(spark, sf):
    return _ref_join(spark, sf, "outer").diagnostics.select(
        "matched", "main_only", "related_only", F.col("duplicates").cast("bigint")
    )


def _segment_stats(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("nation_ref"), F.upper("c_mktsegment").alias("segment_ref")).agg(
        F.count(F.lit(1)).alias("n_customers")
    )


@query(
    "j1_join_composite",
    "SELECT c_custkey, c_nationkey, c_mktsegment, nation_ref, segment_ref, n_customers FROM customer m JOIN ("
    "SELECT c_nationkey AS nation_ref, upper(c_mktsegment) AS segment_ref, count(*) AS n_customers FROM customer GROUP BY 1, 2) r "
    "ON CAST(m.c_nationkey AS VARCHAR) = CAST(r.nation_ref AS VARCHAR) AND lower(trim(m.c_mktsegment)) = lower(trim(r.segment_ref))",
)
def j1_join_composite(spark, sf):
    main = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    spec = J.JoinSpec(["c_nationkey", "c_mktsegment"], ["nation_ref", "segment_ref"], how="inner")
    return J.key_join(main, _segment_stats(spark, sf), spec).df


def _blank_ref_customers(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_name")).alias("ref"))


def _blank_ref_orders(spark, sf):
    r = _order_refs(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return r.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("   ")).otherwise(F.col("cust_ref")).alias("cust_ref"))


_BLANK_CUST_SQL = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS ref FROM customer"
_BLANK_REFS_SQL = (
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '   ' ELSE ' ' || upper('Customer#' || "
    "lpad(CAST(o_custkey AS VARCHAR), 9, '0')) || '  ' END AS cust_ref FROM orders"
)


@query(
    "j4_join_empty_keys_unmatched",
    f"SELECT c_custkey, ref, o_orderkey, cust_ref FROM ({_BLANK_CUST_SQL}) m LEFT JOIN ({_BLANK_REFS_SQL}) r "
    "ON lower(trim(m.ref)) = lower(trim(r.cust_ref)) AND lower(trim(m.ref)) <> ''",
)
def j4_join_empty_keys_unmatched(spark, sf):
    spec = J.JoinSpec(["ref"], ["cust_ref"], how="left")
    return J.key_join(_blank_ref_customers(spark, sf), _blank_ref_orders(spark, sf), spec).df


@query(
    "j4_join_empty_keys_match_first",
    f"SELECT c_custkey, ref, o_orderkey, cust_ref FROM ({_BLANK_CUST_SQL}) m LEFT JOIN ("
    f"SELECT * FROM ({_BLANK_REFS_SQL}) QUALIFY row_number() OVER (PARTITION BY coalesce(lower(trim(cust_ref)), '') "
    "ORDER BY o_orderkey) = 1) r ON coalesce(lower(trim(m.ref)), '') = coalesce(lower(trim(r.cust_ref)), '')",
)
def j4_join_empty_keys_match_first(spark, sf):
    spec = J.JoinSpec(["ref"], ["cust_ref"], how="left", empty_keys_match=True, duplicate_policy="first")
    return J.key_join(_blank_ref_customers(spark, sf), _blank_ref_orders(spark, sf), spec, related_order=["o_orderkey"]).df


def _cust_orders(spark, sf, policy, how="left", order="o_orderkey"):
    main = table(spark, sf, "customer").select("c_custkey", "c_name")
    rel = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    spec = J.JoinSpec(["c_custkey"], ["o_custkey"], how=how, duplicate_policy=policy)
    return J.key_join(main, rel, spec, related_order=[order])


def _dup_sql(direction: str) -> str:
    return (
        "SELECT c_custkey, c_name, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM customer LEFT JOIN ("
        f"SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {direction}) = 1) r "
        "ON CAST(c_custkey AS VARCHAR) = CAST(o_custkey AS VARCHAR)"
    )


@query("j7_dup_first", _dup_sql("ASC"))
def j7_dup_first(spark, sf):
    return _cust_orders(spark, sf, "first").df


@query("j7_dup_last", _dup_sql("DESC"))
def j7_dup_last(spark, sf):
    return _cust_orders(spark, sf, "last").df


@query(
    "j8_dup_aggregate",
    "SELECT c_custkey, c_name, o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus FROM customer LEFT JOIN ("
    "SELECT CAST(o_custkey AS VARCHAR) AS k, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey, arg_min(o_custkey, o_orderkey) AS o_custkey, "
    "sum(o_totalprice) AS o_totalprice, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) r "
    "ON CAST(c_custkey AS VARCHAR) = r.k",
)
def j8_dup_aggregate(spark, sf):
    df = _cust_orders(spark, sf, "aggregate").df
    return df.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "j8_dup_aggregate_int",
    "SELECT c_custkey, k, keys FROM customer LEFT JOIN (SELECT o_custkey AS k, CAST(sum((o_orderkey * 40000) % 2147483647) AS BIGINT) AS keys "
    "FROM orders GROUP BY 1) ON c_custkey = k",
)
def j8_dup_aggregate_int(spark, sf):
    """J8 over a 32-bit column whose sums do not fit 32 bits."""
    main = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders")
    rel = o.select(
        F.col("o_custkey").alias("k"), "o_orderkey", ((F.col("o_orderkey") * 40000) % 2147483647).cast("int").alias("keys")
    )
    spec = J.JoinSpec(["c_custkey"], ["k"], how="left", duplicate_policy="aggregate")
    return J.key_join(main, rel, spec, related_order=["o_orderkey"]).df.select("c_custkey", "k", "keys")


@query(
    "j2_join_outer_blank_keys",
    "SELECT c_custkey, ref AS ref_main, o_orderkey, oref AS ref_related FROM ("
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE c_name END AS ref FROM customer) c FULL JOIN ("
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS oref "
    "FROM orders) o ON nullif(lower(trim(ref)), '') = nullif(lower(trim(oref)), '')",
)
def j2_join_outer_blank_keys(spark, sf):
    """A full outer join of all customers with all orders, many keys blank on either side."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    main = c.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" ")).otherwise(F.col("c_name")).alias("ref"))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    rel = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", name).alias("ref"))
    return J.key_join(main, rel, J.JoinSpec(["ref"], ["ref"], how="outer")).df


@query(
    "j2_join_outer_hot_key",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k, o_orderkey, o_custkey, rk FROM ("
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_orderkey END AS k "
    "FROM lineitem) l FULL JOIN (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey < 4 THEN -1 WHEN o_custkey % 4 = 0 THEN -2 "
    "ELSE o_orderkey END AS rk FROM orders) o ON k = rk",
)
def j2_join_outer_hot_key(spark, sf):
    """A full outer join in which one key holds a third of one side and another key a quarter of the other side alone."""
    key = F.col("l_orderkey")
    main = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(key % 3 == 0, F.lit(-1)).otherwise(key).alias("k")
    )
    other = F.when(F.col("o_orderkey") < 4, F.lit(-1)).when(F.col("o_custkey") % 4 == 0, F.lit(-2)).otherwise(F.col("o_orderkey"))
    rel = table(spark, sf, "orders").select("o_orderkey", "o_custkey", other.alias("rk"))
    return J.key_join(main, rel, J.JoinSpec(["k"], ["rk"], how="outer", heavy_rows=1000)).df


@query(
    "j9_dup_both",
    "SELECT o_orderkey, o_custkey, o_orderstatus, c_custkey, c_name FROM ("
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) m "
    "JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)",
)
def j9_dup_both(spark, sf):
    main = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rel = table(spark, sf, "customer").select("c_custkey", "c_name")
    spec = J.JoinSpec(["o_custkey"], ["c_custkey"], how="inner", duplicate_policy="first", dedupe_sides="both")
    return J.key_join(main, rel, spec, main_order=["o_orderkey"], related_order=["c_custkey"]).df


def _status_pair(spark, sf):
    c = table(spark, sf, "customer")
    main = c.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("status"))
    rel = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return main, rel


_STATUS_SQL = (
    "(SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '  ' ELSE c_mktsegment END AS status FROM customer) m LEFT JOIN "
    "(SELECT o_custkey, o_orderkey, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_orderkey) = 1) r ON CAST(m.c_custkey AS VARCHAR) = CAST(r.o_custkey AS VARCHAR)"
)


def _status_join(spark, sf, policy, suffixes=("_main", "_related")):
    main, rel = _status_pair(spark, sf)
    spec = J.JoinSpec(
        ["c_custkey"], ["o_custkey"], duplicate_policy="first", conflict_policy=policy,
        main_suffix=suffixes[0], related_suffix=suffixes[1],
    )
    return J.key_join(main, rel, spec, related_order=["o_orderkey"]).df


@query(
    "j11_conflicts_keep_both",
    f"SELECT c_custkey, m.status AS status_main, o_custkey, o_orderkey, r.status AS status_related FROM {_STATUS_SQL}",
)
def j11_conflicts_keep_both(spark, sf):
    return _status_join(spark, sf, "keep_both")


@query(
    "j12_conflicts_prefer_main",
    f"SELECT c_custkey, o_custkey, o_orderkey, CASE WHEN {_blank_sql('m.status')} THEN r.status ELSE m.status END AS status "
    f"FROM {_STATUS_SQL}",
)
def j12_conflicts_prefer_main(spark, sf):
    return _status_join(spark, sf, "prefer_main")


@query(
    "j12_conflicts_prefer_related",
    f"SELECT c_custkey, o_custkey, o_orderkey, CASE WHEN {_blank_sql('r.status')} THEN m.status ELSE r.status END AS status "
    f"FROM {_STATUS_SQL}",
)
def j12_conflicts_prefer_related(spark, sf):
    return _status_join(spark, sf, "prefer_related")


@query(
    "j15_basic_suffix",
    f"SELECT c_custkey, m.status AS status, o_custkey, o_orderkey, r.status AS status_Related FROM {_STATUS_SQL}",
)
def j15_basic_suffix(spark, sf):
    return _status_join(spark, sf, "keep_both", ("", "_Related"))


@query(
    "j14_chained",
    "SELECT n.nationkey AS nationkey_main, n_name, n_regionkey, s_suppkey, s_name, s.nationkey AS nationkey_related, s_acctbal, "
    "c_custkey, c_name, c.nationkey AS nationkey, c_acctbal, c_mktsegment FROM "
    "(SELECT n_nationkey AS nationkey, n_name, n_regionkey FROM nation) n LEFT JOIN "
    "(SELECT s_suppkey, s_name, s_nationkey AS nationkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1) s "
    "ON CAST(n.nationkey AS VARCHAR) = CAST(s.nationkey AS VARCHAR) LEFT JOIN "
    "(SELECT c_custkey, c_name, c_nationkey AS nationkey, c_acctbal, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1) c "
    "ON CAST(coalesce(n.nationkey, s.nationkey) AS VARCHAR) = CAST(c.nationkey AS VARCHAR)",
)
def j14_chained(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "nationkey")
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nationkey")
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nationkey")
    spec = J.JoinSpec(["nationkey"], ["nationkey"], how="left", duplicate_policy="first")
    return J.chain_join([n, s, c], spec, [None, ["s_suppkey"], ["c_custkey"]])


@query(
    "j14_chained_four",
    "SELECT a.k AS k_main, a.v AS v_main, b.k AS k_related, b.v AS v_related, c.k AS k_main_2, c.n_customers, d.k AS k_related_2, "
    "d.n_suppliers FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a "
    "LEFT JOIN (SELECT r_regionkey AS k, r_name AS v FROM region) b ON CAST(a.k AS VARCHAR) = CAST(b.k AS VARCHAR) "
    "LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) c ON CAST(a.k AS VARCHAR) = CAST(c.k AS VARCHAR) "
    "LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) d ON CAST(a.k AS VARCHAR) = CAST(d.k AS VARCHAR)",
)
def j14_chained_four(spark, sf):
    """J14 over four inputs that share one key name: every name in the result is new."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return J.chain_join([n, r, c, s], J.JoinSpec(["k"], ["k"], how="left"))


@query(
    "j14_chained_fuzzy",
    "SELECT n_nationkey, n_name AS label_main, c_custkey, CASE WHEN c_acctbal < 0 THEN substr(n_name, 1, 1) || substr(n_name, 3, 1) || "
    "substr(n_name, 2, 1) || substr(n_name, 4) ELSE n_name END AS label_related, n_suppliers, n_name || '!' AS label FROM nation "
    "JOIN customer ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) "
    "ON s_nationkey = n_nationkey",
)
def j14_chained_fuzzy(spark, sf):
    """J14 with J10: three inputs matched by similar names (swapped letters, a stray mark)."""
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("label"))
    c = _perturbed_nations(spark, sf).withColumnRenamed("nation_ref", "label")
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"))
    s = s.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "n_suppliers", F.concat("n_name", F.lit("!")).alias("label")
    )
    spec = J.JoinSpec(["label"], ["label"], how="inner", fuzzy=True, fuzzy_threshold=80)
    return J.chain_join([n, c, s], spec, [["n_nationkey"], ["c_custkey"], ["label"]])


@query(
    "s15_key_suggestion",
    "SELECT c.c_custkey AS c_custkey_main, c_name, o_orderkey, r.c_custkey AS c_custkey_related FROM customer c LEFT JOIN ("
    "SELECT o_orderkey, o_custkey AS c_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) r "
    "ON CAST(c.c_custkey AS VARCHAR) = CAST(r.c_custkey AS VARCHAR)",
)
def s15_key_suggestion(spark, sf):
    """The first main field also present in related becomes the key pair."""
    main = table(spark, sf, "customer").select("c_custkey", "c_name")
    rel = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    left_keys, right_keys = J.suggest_join_keys(main, rel)
    spec = J.JoinSpec(left_keys, right_keys, how="left", duplicate_policy="first")
    return J.key_join(main, rel, spec, related_order=["o_orderkey"]).df


@query(
    "j16_side_by_side",
    "SELECT a.n_nationkey AS \"nation · n_nationkey\", a.n_name AS \"nation · n_name\", a.n_regionkey AS \"nation · n_regionkey\", "
    "'' AS __gap_1_1, '' AS __gap_1_2, b.r_regionkey AS \"region · r_regionkey\", b.r_name AS \"region · r_name\" FROM "
    "(SELECT row_number() OVER (ORDER BY n_nationkey) AS rn, * FROM nation) a FULL JOIN "
    "(SELECT row_number() OVER (ORDER BY r_regionkey) AS rn, * FROM region) b USING (rn)",
)
def j16_side_by_side(spark, sf):
    return J.side_by_side(
        [table(spark, sf, "nation"), table(spark, sf, "region")],
        [["n_nationkey"], ["r_regionkey"]],
        labels=["nation", "region"],
        prefix=True,
        gap=2,
    )


@query(
    "j16_side_by_side_large",
    "SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, l_orderkey, l_linenumber, l_quantity FROM "
    "(SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, * FROM orders) a FULL JOIN "
    "(SELECT row_number() OVER (ORDER BY c_custkey DESC) AS rn, * FROM customer) b USING (rn) FULL JOIN "
    "(SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn, * FROM lineitem) c USING (rn)",
)
def j16_side_by_side_large(spark, sf):
    """J16 over three whole tables of different lengths, one of them in falling order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    return J.side_by_side(
        [o, c, li], [["o_orderkey"], [-F.col("c_custkey")], LI_ORDER], hidden=["l_partkey", "l_suppkey"]
    )


@query(
    "j17_side_by_side_basic",
    "SELECT a.n_nationkey, a.name, b.r_regionkey, b.name AS name_Source2 FROM "
    "(SELECT row_number() OVER (ORDER BY n_nationkey) AS rn, n_nationkey, n_name AS name FROM nation) a FULL JOIN "
    "(SELECT row_number() OVER (ORDER BY r_regionkey) AS rn, r_regionkey, r_name AS name FROM region) b USING (rn)",
)
def j17_side_by_side_basic(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    r = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("name"))
    return J.side_by_side([n, r], [["n_nationkey"], ["r_regionkey"]], basic_names=True)


def _perturbed_nations(spark, sf) -> DataFrame:
    """customers with a nation reference; for negative balances two letters are swapped."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    name = F.col("n_name")
    swapped = F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1), F.substring(name, 2, 1), F.expr("substring(n_name, 4)"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, swapped).otherwise(name).alias("nation_ref")
    )


@query(
    "j10_fuzzy_join",
    "SELECT n_nationkey, n_name, c_custkey, CASE WHEN c_acctbal < 0 THEN substr(n_name, 1, 1) || substr(n_name, 3, 1) || "
    "substr(n_name, 2, 1) || substr(n_name, 4) ELSE n_name END AS nation_ref FROM nation JOIN customer ON c_nationkey = n_nationkey",
)
def j10_fuzzy_join(spark, sf):
    main = table(spark, sf, "nation").select("n_nationkey", "n_name")
    spec = J.JoinSpec(["n_name"], ["nation_ref"], how="inner", fuzzy=True, fuzzy_threshold=80)
    return J.key_join(main, _perturbed_nations(spark, sf), spec, main_order=["n_nationkey"]).df


# ---------------------------------------------------------------------------
# P / F: cleaning and values


@query(
    "p3_p4_clean_trim_collapse",
    "SELECT p_partkey, regexp_replace(regexp_replace(p_name_dirty, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS p_name_dirty "
    "FROM (SELECT p_partkey, '  ' || replace(p_name, ' ', '   ') || chr(9) AS p_name_dirty FROM part)",
)
def p3_p4_clean_trim_collapse(spark, sf):
    p = table(spark, sf, "part")
    dirty = p.select("p_partkey", F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit("\t")).alias("p_name_dirty"))
    return C.clean(dirty, C.CleaningOptions(trim_whitespace=True, collapse_whitespace=True, normalize_width=True))


def _sparse_part(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    small = F.col("p_size") < 10
    return p.select(
        F.when(small, F.lit("  ")).otherwise(F.col("p_name")).alias("a"),
        F.when(small, F.lit(None)).otherwise(F.col("p_brand")).alias("b"),
        F.when(small, F.lit("")).otherwise(F.col("p_type")).alias("c"),
    )


@query(
    "p6_drop_empty_rows",
    "SELECT a, b, c FROM (SELECT CASE WHEN p_size < 10 THEN NULL ELSE p_name END AS a, "
    "CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS b, CASE WHEN p_size < 10 THEN NULL ELSE p_type END AS c FROM part) "
    "WHERE NOT (a IS NULL AND b IS NULL AND c IS NULL)",
)
def p6_drop_empty_rows(spark, sf):
    return C.drop_empty_rows(_sparse_part(spark, sf))


@query(
    "s7_drop_null_rows",
    "SELECT a, b, c FROM (SELECT CASE WHEN p_size < 10 THEN '  ' ELSE p_name END AS a, "
    "CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS b, CASE WHEN p_size < 10 THEN '' ELSE p_type END AS c FROM part "
    "UNION ALL SELECT NULL, NULL, NULL FROM part WHERE p_size > 45) WHERE NOT (a IS NULL AND b IS NULL AND c IS NULL)",
)
def s7_drop_null_rows(spark, sf):
    """Only rows whose every cell is NULL go; blank strings are values."""
    empty = table(spark, sf, "part").filter(F.col("p_size") > 45).select(
        *[F.lit(None).cast("string").alias(c) for c in ("a", "b", "c")]
    )
    return C.drop_empty_rows(_sparse_part(spark, sf).unionByName(empty), blanks_are_empty=False)


@query(
    "p9_clean_width_first",
    "SELECT p_partkey, regexp_replace(regexp_replace(replace(p_name_dirty, chr(12288), ' '), '^\\s+|\\s+$', '', 'g'), "
    "'\\s+', ' ', 'g') AS p_name_dirty "
    "FROM (SELECT p_partkey, chr(12288) || '  ' || replace(p_name, ' ', ' ' || chr(12288) || ' ') AS p_name_dirty FROM part)",
)
def p9_clean_width_first(spark, sf):
    """Width (NFKC) before trim and collapse; ideographic spaces become plain ones first."""
    p = table(spark, sf, "part")
    wide = F.concat(F.lit("\u3000  "), F.regexp_replace("p_name", " ", " \u3000 ")).alias("p_name_dirty")
    opts = C.CleaningOptions(trim_whitespace=True, collapse_whitespace=True, normalize_width=True, order="width_first")
    return C.clean(p.select("p_partkey", wide), opts)


_UNICODE_WS_SQL = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]"


@query(
    "p5_clean_documents",
    f"SELECT doc_id, nfc_normalize(regexp_replace(regexp_replace(text, '^{_UNICODE_WS_SQL}+|{_UNICODE_WS_SQL}+$', '', 'g'), "
    f"'{_UNICODE_WS_SQL}+', ' ', 'g')) AS text FROM documents",
)
def p5_clean_documents(spark, sf):
    """P3-P5 over whole multilingual documents: trim, collapse, NFKC (live order)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    opts = C.CleaningOptions(trim_whitespace=True, collapse_whitespace=True, normalize_width=True)
    return C.clean(docs, opts)


@query("p8_clean_dedupe", "SELECT DISTINCT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders)")
def p8_clean_dedupe(spark, sf):
    o = table(spark, sf, "orders")
    return C.clean(U.stack([o, o]), C.CleaningOptions(drop_duplicate_rows=True))


@query("s8_drop_empty_columns", "SELECT * FROM part")
def s8_drop_empty_columns(spark, sf):
    p = table(spark, sf, "part")
    padded = p.withColumn("extra", F.lit(None).cast("string")).withColumn(
        "note", F.when(F.col("p_size") < 0, F.lit("negative"))
    )
    return C.drop_empty_columns(padded)


@query(
    "p1_rename_fields",
    "SELECT c_custkey, c_name AS Name, c_nationkey, c_acctbal, c_mktsegment AS Segment FROM customer",
)
def p1_rename_fields(spark, sf):
    return C.rename_fields(table(spark, sf, "customer"), {"c_name": "Name", "c_mktsegment": "Segment", "absent": "x"})


def _noisy_types(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    noisy = F.when(F.col("value") > 50, F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).otherwise(F.col("event_type"))
    return e.select("event_id", "ts", "user_id", "value", noisy.alias("event_type"))


_NOISY_SQL = (
    "SELECT event_id, ts, user_id, value, CASE WHEN value > 50 THEN '  ' || upper(event_type) || ' ' ELSE event_type END "
    "AS event_type FROM events"
)


@query(
    "f2_display_values",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_shown, "
    "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value_shown, "
    f"CAST(user_id AS VARCHAR) AS user_shown, trim(event_type) AS type_shown FROM ({_NOISY_SQL})",
)
def f2_display_values(spark, sf):
    e = _noisy_types(spark, sf)
    shown = {c: V.display_value(e[c], e.schema[c].dataType) for c in ("ts", "value", "user_id", "event_type")}
    return e.select(
        "event_id",
        shown["ts"].alias("ts_shown"),
        shown["value"].alias("value_shown"),
        shown["user_id"].alias("user_shown"),
        shown["event_type"].alias("type_shown"),
    )


@query(
    "f3_canonical_values",
    f"SELECT event_id, lower(trim(event_type)) AS type_key, CAST(user_id AS VARCHAR) AS user_key FROM ({_NOISY_SQL})",
)
def f3_canonical_values(spark, sf):
    e = _noisy_types(spark, sf)
    return e.select(
        "event_id",
        V.canonical_value(e["event_type"], e.schema["event_type"].dataType).alias("type_key"),
        V.canonical_value(e["user_id"], e.schema["user_id"].dataType).alias("user_key"),
    )


@query(
    "f4_key_normalize",
    f"SELECT event_id, lower(trim(event_type)) AS type_key, event_type AS type_raw_key, CAST(user_id AS VARCHAR) AS user_key "
    f"FROM ({_NOISY_SQL})",
)
def f4_key_normalize(spark, sf):
    e = _noisy_types(spark, sf)
    t = e.schema["event_type"].dataType
    return e.select(
        "event_id",
        V.key_text(e["event_type"], t, True).alias("type_key"),
        V.key_text(e["event_type"], t, False).alias("type_raw_key"),
        V.key_text(e["user_id"], e.schema["user_id"].dataType, True).alias("user_key"),
    )


@query(
    "f11_prefer_non_blank",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS label FROM customer",
)
def f11_prefer_non_blank(spark, sf):
    c = table(spark, sf, "customer")
    primary = F.when(F.col("c_acctbal") < 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", V.prefer_non_blank(primary, F.col("c_name"), c.schema["c_mktsegment"].dataType).alias("label"))


@query(
    "f12_json_nested",
    "SELECT event_id, to_json(struct_pack(user_id := user_id, event_type := event_type)) AS who, "
    "to_json([user_id, event_id]) AS ids FROM events",
)
def f12_json_nested(spark, sf):
    """F12 as text sinks apply it: every nested column of the rows becomes JSON text."""
    from tessera.sinks.writer import json_nested

    e = table(spark, sf, "events")
    nested = e.select(
        "event_id",
        F.struct("user_id", "event_type").alias("who"),
        F.array("user_id", "event_id").alias("ids"),
    )
    return json_nested(nested)


@query(
    "f12_json_text",
    "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding, label FROM embeddings",
)
def f12_json_text(spark, sf):
    e = table(spark, sf, "embeddings")
    text = e.select("vec_id", V.json_text(e["embedding"], e.schema["embedding"].dataType).alias("text"), "label")
    # the text is parsed again, as numbers, so that SQL can compare them
    parsed = F.transform(F.from_json("text", "array<float>"), lambda x: x.cast("double"))
    return text.select("vec_id", parsed.alias("embedding"), "label")


# ---------------------------------------------------------------------------
# S / O: profiles, previews, fields, grids


@query(
    "s14_top_values",
    "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, min(p_partkey) LIMIT 12",
)
def s14_top_values(spark, sf):
    top, _summary = G.profile_field(table(spark, sf, "part"), "p_brand", ["p_partkey"])
    return top


@query(
    "s14_profile_summary",
    "SELECT count(DISTINCT p_brand) AS distinct_values, count(*) AS total_rows FROM part",
)
def s14_profile_summary(spark, sf):
    _top, summary = G.profile_field(table(spark, sf, "part"), "p_brand", ["p_partkey"])
    return summary


@query("s11_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def s11_preview(spark, sf):
    return G.preview(table(spark, sf, "orders"), ["o_orderkey"], 20)


@query(
    "s11_preview_totals",
    " UNION ALL ".join(
        f"SELECT '{name}' AS source_sheet, CAST(2 AS BIGINT) AS header_row, count(*) AS total_rows, CAST({width} AS BIGINT) AS total_columns FROM {name}"
        for name, width in (("region", 2), ("nation", 3), ("part", 6), ("orders", 6))
    ),
)
def s11_preview_totals(spark, sf):
    """Header row, rows and columns of every table under its title and header rows."""
    return G.preview_totals(_report_grids(spark, sf)).select("source_sheet", "header_row", "total_rows", "total_columns")


_FIELD_TABLES = {
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
}


def _fields_sql() -> str:
    parts = []
    for name, (key, cols) in _FIELD_TABLES.items():
        for pos, col in enumerate(cols):
            parts.append(
                f"SELECT '{name}' AS source_sheet, {pos} AS position, '{col}' AS field, string_agg(v, ' | ' ORDER BY o) AS samples "
                f"FROM (SELECT v, min(o) AS o FROM (SELECT trim(CAST({col} AS VARCHAR)) AS v, {key} AS o FROM "
                f"{name}) WHERE v IS NOT NULL AND v <> '' GROUP BY v ORDER BY o LIMIT 3)"
            )
    return " UNION ALL ".join(parts)


@query("s13_discover_fields", _fields_sql())
def s13_discover_fields(spark, sf):
    tables = [(f"{n}.parquet", n, table(spark, sf, n), [key]) for n, (key, _c) in _FIELD_TABLES.items()]
    out = G.discover_fields(tables)
    return out.select("source_sheet", "position", "field", F.array_join("samples", " | ").alias("samples"))


def _report_grids(spark, sf) -> DataFrame:
    grids = []
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("part", "p_partkey"), ("orders", "o_orderkey")):
        df = table(spark, sf, name)
        grids.append(G.table_to_grid(df, f"{name}.xlsx", name, [key], leading_rows=[[f"Report of {name}"]]))
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out


_GRID_TABLES = {
    "region": ("r_regionkey", [("r_regionkey", "number"), ("r_name", "string")]),
    "nation": ("n_nationkey", [("n_nationkey", "number"), ("n_name", "string"), ("n_regionkey", "number")]),
    "part": ("p_partkey", [("p_partkey", "number"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
                          ("p_size", "number"), ("p_retailprice", "number")]),
    "orders": ("o_orderkey", [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "string"),
                              ("o_totalprice", "number"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")]),
}


def _detect_sql() -> str:
    """Header detection in SQL over the same grids: title row, header row, data rows."""
    cells = []
    for name, (key, cols) in _GRID_TABLES.items():
        cells.append(f"SELECT '{name}' AS tab, 1 AS row_no, 0 AS pos, 'string' AS kind, 'Report of {name}' AS text")
        for pos, (col, _kind) in enumerate(cols):
            cells.append(f"SELECT '{name}', 2, {pos}, 'string', '{col}'")
        for pos, (col, kind) in enumerate(cols):
            cells.append(
                f"SELECT '{name}', rn + 2, {pos}, '{kind}', CAST({col} AS VARCHAR) FROM "
                f"(SELECT {col}, row_number() OVER (ORDER BY {key}) AS rn FROM {name}) WHERE rn <= 38"
            )
    terms = ", ".join(f"'{t}'" for t in G.KNOWN_FIELD_TERMS)
    return f"""
WITH cells AS ({" UNION ALL ".join(cells)}),
rows AS (
  SELECT tab, row_no, count(*) AS n,
         count(*) FILTER (WHERE kind = 'string' AND length(trim(text)) BETWEEN 1 AND 60) AS short,
         count(DISTINCT lower(trim(text))) AS uniq,
         count(*) FILTER (WHERE lower(trim(text)) IN ({terms})) AS known,
         least(1.0, (count(*) FILTER (WHERE kind <> 'string') + count(*) FILTER (WHERE kind = 'string' AND length(trim(text)) > 60) * 0.5) / count(*)) AS likeness
  FROM cells WHERE text IS NOT NULL AND text <> '' GROUP BY tab, row_no),
width AS (SELECT tab, max(pos) + 1 AS w FROM cells GROUP BY tab),
scored AS (
  SELECT r.tab, r.row_no,
         (r.n / w.w) * 0.3 + (r.short / r.n) * 0.3 + (r.uniq / r.n) * 0.2
         + coalesce(lead(r.likeness) OVER (PARTITION BY r.tab ORDER BY r.row_no), 0.0) * 0.15
         + least(r.known / 3, 1.0) * 0.2 - CASE WHEN r.uniq <> r.n THEN 0.08 ELSE 0 END AS score
  FROM rows r JOIN width w USING (tab))
SELECT tab AS source_sheet, CAST(arg_max(row_no, (score, -row_no)) AS BIGINT) AS header_row,
       round(greatest(0.0, least(max(score), 1.0)), 6) AS confidence
FROM scored WHERE row_no <= 20 GROUP BY tab
"""


@query("s9_detect_header", _detect_sql())
def s9_detect_header(spark, sf):
    found = G.detect_headers(_report_grids(spark, sf))
    return found.select("source_sheet", "header_row", F.round("confidence", 6).alias("confidence"))


def _header_names_sql() -> str:
    parts = []
    for name, (key, cols) in _GRID_TABLES.items():
        for pos, (col, _kind) in enumerate(cols):
            title = f"'Report of {name}', " if pos == 0 else ""
            parts.append(
                f"SELECT '{name}' AS source_sheet, {pos} AS pos, "
                f"concat_ws('_', {title}'{col}', trim(nullif(CAST({col} AS VARCHAR), ''))) AS name "
                f"FROM (SELECT 1) LEFT JOIN (SELECT * FROM {name} ORDER BY {key} LIMIT 1) ON true"
            )
    return " UNION ALL ".join(parts)


@query("s5_header_names", _header_names_sql())
def s5_header_names(spark, sf):
    """Three header rows (title, column names, the first row of the
    table) of each table's grid joined per column with ``_``; empty parts are skipped."""
    names = G.unique_headers(G.header_parts(_report_grids(spark, sf), 1, 3))
    return names.select("source_sheet", "pos", "name")


def _header_rows_sql() -> str:
    parts = []
    for name, key, cols in (
        ("nation", "n_nationkey", ["n_nationkey", "n_name"]),
        ("customer", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"]),
    ):
        for pos, col in enumerate(cols):
            parts.append(
                f"SELECT '{name}' AS source_sheet, {pos} AS pos, string_agg(CAST({col} AS VARCHAR), '_' ORDER BY {key}) AS name "
                f"FROM (SELECT * FROM {name} ORDER BY {key} LIMIT 3)"
            )
    return " UNION ALL ".join(parts)


@query("s5_header_rows", _header_rows_sql())
def s5_header_rows(spark, sf):
    """S5, S6 with header cells from table rows: the first three rows of each table, joined column by column."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    grid = G.table_to_grid(n, "t.parquet", "nation", ["n_nationkey"], header=False).unionByName(
        G.table_to_grid(c, "t.parquet", "customer", ["c_custkey"], header=False)
    )
    return G.unique_headers(G.header_parts(grid, 1, 3)).select("source_sheet", "pos", "name")


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------------------
# outputs, written and read back (K1-K5, K7, K8)


def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _status_split(spark, sf):
    split = X.split_by_fields(table(spark, sf, "orders"), ["o_orderstatus"], ["o_orderkey"])
    return split, output_names(split.manifest, "{original_name}_{split_value}", {"original_name": "orders"})


@query("k1_written_outputs", "SELECT *, o_orderstatus AS split_label, 'orders_' || o_orderstatus AS output_name FROM orders")
def k1_written_outputs(spark, sf):
    """K1, K4: every group an output under its own name, read back with its types."""
    split, names = _status_split(spark, sf)
    path = _scratch(spark, "k1")
    write_named(split.flagged, names, path)
    return spark.read.parquet(path)


@query("k2_written_in_one", "SELECT *, o_orderstatus AS split_label FROM orders WHERE o_orderstatus <> 'P'")
def k2_written_in_one(spark, sf):
    """K2: one output with the label as a column; excluded rows stay out."""
    df = table(spark, sf, "orders").withColumn("kept", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    split = X.split_by_fields(df, ["kept"], ["o_orderkey"], blank_policy="skip")
    path = _scratch(spark, "k2")
    write_split(split.flagged.drop("kept"), path, separate=False)
    return spark.read.parquet(path)


@query(
    "k3_written_csv",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority, "
    "'{\"k\":' || o_custkey || ',\"s\":\"' || o_orderstatus || '\"}' AS nested, 'orders_' || o_orderstatus AS output_name FROM orders",
)
def k3_written_csv(spark, sf):
    """K3: text outputs with a header, nested values as JSON text."""
    split, names = _status_split(spark, sf)
    nested = F.struct(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    path = _scratch(spark, "k3")
    write_named(split.flagged.withColumn("nested", nested), names, path, fmt="csv")
    back = spark.read.option("header", "true").option("escape", "\\").csv(path)
    return back.select("o_orderkey", "o_custkey", "o_orderpriority", "nested", "output_name")


@query(
    "k5_existing_outputs",
    "WITH o AS (SELECT o_orderstatus AS s, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1), "
    "late AS (SELECT o_orderstatus AS s, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) "
    "SELECT 'orders_' || s AS output_name, CASE WHEN s = 'P' THEN late.n ELSE o.n END AS n, CASE WHEN s = 'P' THEN late.keys ELSE o.keys END AS keys "
    "FROM o JOIN late USING (s) UNION ALL SELECT 'orders_' || s || '_2', n, keys FROM late WHERE s <> 'P'",
)
def k5_existing_outputs(spark, sf):
    """K5: by output, what exists is kept (skip), then joined by new names (rename), then replaced (overwrite)."""
    split, names = _status_split(spark, sf)
    path = _scratch(spark, "k5")
    write_named(split.flagged, names, path)
    late = split.flagged.filter(F.col("o_orderkey") % 2 == 0)
    write_named(late, names, path, existing="skip")
    write_named(late.filter("split_label <> 'P'"), names.filter("split_label <> 'P'"), path, existing="rename")
    write_named(late.filter("split_label = 'P'"), names.filter("split_label = 'P'"), path, existing="overwrite")
    back = spark.read.parquet(path)
    return back.groupBy("output_name").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "k7_oversized_groups",
    "SELECT CAST(l_suppkey AS VARCHAR) AS split_label, count(*) AS row_count FROM lineitem GROUP BY 1 "
    "HAVING count(*) > (SELECT count(*) / count(DISTINCT l_suppkey) FROM lineitem)",
)
def k7_oversized_groups(spark, sf):
    """K7: the groups that the size guard refuses, for a limit of the mean group's rows."""
    li = table(spark, sf, "lineitem")
    mean = li.agg((F.count(F.lit(1)) / F.count_distinct("l_suppkey")).alias("m")).first().m
    split = X.split_by_fields(li, ["l_suppkey"], LI_ORDER)
    return oversized(split.manifest, mean).select("split_label", "row_count")


@query(
    "k8_run_manifest",
    "SELECT o_orderpriority AS split_label, row_number() OVER (ORDER BY min(o_orderkey)) AS part_no, count(*) AS row_count, "
    "'orders_' || replace(o_orderpriority, ' ', ' ') AS output_name, count(*) OVER () AS outputs, "
    "(SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS excluded_blank FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_orderpriority",
)
def k8_run_manifest(spark, sf):
    """A whole split run from a configuration; its manifest next to the outputs, its report with the reasons."""
    from tessera.plans.tasks import OutputSpec, SourceSpec, SplitTask, run_split

    out = _scratch(spark, "k8")
    key = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    table(spark, sf, "orders").withColumn("group", key).write.parquet(f"{out}/orders.parquet")
    source = SourceSpec(f"{out}/orders.parquet", order_by=["o_orderkey"])
    task = SplitTask([source], OutputSpec(f"{out}/done"), fields=["group"], blank_policy="skip", report_path=f"{out}/runs")
    report = run_split(spark, task)
    manifest = spark.read.parquet(f"{report.outputs[0]}_manifest")
    run = spark.read.parquet(f"{out}/runs").select(F.col("details")["excluded_blank"].alias("excluded_blank"))
    written = spark.read.parquet(report.outputs[0]).select("output_name").distinct()
    return (
        manifest.join(written, "output_name")
        .select("split_label", "part_no", "row_count", "output_name", F.count(F.lit(1)).over(Window.partitionBy()).alias("outputs"))
        .withColumn("excluded_blank", run.select("excluded_blank").scalar())
    )
