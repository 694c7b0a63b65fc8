import difflib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.functions.values import normalize_field_name, py_ratio
from tessera.operators.fuzzy import candidate_pairs, fuzzy_key_map, schema_rows, suggest_field_mapping, suggest_field_mappings


def _diag(result):
    return result.diagnostics.collect()[0].asDict()


def test_left_join_diagnostics(frame):
    main = frame([(1, "A"), (2, "B")], "ID long, Name string")
    rel = frame([(1, 10), (3, 30)], "Code long, Amount long")
    res = J.key_join(main, rel, J.JoinSpec(["ID"], ["Code"], how="left"))
    assert res.df.count() == 2
    d = _diag(res)
    assert (d["matched"], d["main_only"], d["related_only"]) == (1, 1, 0)


def test_outer_join_same_named_keys(frame):
    main = frame([(1,), (2,)], "ID long")
    rel = frame([(2, 20), (3, 30)], "ID long, Amount long")
    res = J.key_join(main, rel, J.JoinSpec(["ID"], ["ID"], how="outer"))
    assert res.df.columns == ["ID_main", "ID_related", "Amount"]
    assert res.df.count() == 3
    assert _diag(res)["related_only"] == 1


def test_duplicate_policies(frame):
    main = frame([(1, "A")], "ID long, Name string")
    rel = frame([(1, 10, 1), (1, 20, 2)], "ID long, Amount long, o long")
    with pytest.raises(ValueError, match="2 rows"):
        J.key_join(main, rel, J.JoinSpec(["ID"], ["ID"], duplicate_policy="reject"))
    first = J.key_join(main, rel, J.JoinSpec(["ID"], ["ID"], duplicate_policy="first"), related_order=["o"])
    rows = first.df.collect()
    assert len(rows) == 1 and rows[0]["Amount"] == 10
    assert _diag(first)["duplicates"] == 2
    last = J.key_join(main, rel, J.JoinSpec(["ID"], ["ID"], duplicate_policy="last"), related_order=["o"])
    assert last.df.collect()[0]["Amount"] == 20
    expand = J.key_join(main, rel, J.JoinSpec(["ID"], ["ID"]))
    assert expand.df.count() == 2


def test_aggregate_policy_sums_numbers_keeps_first_text_and_key(frame):
    main = frame([("k",)], "K string")
    rel = frame([("k", 1, 10.0, None, 1), ("K ", 1, None, "b", 2), ("k", 1, 5.0, "c", 3)], "K string, Code long, Amount double, Note string, o long")
    res = J.key_join(main, rel, J.JoinSpec(["K"], ["K"], duplicate_policy="aggregate"), related_order=["o"])
    row = res.df.collect()[0]
    assert row["Amount"] == 15.0 and row["Code"] == 3 and row["Note"] == "b" and row["K_related"] == "k"
    assert row["o"] == 6


def test_normalised_text_keys(frame):
    main = frame([("Ａbc",), ("x",)], "K string")
    rel = frame([(" ABC ", 1)], "R string, v long")
    res = J.key_join(main, rel, J.JoinSpec(["K"], ["R"], how="inner"))
    assert res.df.count() == 1
    raw = J.key_join(main, rel, J.JoinSpec(["K"], ["R"], how="inner", normalize_keys=False))
    assert raw.df.count() == 0


def test_int_and_float_keys_do_not_match_as_text(frame):
    main = frame([(1,)], "K long")
    rel = frame([(1.0,)], "R double")
    assert J.key_join(main, rel, J.JoinSpec(["K"], ["R"], how="inner")).df.count() == 0


def test_empty_keys(frame):
    main = frame([("",), (None,), ("a",)], "K string")
    rel = frame([(" ", 1), ("a", 2)], "R string, v long")
    never = J.key_join(main, rel, J.JoinSpec(["K"], ["R"], how="inner"))
    assert [r["v"] for r in never.df.collect()] == [2]
    match = J.key_join(main, rel, J.JoinSpec(["K"], ["R"], how="inner", empty_keys_match=True))
    assert sorted(r["v"] for r in match.df.collect()) == [1, 1, 2]


def test_composite_key_with_empty_part_is_unmatched(frame):
    main = frame([("a", ""), ("a", "b")], "K1 string, K2 string")
    rel = frame([("a", "", 1), ("a", "b", 2)], "R1 string, R2 string, v long")
    res = J.key_join(main, rel, J.JoinSpec(["K1", "K2"], ["R1", "R2"], how="inner"))
    assert [r["v"] for r in res.df.collect()] == [2]
    with pytest.raises(ValueError):
        J.key_join(main, rel, J.JoinSpec(["K1"], ["R1", "R2"]))


def test_conflict_policies(frame):
    main = frame([("North", "")], "Key string, Status string")
    rel = frame([("Nroth", "Approved")], "Key string, Status string")
    spec = J.JoinSpec(["Key"], ["Key"], fuzzy=True, fuzzy_threshold=50, conflict_policy="prefer_related")
    res = J.key_join(main, rel, spec, main_order=["Key"])
    row = res.df.collect()[0]
    assert row["Status"] == "Approved"
    assert res.df.columns == ["Key_main", "Key_related", "Status"]
    keep = J.key_join(main, rel, J.JoinSpec(["Key"], ["Key"], fuzzy=True, fuzzy_threshold=50), main_order=["Key"])
    assert keep.df.columns == ["Key_main", "Status_main", "Key_related", "Status_related"]
    prefer_main = J.key_join(
        main, rel, J.JoinSpec(["Key"], ["Key"], fuzzy=True, fuzzy_threshold=50, conflict_policy="prefer_main"), main_order=["Key"]
    )
    assert prefer_main.df.collect()[0]["Status"] == "Approved"
    basic = J.key_join(main, rel, J.JoinSpec(["Key"], ["Key"], main_suffix="", related_suffix="_Related"))
    assert basic.df.columns == ["Key", "Status", "Key_Related", "Status_Related"]


def test_chained_join_carries_key(frame):
    a = frame([(1, "a"), (2, "b")], "K long, A string")
    b = frame([(1, "x")], "K long, B string")
    c = frame([(2, "y"), (1, "z")], "K long, C string")
    out = J.chain_join([a, b, c], J.JoinSpec(["K"], ["K"], how="left"))
    rows = {r["A"]: (r["B"], r["C"]) for r in out.collect()}
    assert rows == {"a": ("x", "z"), "b": (None, "y")}


def test_side_by_side_with_gap(frame):
    a = frame([(1,), (2,)], "A long")
    b = frame([(3,)], "B long")
    out = J.side_by_side([a, b], [["A"], ["B"]], gap=2)
    assert out.columns == ["A", "__gap_1_1", "__gap_1_2", "B"]
    rows = out.collect()
    assert len(rows) == 2 and rows[0]["__gap_1_1"] == "" and rows[1]["B"] is None


def test_side_by_side_prefix_and_basic_names(frame):
    a = frame([(1, 10), (2, 20)], "ID long, Value long")
    b = frame([(1, "ok")], "ID long, Status string")
    basic = J.side_by_side([a, b], [["ID"], ["ID"]], basic_names=True)
    assert basic.columns == ["ID", "Value", "ID_Source2", "Status"]
    assert [r["Status"] for r in basic.collect()] == ["ok", None]
    pref = J.side_by_side([a, a], [["ID"], ["ID"]], labels=["t", "t"], prefix=True)
    assert pref.columns == ["t · ID", "t · Value", "t · ID_2", "t · Value_2"]


def test_suggest_join_keys(frame):
    a = frame([(1, 2)], "X long, ID long")
    b = frame([(1,)], "ID long")
    assert J.suggest_join_keys(a, b) == (["ID"], ["ID"])


def _brute(main_vals, rel_vals, threshold):
    out = {}
    for r in dict.fromkeys(v for v in rel_vals if v):
        best, best_score = "", 0.0
        for m in dict.fromkeys(v for v in main_vals if v):
            score = difflib.SequenceMatcher(None, r, m).ratio() * 100
            if score > best_score:
                best, best_score = m, score
        if best_score >= threshold and best != r:
            out[r] = best
    return out


@pytest.mark.parametrize("threshold,alphabet,n", [(50, "abcde", 60), (72, "abcdefgh", 150), (80, "abcde", 60), (85, "aab日本c", 150), (95, "abcde", 60), (99, "ab", 80)])
def test_fuzzy_map_equals_full_search(spark, threshold, alphabet, n):
    rnd = random.Random(threshold)
    main = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))) for _ in range(n)]
    rel = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))) for _ in range(n)] + main[:5]
    rel += [m[:-1] + rnd.choice(alphabet) for m in main[5:25] if len(m) > 1]
    main_keys = spark.createDataFrame(
        [(k, i) for k, i in {m: i for i, m in reversed(list(enumerate(main)))}.items()], "key string, first long"
    )
    rel_keys = spark.createDataFrame([(r,) for r in dict.fromkeys(rel)], "key string")
    got = {r["key"]: r["target"] for r in fuzzy_key_map(main_keys, rel_keys, threshold).collect()}
    got = {k: v for k, v in got.items() if k != v}
    assert got == _brute(main, rel, threshold)


def test_field_mapping_suggestion(spark):
    out = suggest_field_mapping(spark, ["Customer Name", "ID", "amount"], ["CustomerName", "ID", "Amount"], 0.7)
    got = {(r["source"], r["target"]) for r in out.collect()}
    assert ("Customer Name", "CustomerName") in got
    assert ("amount", "Amount") in got
    assert all(s != t for s, t in got)


def test_incomplete_keys_pass_through_duplicate_policy(frame):
    main = frame([("a",)], "K string")
    rel = frame([("", 1), (" ", 2), ("a", 3), ("a", 4), (None, 5)], "K string, v long")
    res = J.key_join(main, rel, J.JoinSpec(["K"], ["K"], how="outer", duplicate_policy="first"), related_order=["v"])
    rows = sorted((r["v"], r["K_main"]) for r in res.df.collect())
    assert rows == [(1, None), (2, None), (3, "a"), (5, None)]
    assert _diag(res)["duplicates"] == 2


@pytest.mark.parametrize("how", ["outer"])
@pytest.mark.parametrize("heavy", [5, 1_000_000])
def test_heavy_keys_of_a_full_outer_join(spark, how, heavy):
    """Keys heavy on one side, on both, on one side alone, blank, and composite; no row doubled or lost."""
    main = [(i, "hot" if i % 3 == 0 else f"k{i % 20}", "x" if i % 2 else "y") for i in range(60)] + [(90 + i, None, "x") for i in range(9)]
    main += [(200 + i, "mine", "x") for i in range(12)]
    rel = [(500 + i, "HOT " if i % 4 == 0 else f"K{i % 30}", "x") for i in range(60)] + [(700 + i, "yours", "y") for i in range(15)] + [(800, " ", "x")]
    a = spark.createDataFrame(main, "a long, k string, s string")
    b = spark.createDataFrame(rel, "b long, k string, s string")
    for keys in (["k"], ["k", "s"]):
        got = J.key_join(a, b, J.JoinSpec(keys, keys, how=how, heavy_rows=heavy))
        norm = lambda r, ks=keys: tuple((dict(zip("ks", r[1:]))[k] or "").strip().lower() for k in ks)
        want, met = [], set()
        for m in main:
            pairs = [r for r in rel if all(norm(m)) and norm(m) == norm(r)]
            met |= {r[0] for r in pairs}
            want += [(m[0], r[0]) for r in pairs] or [(m[0], None)]
        want += [(None, r[0]) for r in rel if r[0] not in met]
        assert sorted(((r["a"], r["b"]) for r in got.df.collect()), key=str) == sorted(want, key=str)
        d = got.diagnostics.first()
        assert (d.main_only, d.related_only) == (sum(w[1] is None for w in want), sum(w[0] is None for w in want))


def test_a_heavy_key_is_spread_over_tasks(spark):
    a = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id").repartition(16)
    b = spark.range(9000, 18000).select(F.when(F.col("id") == 9000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("b"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "64")):
        spark.conf.set(k, v)
    try:
        joined = J.key_join(a, b, J.JoinSpec(["k"], ["k"], how="outer", heavy_rows=100)).df
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 17999 and sizes[-1] < 3 * sizes[len(sizes) // 2] + 300


@pytest.mark.parametrize(("alphabet", "share"), [("0123456789", 0.35), ("abcdefghijklmnopqrstuvwxyz", 0.1)])
def test_candidates_hold_every_match_and_few_others(spark, alphabet, share):
    rnd = random.Random(12)
    code = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(6, 12)))
    right = sorted({code() for _ in range(120)})
    left = sorted({code() for _ in range(80)} | {c[:3] + rnd.choice(alphabet) + c[4:] for c in right[:40]})
    qs, cs = spark.createDataFrame([(x,) for x in left], "q string"), spark.createDataFrame([(x,) for x in right], "c string")
    got = {tuple(r) for r in candidate_pairs(qs, cs, 0.85).collect()}
    matches = {(q, c) for q in left for c in right if py_ratio(q, c) >= 0.85}
    assert matches <= got and len(matches) >= 30
    assert len(got) <= share * len(left) * len(right)


def test_field_mappings_of_many_tables_in_one_join(spark):
    tables = [
        ("crm", ["Customer ID", "Full  Name", "E-mail", "Opened"]),
        ("erp", ["customer_id", "full name", "Mail", "opened"]),
        ("old", ["Customer-ID", "ＦＵＬＬ name", "e mail", "zzz", "Full Name"]),
    ]
    rows = schema_rows(spark, tables)
    got = {(r.source_table, r.source, r.target_table): (r.target, round(r.score, 9)) for r in suggest_field_mappings(rows, rows, 0.72).collect()}
    want = {}
    for a, fields in tables:
        for b, others in tables:
            for f in fields if a != b else []:
                scores = [(py_ratio(normalize_field_name(f), normalize_field_name(o)), -i, o) for i, o in enumerate(others)]
                score, _, best = max(scores)
                if score >= 0.72 and best != f:
                    want[a, f, b] = (best, round(score, 9))
    assert got == want and len(want) > 10
