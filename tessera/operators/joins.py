"""Key joins (J1-J9, J11-J15, J13) and side-by-side merges.

Keys are compared as text (``key_text``: NFKC + trim + case-fold when
normalising).  An empty key never matches unless ``empty_keys_match``: it
becomes NULL, and ``=`` never matches NULL, so a composite key with any empty
part stays unmatched without any token tricks.

The join itself is a plain ``DataFrame.join`` on the key columns: Catalyst +
AQE pick broadcast / shuffled-hash / sort-merge at run time from real sizes,
and AQE splits skewed key partitions.  It cannot split those of a full outer
join, so there the keys with many rows go a way of their own (``outer_join``).
Duplicate-key policies are aggregates
combined map-side, so a repeated key never sends all its rows to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import is_blank, key_text, text_of
from tessera.operators.dedupe import keep_one_per_key
from tessera.functions.unique import Names
from tessera.operators.ordinals import OrderBy, dense_index, order_key
from tessera.session import checkpoint_dir, materialise

HOW = {"left": "left", "right": "right", "inner": "inner", "outer": "full_outer", "full_outer": "full_outer"}
DUPLICATE_POLICIES = ("expand", "reject", "first", "last", "aggregate")
CONFLICT_POLICIES = ("keep_both", "prefer_main", "prefer_related")

_IN_MAIN = "__in_main"
_IN_RELATED = "__in_related"


@dataclass
class JoinSpec:
    left_keys: Sequence[str]
    right_keys: Sequence[str]
    how: str = "left"
    normalize_keys: bool = True
    empty_keys_match: bool = False
    duplicate_policy: str = "expand"
    conflict_policy: str = "keep_both"
    main_suffix: str = "_main"
    related_suffix: str = "_related"
    fuzzy: bool = False
    fuzzy_threshold: float = 85
    dedupe_sides: str = "related"
    #: Rows of one key on one side from which a full outer join spreads it over tasks.
    heavy_rows: int = 1_000_000


@dataclass
class JoinResult:
    df: DataFrame
    diagnostics: DataFrame
    duplicates: DataFrame = field(repr=False, default=None)
    marked: DataFrame = field(repr=False, default=None)

    def observed(self, name: str = "join_diagnostics"):
        """The joined rows with matched / main_only / related_only counted by an
        ``Observation`` during whatever action runs them (no extra pass)."""
        from pyspark.sql import Observation

        obs = Observation(name)
        in_main, in_rel = F.col(_IN_MAIN).isNotNull(), F.col(_IN_RELATED).isNotNull()
        df = self.marked.observe(
            obs,
            F.count(F.when(in_main & in_rel, 1)).alias("matched"),
            F.count(F.when(in_main & ~in_rel, 1)).alias("main_only"),
            F.count(F.when(~in_main & in_rel, 1)).alias("related_only"),
        )
        return df.drop(_IN_MAIN, _IN_RELATED), obs


def _mk(i: int) -> str:
    return f"__mk{i}"


def _rk(i: int) -> str:
    return f"__rk{i}"


def prepare_keys(df: DataFrame, keys: Sequence[str], names: Sequence[str], spec: JoinSpec, prepared: bool = False) -> DataFrame:
    """Key text columns ``names`` for ``keys``; empty -> NULL unless empties match."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"The table has no columns {', '.join(missing)} to join on")
    for key, name in zip(keys, names):
        c = F.col(key) if prepared else key_text(df[key], df.schema[key].dataType, spec.normalize_keys)
        if not spec.empty_keys_match:
            c = F.when(c != F.lit(""), c)
        df = df.withColumn(name, c)
    return df


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``duplicates``: rows whose complete key occurs more than once."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counts = df.filter(complete).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > 1).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("duplicates"))


def _numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType))


def apply_duplicate_policy(
    df: DataFrame, keys: Sequence[str], policy: str, order_by: OrderBy | None, original_keys: Sequence[str] = ()
) -> DataFrame:
    """J5-J8 on one side.  Rows with an incomplete key are never duplicates and pass through."""
    if policy == "expand":
        return df
    if policy == "reject":
        n = duplicate_rows(df, keys).collect()[0]["duplicates"]
        if n:
            raise ValueError(f"{n} rows share a key with another row, which the policy 'reject' does not allow")
        return df
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"Unknown duplicate policy: {policy}")
    if order_by is None:
        raise ValueError(f"Duplicate policy '{policy}' needs order_by")
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # A row with an incomplete key never matches and is never a duplicate: a
    # unique id keeps it in a group of its own, so one aggregation over one
    # scan handles both kinds of rows.
    solo = "__solo"
    keyed = df.withColumn(solo, F.when(~complete, F.monotonically_increasing_id()))
    keys = [*keys, solo]
    if policy in ("first", "last"):
        kept = keep_one_per_key(keyed, keys, order_by, policy).drop(solo)
    else:
        # AGGREGATE: numeric non-key columns summed (an all-missing group sums
        # to 0), every other column takes its first non-missing value.
        ordinal = order_key(order_by)
        aggs = []
        for f in df.schema.fields:
            if f.name in keys:
                continue
            c = F.col(f.name)
            if _numeric(f.dataType) and f.name not in original_keys:
                value = F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c
                # the sum keeps its wider type (long, double, wider decimal)
                aggs.append(F.coalesce(F.sum(value), F.lit(0)).alias(f.name))
            else:
                aggs.append(F.min_by(c, F.when(c.isNotNull(), ordinal)).alias(f.name))
        kept = keyed.groupBy(*keys).agg(*aggs).select(*df.columns)
    return kept


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType) or (isinstance(dtype, T.ArrayType) and _holds_map(dtype.elementType))


def _salted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """0 where the key is complete, else a hash of the row."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    row = [F.col(f"`{f.name}`") for f in df.schema.fields if not _holds_map(f.dataType)]
    return df.withColumn(name, F.when(complete, F.lit(0).cast("long")).otherwise(F.xxhash64(*row)))


def _heavy_keys(left: DataFrame, right: DataFrame, mk: Sequence[str], rk: Sequence[str], heavy_rows: int) -> DataFrame | None:
    """Keys with about ``heavy_rows`` rows or more on a side: ``__hk{i}``, rows of both sides, pieces, and which side is cut.

    Candidates come from a count (of a twentieth of the rows, where keys are
    that heavy); their rows are then counted in full.  None without such a key.
    """
    names = [f"__hk{i}" for i in range(len(mk))]
    share = 1.0 if heavy_rows <= 20_000 else 0.05

    def keys(df, own):
        complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in own])
        return df.filter(complete).select(*[F.col(k).alias(n) for k, n in zip(own, names)])

    def many(df, own):
        some = keys(df, own) if share == 1.0 else keys(df, own).sample(share, seed=11)
        return some.groupBy(*names).count().filter(F.col("count") >= heavy_rows * share).select(*names)

    found = materialise(many(left, mk).union(many(right, rk)).distinct(), "heavy-keys")
    if found.isEmpty():
        return None
    out = found
    for df, own, name in ((left, mk, "__n_main"), (right, rk, "__n_related")):
        out = out.join(keys(df, own).join(found, names).groupBy(*names).agg(F.count(F.lit(1)).alias(name)), names, "left")
    n_main, n_related = [F.coalesce(c, F.lit(0)).cast("long") for c in ("__n_main", "__n_related")]
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(n_main, n_related) / F.lit(heavy_rows))).cast("long")
    out = out.select(
        *names,
        ((n_main > 0) & (n_related > 0)).alias("__both"),
        pieces.alias("__pieces"),
        (n_main >= n_related).alias("__cut_main"),
    )
    return materialise(out, "heavy-counts")


def outer_join(left: DataFrame, right: DataFrame, mk: Sequence[str], rk: Sequence[str], on: Column, heavy_rows: int) -> DataFrame:
    """Full outer join on ``on`` (equal keys, by column name), heavy keys apart.

    A heavy key that both sides have leaves no row unmatched, so an inner join
    does: its larger side is cut by a hash of the row and its task, the other is
    repeated once for each piece.  A heavy key that one side alone has matches
    nothing: its rows pass without a join.  All other keys are joined as usual.
    """
    heavy = _heavy_keys(left, right, mk, rk, heavy_rows)
    if heavy is None:
        return left.join(right, on, "full_outer")
    names = [f"__hk{i}" for i in range(len(mk))]
    extra = [*names, "__both", "__pieces", "__cut_main", "__piece"]

    def told(df, own):
        match = reduce(lambda a, b: a & b, [F.col(k) == F.col(n) for k, n in zip(own, names)])
        return df.join(heavy, match, "left")

    def pieces(df, cut):
        row = [F.col(f"`{f.name}`") for f in df.schema.fields if not _holds_map(f.dataType)]
        one = F.array(F.pmod(F.xxhash64(*row, F.spark_partition_id()), F.col("__pieces")))
        every = F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1)
        both = df.filter("__both").withColumn("__slots", F.when(cut, one).otherwise(every))
        return both.withColumn("__piece", F.explode("__slots")).drop("__slots")

    main, related = told(left, mk), told(right, rk)
    cut_main = F.col("__cut_main")
    usual = main.filter(F.col("__both").isNull()).drop(*extra).join(
        related.filter(F.col("__both").isNull()).drop(*extra), on, "full_outer"
    )
    cut = pieces(main, cut_main).drop(*extra[:-1])
    other = pieces(related, ~cut_main).drop(*extra[:-1]).withColumnRenamed("__piece", "__piece_related")
    inner = cut.join(other, on & (F.col("__piece") == F.col("__piece_related")), "inner").drop("__piece", "__piece_related")
    out = usual.unionByName(inner)
    for side in (main, related):
        out = out.unionByName(side.filter(~F.col("__both")).drop(*extra), allowMissingColumns=True)
    return out


def _coalesced(joined: DataFrame, primary_name: str, fallback_name: str) -> Column:
    """F11 over two joined columns; differing types meet as text."""
    tp, tf = joined.schema[primary_name].dataType, joined.schema[fallback_name].dataType
    primary, fallback = F.col(primary_name), F.col(fallback_name)
    if tp != tf:
        primary, fallback = text_of(primary, tp), text_of(fallback, tf)
    return F.when(is_blank(F.col(primary_name), tp), fallback).otherwise(primary)


def key_join(
    main: DataFrame,
    related: DataFrame,
    spec: JoinSpec,
    main_order: OrderBy | None = None,
    related_order: OrderBy | None = None,
    carry_keys: bool = False,
    main_prepared: Sequence[str] | None = None,
) -> JoinResult:
    """Join ``related`` onto ``main``.

    Steps: key text -> [fuzzy remap] -> duplicate policy on related (and main
    with ``dedupe_sides='both'``) -> join -> conflict policy.  Same-named
    columns other than the joined keys get ``main_suffix`` / ``related_suffix``;
    PREFER_MAIN / PREFER_RELATED fold each such non-key pair into one column
    (preferred unless blank) placed last.  ``diagnostics`` is one row:
    matched, main_only, related_only (rows of the result) and duplicates
    (related rows under a repeated key).
    """
    left_keys, right_keys = list(spec.left_keys), list(spec.right_keys)
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("A join needs key columns on both sides, in pairs")
    how = HOW.get(spec.how)
    if how is None:
        raise ValueError(f"Unknown join type: {spec.how}")
    if spec.conflict_policy not in CONFLICT_POLICIES:
        raise ValueError(f"Unknown conflict policy: {spec.conflict_policy}")
    n = len(left_keys)
    mk, rk = [_mk(i) for i in range(n)], [_rk(i) for i in range(n)]
    main_cols = [c for c in main.columns if c not in (main_prepared or [])]
    related_cols = list(related.columns)
    if main_prepared:
        left = main
        for src, dst in zip(main_prepared, mk):
            left = left.withColumn(dst, F.col(src))
        left = left.drop(*main_prepared)
    else:
        left = prepare_keys(main, left_keys, mk, spec)
    right = prepare_keys(related, right_keys, rk, spec)

    if spec.fuzzy:
        if n != 1:
            raise ValueError("Similar keys are matched on a single pair of columns")
        if main_order is None:
            raise ValueError("Fuzzy matching needs main_order (ties go to the first main key)")
        from tessera.operators.fuzzy import fuzzy_key_map

        main_keys = (
            left.filter(F.col(mk[0]).isNotNull() & (F.col(mk[0]) != ""))
            .groupBy(F.col(mk[0]).alias("key"))
            .agg(F.min(order_key(main_order)).alias("first"))
        )
        related_keys = right.filter(F.col(rk[0]).isNotNull() & (F.col(rk[0]) != "")).select(
            F.col(rk[0]).alias("key")
        ).distinct()
        # The matching reads each key set several times; checkpoint both (to
        # the shared spark.checkpoint.dir) so the large inputs are scanned once
        # for their keys and lineage is cut for recovery.
        checkpoint_dir(main.sparkSession)
        main_keys = main_keys.checkpoint(eager=True)
        related_keys = related_keys.checkpoint(eager=True)
        mapping = fuzzy_key_map(main_keys, related_keys, spec.fuzzy_threshold)
        right = (
            right.join(mapping.withColumnRenamed("key", rk[0]), rk[0], "left")
            .withColumn(rk[0], F.coalesce(F.col("target"), F.col(rk[0])))
            .drop("target")
        )

    duplicates = duplicate_rows(right, rk)
    right = apply_duplicate_policy(right, rk, spec.duplicate_policy, related_order, right_keys)
    if spec.dedupe_sides == "both":
        left = apply_duplicate_policy(left, mk, spec.duplicate_policy, main_order, left_keys)

    overlap = [c for c in main_cols if c in related_cols]
    # names of the result are new even where the main side is a join's result itself
    names_used = Names(taken=[c for c in [*main_cols, *related_cols] if c not in overlap])
    to_main = {c: names_used.take(f"{c}{spec.main_suffix}") for c in overlap}
    to_related = {c: names_used.take(f"{c}{spec.related_suffix}") for c in overlap}
    conflict = [c for c in overlap if c not in set(left_keys) | set(right_keys)]
    left = left.withColumnsRenamed(to_main).withColumn(_IN_MAIN, F.lit(True))
    right = right.withColumnsRenamed(to_related).withColumn(_IN_RELATED, F.lit(True))
    cond = reduce(lambda a, b: a & b, [F.col(m) == F.col(r) for m, r in zip(mk, rk)])
    if how != "inner":
        # rows without a complete key match nothing: a salt keeps them from meeting in one task
        left, right = _salted(left, mk, "__salt_main"), _salted(right, rk, "__salt_related")
        cond = cond & (F.col("__salt_main") == F.col("__salt_related"))
    if how == "full_outer":
        joined = outer_join(left, right, mk, rk, cond, spec.heavy_rows)
    else:
        joined = left.join(right, cond, how)

    out_main = [to_main.get(c, c) for c in main_cols]
    out_related = [to_related.get(c, c) for c in related_cols]
    cols: list[Column] = [F.col(c) for c in out_main] + [F.col(c) for c in out_related]
    names = out_main + out_related
    if spec.conflict_policy != "keep_both":
        for c in conflict:
            a, b = to_main[c], to_related[c]
            primary, fallback = (a, b) if spec.conflict_policy == "prefer_main" else (b, a)
            keep = [i for i, nm in enumerate(names) if nm not in (a, b)]
            cols = [cols[i] for i in keep] + [_coalesced(joined, primary, fallback).alias(c)]
            names = [names[i] for i in keep] + [c]
    if carry_keys:
        cols += [F.coalesce(F.col(m), F.col(r)).alias(f"__carry{i}") for i, (m, r) in enumerate(zip(mk, rk))]
    result = joined.select(*cols, F.col(_IN_MAIN), F.col(_IN_RELATED))

    diagnostics = _diagnostics(result, duplicates)
    return JoinResult(result.drop(_IN_MAIN, _IN_RELATED), diagnostics, duplicates, result)


def _diagnostics(result: DataFrame, duplicates: DataFrame) -> DataFrame:
    in_main, in_rel = F.col(_IN_MAIN).isNotNull(), F.col(_IN_RELATED).isNotNull()
    counts = result.agg(
        F.count(F.when(in_main & in_rel, 1)).cast("long").alias("matched"),
        F.count(F.when(in_main & ~in_rel, 1)).cast("long").alias("main_only"),
        F.count(F.when(~in_main & in_rel, 1)).cast("long").alias("related_only"),
    )
    # the duplicate count is a one-row aggregate: attach it as a scalar subquery
    return counts.withColumn("duplicates", duplicates.select("duplicates").scalar())


def chain_join_steps(
    frames: Sequence[DataFrame],
    spec: JoinSpec,
    orders: Sequence[OrderBy | None] | None = None,
) -> tuple[DataFrame, list[JoinResult]]:
    """The chained result, and each step's own result with its diagnostics.

    The normalised key is carried from step to step (coalesced over both
    sides), so later steps still find it after same-named keys got suffixes.
    With fuzzy matching the first input's order is carried too: ties go to the
    key that came first there, keys that only a later input brought come last.
    """
    if len(frames) < 2:
        raise ValueError("A chained join needs at least two inputs")
    orders = list(orders or [None] * len(frames))
    carried = [f"__carry{i}" for i in range(len(spec.left_keys))]
    place = "__place"
    result, main_order, prepared = frames[0], orders[0], None
    if spec.fuzzy and main_order is not None:
        result = result.withColumn(place, order_key(main_order))
        main_order = [F.struct(F.col(place).isNull().alias("late"), F.col(place).alias("place"))]
    steps: list[JoinResult] = []
    for frame, order in zip(frames[1:], orders[1:]):
        steps.append(key_join(result, frame, spec, main_order, order, carry_keys=True, main_prepared=prepared))
        result, prepared = steps[-1].df, carried
        if not spec.fuzzy:
            main_order = None
    return result.drop(*carried, place), steps


def chain_join(
    frames: Sequence[DataFrame],
    spec: JoinSpec,
    orders: Sequence[OrderBy | None] | None = None,
) -> DataFrame:
    """Left fold of ``key_join`` over N inputs with the same key names."""
    return chain_join_steps(frames, spec, orders)[0]


def suggest_join_keys(main: DataFrame, related: DataFrame) -> tuple[list[str], list[str]]:
    """The first main field also present in related, as a one-pair key."""
    for c in main.columns:
        if c in related.columns:
            return [c], [c]
    return [], []


# ---------------------------------------------------------------------------
# side by side


def side_by_side(
    frames: Sequence[DataFrame],
    order_bys: Sequence[OrderBy],
    labels: Sequence[str] | None = None,
    prefix: bool = False,
    gap: int = 0,
    basic_names: bool = False,
    keep_position: bool = False,
    hidden: Sequence[str] = (),
) -> DataFrame:
    """Align rows by position, pad short tables with NULL.

    ``prefix`` names columns ``label · column``; repeats get ``_2``... (or,
    with ``basic_names``, ``column_Source{i}``).  ``gap`` blank spacer columns
    ``__gap_{i}_{p}`` holding ``''`` go between tables; ``hidden`` columns (an
    ordinal, say) order the rows but are not shown.  Each table gets a dense
    index; the tables are full-outer joined on it (unique keys, no skew).
    """
    if not frames:
        raise ValueError("Nothing to place side by side")
    labels = list(labels or [f"Table{i}" for i in range(1, len(frames) + 1)])
    names = Names()
    pieces: list[DataFrame] = []
    order_out: list[str] = []
    for i, (frame, order, label) in enumerate(zip(frames, order_bys, labels), start=1):
        mapping = {}
        shown = [c for c in frame.columns if c not in hidden]
        for c in shown:
            if basic_names:  # the table's number marks a repeat, and a counter further ones
                mapping[c] = names.take(c, lambda k, i=i: f"_Source{i}" + (f"_{k}" if k > 1 else ""), first=1)
            else:
                mapping[c] = names.take(f"{label} · {c}" if prefix else c)
        indexed = dense_index(frame, order, name="_pos")
        pieces.append(indexed.select("_pos", *[F.col(c).alias(mapping[c]) for c in shown]))
        order_out += [mapping[c] for c in shown]
        if gap and i < len(frames):
            order_out += [f"__gap_{i}_{p}" for p in range(1, gap + 1)]
    joined = reduce(lambda a, b: a.join(b, "_pos", "full_outer"), pieces)
    gaps = [c for c in order_out if c.startswith("__gap_") and names.is_free(c)]
    joined = joined.select("*", *[F.lit("").alias(g) for g in gaps])
    cols = (["_pos"] if keep_position else []) + order_out
    return joined.select(*cols)
