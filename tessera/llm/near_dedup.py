"""MinHash near-dedup with sequential Bayesian verification of banded candidates.

1. Every whole text becomes its set of distinct word shingles (64-bit hashes)
   and a MinHash signature.  Texts with equal sets form a class, which is one
   node from here on, whatever its number of copies.
2. Signatures are cut into bands; nodes that agree on a band share a bucket.
   The number of bands follows from the threshold and ``miss``.
3. Candidates are verified sequentially: batches of hashes are compared, and a
   pair is given up as soon as the posterior probability (uniform prior) that
   its similarity reaches the threshold falls below ``miss``.  Survivors are
   confirmed on the full shingle sets.
4. Links join nodes into components (large-star, small-star).

A bucket's pairs are not listed.  First every node meets its bucket's pivot,
which settles large groups of copies in linear work.  Then only buckets that
still hold several components are looked at, and only pairs across components:
the nodes outside the bucket's largest component meet the others in blocks of
``block`` nodes, signatures first, then sets, inside numpy.  A block reports one
sure link between two components, and every narrow one; reported links are
confirmed on the 64-bit sets.  Every pair across components that no batch rules
out is counted unless its components are linked already: no partner is capped.

Defined cases: a text without words (or null) has an empty set and is its own
component.  A null id takes part, but is never a component id unless the
component has no other; ``kept`` compares null-safely.  Rows that repeat an id
each get the component of their own text.  Columns of ``docs`` other than id
and text are not looked at.  An empty table yields an empty table.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmap import build_bitmap
from tessera.llm.common import materialise, own_exchange
from tessera.llm.graph import components
from tessera.llm.words import NOT_WHITE, mix, shingle_set, word_hashes

ROWS = 5
BATCH = 20
#: Coinciding 32-bit values that a sure link between two compact sets must survive, besides three times as many as chance gives.
SLACK = 4


def plan_bands(threshold: float, miss: float, rows: int = ROWS) -> int:
    """The number of bands of ``rows`` hashes that a pair at the threshold escapes with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(n_hashes: int, threshold: float, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on with) after each batch.

    With a uniform prior, P(similarity >= t | m of n match) equals
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(batch, n_hashes, batch), n_hashes]:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _permutations(n: int) -> np.ndarray:
    return np.random.default_rng(99).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, odd: np.ndarray) -> np.ndarray:
    low = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 2048):
        np.minimum(low, (odd[:, None] * values[None, k : k + 2048]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _set_key(values: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sketch(n: int, n_hashes: int):
    def run(batches):
        odd = _permutations(n_hashes)
        for batch in batches:
            words, offs = word_hashes(batch.column(1), NOT_WHITE)
            size, k1, k2, sigs = [], [], [], []
            for i in range(batch.num_rows):
                values = shingle_set(words[offs[i] : offs[i + 1]], n)
                key = _set_key(values) if len(values) else (None, None)
                size.append(len(values))
                k1.append(key[0])
                k2.append(key[1])
                sigs.append(signature(values, odd).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())],
                names=["id", "tag", "size", "k1", "k2", "sig"],
            )

    return run


def _sets(n: int, bitmap):
    """Full sets (64-bit hashes) and a compact form (their low 32 bits) of the rows whose id may be wanted."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            asked = np.zeros(batch.num_rows, dtype=bool)
            asked[bitmap.value.find(ids.fill_null(0).to_numpy().view(np.uint64))] = True
            asked |= ids.is_null().to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(asked))
            words, offs = word_hashes(some.column(1), NOT_WHITE)
            ids = some.column(0).to_pylist()
            rid, k1, k2, sets, small = [], [], [], [], []
            for i in range(some.num_rows):
                values = shingle_set(words[offs[i] : offs[i + 1]], n)
                if len(values):
                    key = _set_key(values)
                    rid.append(key[0] if ids[i] is None else ids[i])
                    k1.append(key[0])
                    k2.append(key[1])
                    sets.append(values.view(np.int64))
                    small.append(values.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (rid, k1, k2)]
                + [pa.array(sets, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                names=["rid", "k1", "k2", "set", "small"],
            )

    return run


def _matrix(column: pa.Array, n_hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), n_hashes)


def _bands(n_bands: int, rows: int):
    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column(1), n_bands * rows).astype(np.uint64)
            odd = _permutations(rows)
            keys = [
                mix(mix((sig[:, b * rows : (b + 1) * rows] * odd[None, :]).sum(axis=1)) + np.uint64(b))
                for b in range(n_bands)
            ]
            band = np.stack(keys, axis=1).reshape(-1).view(np.int64) if len(sig) else np.empty(0, np.int64)
            node = np.repeat(batch.column(0).to_numpy(), n_bands)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(node, pa.int64())], names=["band", "node"])

    return run


def _sequential(steps: list[tuple[int, int]], n_hashes: int):
    """Pairs (a, b, sig_a, sig_b) that no batch rules out."""

    def run(batches):
        for batch in batches:
            left, right = _matrix(batch.column(2), n_hashes), _matrix(batch.column(3), n_hashes)
            alive, done = np.arange(batch.num_rows), 0
            matches = np.zeros(batch.num_rows, np.int64)
            for upto, least in steps:
                matches[alive] += (left[alive, done:upto] == right[alive, done:upto]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], upto
            yield batch.select([0, 1]).take(pa.array(alive))

    return run


def _across(steps: list[tuple[int, int]], n_hashes: int, num: int, den: int):
    """One block of a bucket: links across components.

    Signatures rule out most pairs; what survives is counted on the compact
    sets.  Compact values may coincide, which can only raise a count, so a
    pass by a margin of ``SLACK`` and more for long texts is sure and ends the
    search between the two components, while a narrower one is passed on and the
    search continues.
    """

    def run(group: pa.Table) -> pa.Table:
        sig = _matrix(group.column("sig").combine_chunks(), n_hashes)
        node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
        outer = np.flatnonzero(group.column("outer").to_numpy(zero_copy_only=False))
        small = [np.frombuffer(x, np.uint32) for x in group.column("small").to_pylist()]
        size = np.array([len(x) for x in small])
        cut = np.append(0, np.cumsum(size))
        values, codes = np.unique(np.concatenate(small), return_inverse=True)
        parent = {int(c): int(c) for c in comp}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        pairs: list[tuple[int, int]] = []
        mine = np.zeros(len(values), dtype=bool)
        done_before = np.zeros(len(node), dtype=bool)
        for i in outer:
            done_before[i] = True
            alive, done = np.flatnonzero((comp != comp[i]) & ~done_before), 0
            matches = np.zeros(len(node), np.int64)
            for upto, least in steps:
                matches[alive] += (sig[alive, done:upto] == sig[i, done:upto]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], upto
            if not len(alive):
                continue
            mine[codes[cut[i] : cut[i + 1]]] = True
            for j in alive[np.argsort(-matches[alive], kind="stable")]:
                if root(int(comp[i])) == root(int(comp[j])):
                    continue
                common = int(mine[codes[cut[j] : cut[j + 1]]].sum())
                either = int(size[i] + size[j]) - common
                if common * den >= either * num:
                    pairs.append((max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j]))))
                    slack = SLACK + (3 * int(size[i]) * int(size[j]) >> 32)
                    if (common - slack) * den >= (either + slack) * num:
                        parent[root(int(comp[i]))] = root(int(comp[j]))
            mine[codes[cut[i] : cut[i + 1]]] = False
        a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return run


def _foreign_pairs(live: DataFrame, labels: DataFrame, profile: DataFrame, across, block: int) -> DataFrame:
    """Links across components (on the compact sets) in buckets that hold several."""
    tagged = live.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp"))
    counts = tagged.groupBy("band", "comp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"))
    buckets = (
        counts.groupBy("band")
        .agg(
            F.max(F.struct("n", "comp")).alias("top"),
            F.sum("n").alias("total"),
            F.count("*").alias("comps"),
            F.bit_xor("x").alias("x"),
        )
        .filter("comps > 1")
    )
    # buckets with the same members need one look only
    buckets = buckets.groupBy("x", "total", "comps").agg(F.min(F.struct("band", "top")).alias("b")).select(
        "b.band",
        F.col("b.top.comp").alias("big"),
        F.ceil(F.col("b.top.n") / block).cast("int").alias("xb"),
        F.ceil((F.col("total") - F.col("b.top.n")) / block).cast("int").alias("rb"),
    )
    members = tagged.join(buckets, "band").withColumn("outer", F.col("comp") != F.col("big"))
    spot = F.pmod(F.xxhash64(F.lit(5), "node"), F.when(F.col("outer"), F.col("rb")).otherwise(F.col("xb"))).cast("int")
    members = members.withColumn("spot", spot)
    among = F.transform(
        F.sequence(F.lit(0), F.col("rb") - 1),
        lambda j: F.struct(F.lit("r").alias("kind"), F.least("spot", j).alias("i"), F.greatest("spot", j).alias("j")),
    )
    outwards = F.transform(
        F.sequence(F.lit(0), F.col("xb") - 1),
        lambda j: F.struct(F.lit("x").alias("kind"), F.col("spot").alias("i"), j.alias("j")),
    )
    inwards = F.transform(
        F.sequence(F.lit(0), F.col("rb") - 1),
        lambda i: F.struct(F.lit("x").alias("kind"), i.alias("i"), F.col("spot").alias("j")),
    )
    tasks = members.select(
        "band", "node", "comp", "outer", F.explode(F.when(F.col("outer"), F.concat(among, outwards)).otherwise(inwards)).alias("t")
    )
    return (
        tasks.join(profile, "node")
        .groupBy("band", "t")
        .applyInArrow(across, "a long, b long")
        .distinct()
    )


def _grouped(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: Fraction | str | float = "0.8",
    miss: float = 1e-6,
    block: int = 512,
) -> DataFrame:
    """One row per row: ``id``, ``tag`` (hash of the text), ``size``, ``comp`` (null: no words) and ``component_id``."""
    exact = Fraction(str(threshold))
    t = float(exact)
    n_bands = plan_bands(t, miss)
    n_hashes = n_bands * ROWS
    steps = least_matches(n_hashes, t, miss)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    tagged = texts.withColumn("tag", F.xxhash64("text"))
    sketch = materialise(
        tagged.mapInArrow(_sketch(n, n_hashes), "id long, tag long, size long, k1 long, k2 long, sig binary"), "sketch"
    )
    classes = (
        sketch.filter("size > 0")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("first_id"), F.max("size").alias("size"))
        .withColumn("rid", F.coalesce("first_id", "k1"))
    )
    classes = materialise(classes, "classes")
    # a class is named by its smallest id, or by its key where several classes share that id
    shared_ids = classes.groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1")
    shared_ids = shared_ids.select(own_exchange(F.col("rid")).alias("rid"), F.lit(True).alias("again"))
    classes = classes.join(shared_ids, "rid", "left").withColumn(
        "node", F.when(F.col("again"), F.col("k1")).otherwise(F.col("rid"))
    )
    classes = materialise(classes.drop("again"), "named-classes")
    # one signature per class: that of a row with the class's smallest id
    one = ["k1", "k2", "rid"]
    sig = (
        sketch.filter("size > 0")
        .select("k1", "k2", F.coalesce("id", "k1").alias("rid"), "sig")
        .join(classes.select(*one, "node"), one)
        .dropDuplicates(one)
        .select("node", "sig")
    )
    sig = materialise(sig, "signatures")
    bands = sig.select("node", "sig").mapInArrow(_bands(n_bands, ROWS), "band long, node long")
    shared = bands.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).filter("members > 1")
    shared = shared.select(own_exchange(F.col("band")).alias("band"), "pivot")
    live = materialise(bands.join(shared, "band"), "buckets")
    # full sets of the nodes that share any bucket
    wanted = live.select("node").distinct().join(classes, "node").select("node", "rid", "k1", "k2", "first_id")
    wanted = materialise(wanted, "wanted")
    asked = wanted.select("first_id").filter("first_id is not null")
    bitmap = docs.sparkSession.sparkContext.broadcast(build_bitmap(asked, asked.count(), bits_each=16))
    sets = (
        texts.mapInArrow(_sets(n, bitmap), "rid long, k1 long, k2 long, set array<long>, small binary")
        .join(wanted.select(*one, "node"), one)
        .dropDuplicates(one)
        .select("node", "set", "small")
    )
    sets = materialise(sets, "sets")

    def links(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        scored = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b") - common).alias("either"))
        return scored.select(
            "a", "b", (F.col("common") * exact.denominator >= F.col("either") * exact.numerator).alias("linked")
        )

    pivots = live.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    left = sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    candidates = (
        pivots.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_sequential(steps, n_hashes), "a long, b long")
    )
    tested = materialise(links(candidates), "links")
    edges = tested.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = materialise(components(edges), "labels")
    across = _across(steps, n_hashes, exact.numerator, exact.denominator)
    profile = sets.select("node", "small").join(sig, "node")
    fresh = _foreign_pairs(live.select("band", "node"), labels, profile, across, block)
    fresh = links(fresh).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # the first links are stars by now, so only they and the new ones go in
    stars = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    labels = materialise(components(stars.union(fresh)), "labels")
    # a component's id is the smallest id of its classes (classes without any id have none to offer)
    named = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    ids = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    keyed = named.join(ids, "comp").select(own_exchange(F.col("k1")).alias("k1"), "k2", "comp", "component_id")
    out = sketch.join(keyed, ["k1", "k2"], "left").withColumn(
        "component_id", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    )
    return out.select("id", "tag", "size", "comp", "component_id")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept`` (options: see ``_grouped``)."""
    return _grouped(docs, id_col, text_col, **options).select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: one that has the group's smallest id.

    Of several texts under that id the one with the smallest hash stays, and
    rows equal in id and text become one.  Texts without words are no group and
    all stay.
    """
    rows = _grouped(docs, id_col, text_col, **options).filter(F.col("id").eqNullSafe(F.col("component_id")))
    one = rows.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("id", "tag")).alias("r"))
    wordless = rows.filter("comp is null").select("id", "tag").distinct()
    kept = one.select("r.id", "r.tag", F.lit(True).alias("single")).union(wordless.select("id", "tag", F.lit(False)))
    kept = kept.select(F.col("id").alias("_kept_id"), F.col("tag").alias("_kept_tag"), F.col("single").alias("_single"))
    tagged = docs.withColumn("_tag", F.xxhash64(F.col(f"`{text_col}`")))
    found = tagged.join(
        kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_kept_id")) & (F.col("_tag") == F.col("_kept_tag"))
    )
    # wordless rows stay whatever this number is; it only tells them apart
    found = found.withColumn("_row", F.when(~F.col("_single"), F.monotonically_increasing_id()))
    return found.dropDuplicates(["_kept_id", "_kept_tag", "_row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
