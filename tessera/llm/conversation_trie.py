"""A prefix trie of conversations as a burst trie, spread over shards.

1. Turns become ids (128 bits of SHA-256 over role and text) and are numbered in
   their conversation by a distributed index.  Conversations are rebuilt with the
   first turns of another one.  Each turn carries the key of the prefix that ends
   in it: the exclusive or of hashes of (position, id), summed in chunks, so that
   no conversation, however long, is gathered.
2. Equal conversations have equal keys at their end: they become one element
   with a weight, so groups of copies cost no more than one of them.
3. All elements start in the container of the root.  A container of two elements
   or more with more than ``limit`` turns left bursts: its head becomes a trie
   node, and each element moves to the head of its next turn id.  One round bursts
   as many levels as a window over the next turns shows.
4. A container that is left holds at most ``limit`` turns.  It is sorted and swept
   by one task, which gives its nodes with the sums over their subtrees; a
   container of one element is a chain, whose nodes are its turns, by rows.
5. Sums over the subtrees of the burst nodes add up what hangs below: each item
   (burst node or container) is counted on the path of its smallest member.
6. The ids of a group of copies are joined in sorted pieces before the one task
   that a SHA-256 over them all needs reads them as a stream.

The burst rounds follow the depth to which more than ``limit`` turns share one
prefix; the window grows as elements get fewer.

Defined cases: rows without conversation id take no part; null roles and texts
are empty; turns of one number (also null ones) are ordered by their ids, and
repeated rows are turns of their own.  A conversation whose rebuilt form has no
turn is a member of the root.  Extra columns are ignored.  An empty table gives no
rows, since no node has a member.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.operators.ordinals import dense_index

WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Turns of a conversation whose prefix keys are made by one window.
CHUNK = 4096
#: Rows that a burst round looks at, about, when it has few elements.
ROUND_ROWS = 4_000_000
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "tid")


def turn_rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, turn, tid, words): the turns that take part, without their texts."""
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("c"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("tid"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("place"),
    ).filter(F.col("c").isNotNull())


def rebuilt_turns(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations: c, len; rebuilt turns: c, pos, tid, words).

    The first h turns come from conversation ``c - c % block``, with h the CRC-32 of the decimal id modulo ``most``.
    """
    ordered = dense_index(turns, ["c", "turn", "tid", "place"], name="i").select("c", "i", "tid", "words")
    convs = ordered.groupBy("c").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    convs = convs.select(
        "*",
        (F.col("c") - F.col("c") % F.lit(block)).alias("b"),
        (F.crc32(F.col("c").cast("string").cast("binary")) % F.lit(most)).cast("long").alias("h"),
    )
    convs = materialise(convs, "trie-conversations")
    bases = convs.filter("c = b").select("b", F.col("n").alias("nb"))
    convs = convs.join(bases, "b", "left").withColumn("q", F.least("h", F.coalesce("nb", F.lit(0).cast("long"))))
    convs = convs.withColumn("len", F.col("q") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
    ranked = ordered.join(convs.select("c", "first", "h", "q"), "c").withColumn("r", F.col("i") - F.col("first") + 1)
    own = ranked.filter("r > h").select("c", (F.col("q") + F.col("r") - F.col("h")).alias("pos"), "tid", "words")
    heads = convs.filter("c = b").select("c", "first")
    lead = ordered.join(heads, "c").select(F.col("c").alias("b"), (F.col("i") - F.col("first") + 1).alias("pos"), "tid", "words")
    lead = lead.filter(F.col("pos") < most)
    lead = convs.select("c", "b", "h").join(lead, "b").filter("pos <= h").select("c", "pos", "tid", "words")
    return convs.select("c", "len"), own.unionByName(lead)


def keyed_turns(rebuilt: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds k1, k2 (the key of the prefix that ends here) and w (its words)."""
    rows = materialise(rebuilt.withColumn("chunk", F.floor((F.col("pos") - 1) / F.lit(chunk)).cast("long")), "trie-turns")
    later = rows.filter("chunk > 0").select("c").distinct()
    totals = (
        rows.join(later, "c", "left_semi")
        .groupBy("c", "chunk")
        .agg(F.bit_xor(_hash(1)).alias("x1"), F.bit_xor(_hash(2)).alias("x2"), F.sum("words").alias("x3"))
    )
    over = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = totals.select(
        "c",
        (F.col("chunk") + 1).alias("chunk"),
        F.bit_xor("x1").over(over).alias("x1"),
        F.bit_xor("x2").over(over).alias("x2"),
        F.sum("x3").over(over).alias("x3"),
    )
    inside = Window.partitionBy("c", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    keyed = rows.select(
        "*",
        F.bit_xor(_hash(1)).over(inside).alias("k1"),
        F.bit_xor(_hash(2)).over(inside).alias("k2"),
        F.sum("words").over(inside).alias("w"),
    ).join(before, ["c", "chunk"], "left")
    return materialise(
        keyed.select(
            "c",
            "pos",
            "tid",
            "words",
            F.col("k1").bitwiseXOR(F.coalesce("x1", zero)).alias("k1"),
            F.col("k2").bitwiseXOR(F.coalesce("x2", zero)).alias("k2"),
            (F.col("w") + F.coalesce("x3", zero)).alias("w"),
        ),
        "trie-keys",
    )


def copies_sha(members: DataFrame, per_piece: int = 1024) -> DataFrame:
    """(rep, sha) for (rep, c) rows: the SHA-256 of the decimal ids in ascending order, comma-joined."""

    def pieces(batches):
        rep, ids = None, []
        for batch in batches:
            rows = []
            for r, c in zip(*[x.to_pylist() for x in batch.columns]):
                if r != rep or len(ids) == per_piece:
                    if ids:
                        rows.append((rep, ids[0], ",".join(map(str, ids))))
                    rep, ids = r, []
                ids.append(c)
            yield _records(rows, ["rep", "first", "ids"], [pa.int64(), pa.int64(), pa.string()])
        if ids:
            yield _records([(rep, ids[0], ",".join(map(str, ids)))], ["rep", "first", "ids"], [pa.int64(), pa.int64(), pa.string()])

    def digests(batches):
        rep, sha = None, None
        for batch in batches:
            rows = []
            for r, _, ids in zip(*[x.to_pylist() for x in batch.columns]):
                if r != rep:
                    if sha is not None:
                        rows.append((rep, sha.hexdigest()))
                    rep, sha = r, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield _records(rows, ["rep", "sha"], [pa.int64(), pa.string()])
        if sha is not None:
            yield _records([(rep, sha.hexdigest())], ["rep", "sha"], [pa.int64(), pa.string()])

    ranged = members.select("rep", "c").repartitionByRange("rep", "c").sortWithinPartitions("rep", "c")
    joined = ranged.mapInArrow(pieces, "rep long, first long, ids string")
    return joined.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep long, sha string")


def _records(rows, names, kinds):
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def sweep(elements: list[tuple[int, int, int, list[tuple[bytes, int]]]], top: int) -> list[tuple]:
    """The nodes of one container, its top first.

    ``elements`` are (rep, weight, length, turns from position ``top`` on), all with the same first turn.  A node is
    (conv, depth, parent's conv, n_convs, n_children, n_leaves, saved, the element that ends there or None).
    """
    elements = sorted(elements, key=lambda e: [t for t, _ in e[3]])
    nodes: list[list] = []  # [conv, depth, parent's place, n_convs, children, leaves, saved, end, words]
    path: list[int] = []

    def close(depth):
        while len(path) > depth:
            node = nodes[path.pop()]
            node[5] = node[5] or 1  # a node without children is a leaf
            node[6] += (node[3] - 1) * node[8]
            if path:
                above = nodes[path[-1]]
                above[4] += 1
                above[5] += node[5]
                above[6] += node[6]

    last: list[tuple[bytes, int]] = []
    for rep, weight, _, turns in elements:
        shared = 0
        while shared < min(len(last), len(turns)) and last[shared][0] == turns[shared][0]:
            shared += 1
        close(shared)
        for at in path:
            nodes[at][0] = min(nodes[at][0], rep)
            nodes[at][3] += weight
        for k in range(shared, len(turns)):
            nodes.append([rep, top + k, path[-1] if path else None, weight, 0, 0, 0, None, turns[k][1]])
            path.append(len(nodes) - 1)
        nodes[path[-1]][7] = rep
        last = turns
    close(0)
    return [(n[0], n[1], None if n[2] is None else nodes[n[2]][0], *n[3:8]) for n in nodes]


SWEPT = f"{NODES}, end_rep long, end_sha string, is_top boolean"


def _sweep_containers(batches):
    """Rows (rep, top, k1, k2, weight, len, parent, sha, pos, tid, words), sorted by container, element and position."""
    names = [c.split()[0] for c in SWEPT.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.string(), pa.bool_()]
    key, parent, elements, shas = None, None, {}, {}

    def nodes():
        for n in sweep([(r, *e) for r, e in elements.items()], key[0]):
            conv, depth, above, *rest, end = n
            is_top = depth == key[0]
            yield (conv, depth, parent if is_top else above, *rest, end, shas.get(end), is_top)

    for batch in batches:
        out = []
        for rep, top, k1, k2, weight, length, above, sha, _, tid, words in zip(*[c.to_pylist() for c in batch.columns]):
            if (top, k1, k2) != key:
                if key is not None:
                    out += nodes()
                key, parent, elements, shas = (top, k1, k2), above, {}, {}
            if rep not in elements:
                elements[rep] = (weight, length, [])
                shas[rep] = sha
            elements[rep][2].append((tid, words))
        yield _records(out, names, kinds)
    if key is not None:
        yield _records(list(nodes()), names, kinds)


def burst(turns: DataFrame, elements: DataFrame, limit: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(burst nodes; rows (rep, pos, k1, k2, ...) of each element on its path, the last one its container's top).

    ``turns`` are keyed turns, ``elements`` (rep, weight, len).
    """
    active = elements.filter("len > 0").withColumn("p", F.lit(0).cast("long"))
    count, p = active.count(), 0
    all_nodes = all_marked = None
    while count:
        width = max(window, min(CHUNK, ROUND_ROWS // count))
        rows = (
            turns.filter(F.col("pos").between(p + 1, p + width))
            .join(active.select(F.col("rep").alias("c"), "weight", "len"), "c")
            .select(
                F.col("c").alias("rep"),
                "pos",
                "k1",
                "k2",
                F.col("k1").bitwiseXOR(_hash(1)).alias("pk1"),
                F.col("k2").bitwiseXOR(_hash(2)).alias("pk2"),
                "words",
                "weight",
                "len",
            )
        )
        heads = rows.groupBy("pos", "k1", "k2").agg(
            F.count(F.lit(1)).alias("elements"),
            F.sum(F.col("len") - F.col("pos") + 1).alias("left"),
            F.sum("weight").alias("n_convs"),
            F.min("rep").alias("conv"),
            F.max("words").alias("words"),
            F.max(F.when(F.col("len") == F.col("pos"), F.col("rep"))).alias("end_rep"),
            F.max("pk1").alias("pk1"),
            F.max("pk2").alias("pk2"),
        )
        nodes = materialise(heads.filter((F.col("elements") > 1) & (F.col("left") > limit)).drop("elements", "left"), "trie-heads")
        itself = nodes.select("pos", "k1", "k2", F.lit(True).alias("burst"))
        above = nodes.select((F.col("pos") + 1).alias("pos"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.lit(True).alias("under"))
        marked = rows.join(itself, ["pos", "k1", "k2"], "left").withColumn("burst", F.coalesce("burst", F.lit(False)))
        marked = marked.join(above, ["pos", "pk1", "pk2"], "left").filter(
            F.col("burst") | F.coalesce("under", F.lit(False)) | (F.col("pos") == p + 1)
        )
        marked = materialise(marked.select(*rows.columns, "burst"), "trie-marked")
        all_nodes = nodes if all_nodes is None else all_nodes.unionByName(nodes)
        all_marked = marked if all_marked is None else all_marked.unionByName(marked)
        p += width
        active = marked.filter(F.col("burst") & (F.col("pos") == p) & (F.col("len") > p)).select("rep", "weight", "len")
        count = active.count()
    return all_nodes, all_marked


def conversation_trie(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    limit: int = 512,
    window: int = 16,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row a node: the columns of ``NODES`` and ``ends_sha256``."""
    spark = conversations.sparkSession
    convs, rebuilt = rebuilt_turns(turn_rows(conversations, id_col, turn_col, role_col, text_col))
    turns = keyed_turns(rebuilt, chunk)
    zero = F.lit(0).cast("long")
    ends = turns.select("c", F.col("pos").alias("len"), "k1", "k2", "w")
    whole = convs.join(ends, ["c", "len"], "left").select(
        "c", "len", F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2"), F.coalesce("w", zero).alias("w")
    )
    whole = materialise(whole, "trie-whole")
    classes = whole.groupBy("len", "k1", "k2").agg(
        F.min("c").alias("rep"), F.count(F.lit(1)).alias("weight"), F.max("w").alias("all_words")
    )
    classes = materialise(classes, "trie-classes")
    shared = classes.filter("weight > 1").select("len", "k1", "k2", "rep")
    shas = materialise(copies_sha(whole.join(shared, ["len", "k1", "k2"])), "trie-ends")

    heads, marked = burst(turns, classes.select("rep", "weight", "len"), limit, window)
    summary = whole.agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    end_of = lambda rep, sha: F.when(F.col(rep).isNull(), F.lit(EMPTY_SHA)).otherwise(
        F.coalesce(F.col(sha), F.sha2(F.col(rep).cast("string"), 256))
    )
    out_cols = [c.split()[0] for c in NODES.split(", ")]
    root_end = classes.filter("len = 0").join(shas, "rep", "left").select("rep", "sha").first()
    root = {"end": root_end.rep if root_end else None, "sha": root_end.sha if root_end else None}
    if summary.n == 0 or heads is None:
        bare = [(summary.conv, 0, None, summary.n, 0, 1, 0, root["end"], root["sha"])] if summary.n else []
        out = spark.createDataFrame(bare, f"{NODES}, end_rep long, end_sha string")
        return out.select(*out_cols, end_of("end_rep", "end_sha").alias("ends_sha256"))

    # containers, with the smallest member of the burst node above them
    parents = heads.select((F.col("pos") + 1).alias("pos"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv").alias("above"))
    at_top = marked.filter(~F.col("burst"))
    tops = at_top.groupBy("pos", "k1", "k2").agg(
        F.count(F.lit(1)).alias("elements"), F.max("pk1").alias("pk1"), F.max("pk2").alias("pk2")
    )
    tops = tops.join(parents, ["pos", "pk1", "pk2"], "left").withColumn("above", F.coalesce("above", F.lit(summary.conv)))
    tops = materialise(tops, "trie-tops")
    held = at_top.select("rep", "pos", "k1", "k2", "weight", "len").join(
        tops.select("pos", "k1", "k2", "elements", "above"), ["pos", "k1", "k2"]
    )
    held = held.join(classes.select("rep", "all_words"), "rep").join(shas, "rep", "left")
    held = materialise(held.withColumnRenamed("pos", "top").withColumnsRenamed({"k1": "t1", "k2": "t2"}), "trie-elements")
    below = turns.join(held.withColumnRenamed("rep", "c"), "c").filter("pos >= top")
    last = F.col("pos") == F.col("len")
    chains = below.filter("elements = 1").select(
        F.col("c").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.when(F.col("pos") == F.col("top"), F.col("above")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"),
        F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("all_words") - F.col("w") + F.col("words"))).alias("saved_tokens"),
        F.when(last, F.col("c")).alias("end_rep"),
        F.when(last, F.col("sha")).alias("end_sha"),
        (F.col("pos") == F.col("top")).alias("is_top"),
    )
    boxes = below.filter("elements > 1").select(
        F.col("c").alias("rep"), "top", "t1", "t2", "weight", "len", "above", "sha", "pos", "tid", "words"
    )
    boxes = boxes.repartition("top", "t1", "t2").sortWithinPartitions("top", "t1", "t2", "rep", "pos")
    hanging = materialise(chains.unionByName(boxes.mapInArrow(_sweep_containers, SWEPT)), "trie-nodes")

    # what hangs below each burst node, added up along the path of each item's smallest member
    own_saved = (F.col("n_convs") - 1) * F.col("words")
    items = hanging.filter("is_top").select(
        F.col("conv_id").alias("rep"), F.col("depth").alias("pos"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")
    )
    items = items.unionByName(heads.select(F.col("conv").alias("rep"), "pos", zero.alias("leaves"), own_saved.alias("saved")))
    # an item's row may be a burst node's (its own) or a container's top, whose key is not a burst node's
    steps = marked.join(items.select("rep").distinct(), "rep", "left_semi").join(items, ["rep", "pos"], "left")
    onward = Window.partitionBy("rep").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.select(
        "pos",
        "k1",
        "k2",
        "burst",
        F.sum(F.coalesce("leaves", zero)).over(onward).alias("leaves"),
        F.sum(F.coalesce("saved", zero)).over(onward).alias("saved"),
    )
    sums = sums.filter("burst").groupBy("pos", "k1", "k2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = (
        heads.select("pos", "pk1", "pk2")
        .unionByName(tops.select("pos", "pk1", "pk2"))
        .groupBy((F.col("pos") - 1).alias("pos"), F.col("pk1").alias("k1"), F.col("pk2").alias("k2"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    children = materialise(children, "trie-children")
    burst_nodes = (
        heads.join(sums, ["pos", "k1", "k2"])
        .join(children, ["pos", "k1", "k2"])
        .join(parents, ["pos", "pk1", "pk2"], "left")
        .join(shas.withColumnsRenamed({"rep": "end_rep", "sha": "end_sha"}), "end_rep", "left")
        .select(
            F.col("conv").alias("conv_id"),
            F.col("pos").alias("depth"),
            F.coalesce("above", F.lit(summary.conv)).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            "end_rep",
            "end_sha",
        )
    )
    total = items.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).first()
    first_level = children.filter("pos = 0").agg(F.max("n_children")).first()[0]
    root_node = spark.createDataFrame(
        [(summary.conv, 0, None, summary.n, first_level, total.leaves, total.saved, root["end"], root["sha"])],
        f"{NODES}, end_rep long, end_sha string",
    )
    nodes = hanging.drop("is_top").unionByName(burst_nodes).unionByName(root_node)
    return nodes.select(*out_cols, end_of("end_rep", "end_sha").alias("ends_sha256"))
