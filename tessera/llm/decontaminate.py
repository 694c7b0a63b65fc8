"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, A-Z lower-cased; runs of ``n`` words are
the seeds.  A tile is a run of at least ``n`` words that an item and a
document share; every tile therefore lies within stretches of shared seeds.

1. The benchmark's seeds go into a bitmap of bounded size (``max_bits``).  One
   pass over the documents keeps the stretches of words whose seeds hit it;
   the texts themselves are never shuffled.
2. The stretches' seeds are joined with the benchmark's, exactly.  A pair whose
   shared seeds cover less than the threshold of the item cannot reach it by
   tiles and goes.
3. Each remaining pair is tiled: the longest common runs of unmarked words are
   found by Karp-Rabin hashes of a search length that shrinks to ``n``, marked,
   and the search goes on, so that passages in another order are caught too.
   The share of the item's words under tiles decides.

Defined cases: null or empty texts share nothing; an item of fewer than ``n``
words has no seed and matches nothing.  Rows that repeat a document id are one
document, whose stretches are pooled, and a null id is an id like any other;
``decontaminate(by_row=True)`` judges each text of an id alone instead.  Rows
that repeat an item id (and null item ids) are items of their own, told apart
by their words.  Extra columns are not looked at.  Empty tables yield no pair.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmap import MAX_BITS, build_bitmap
from tessera.llm.common import materialise
from tessera.llm.words import LETTERS, mix, shingle_hashes, word_hashes

_BASE = np.uint64(0xD6E8FEB86659FD93)


def _items(n: int):
    def run(batches):
        for batch in batches:
            words, offs = word_hashes(batch.column(1), LETTERS)
            rows = [i for i in range(batch.num_rows) if offs[i + 1] - offs[i] >= n]
            own = [words[offs[i] : offs[i + 1]] for i in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([int(mix(_rolling(w)[0][-1:]).view(np.int64)[0]) for w in own], pa.int64()),
                    pa.array([w.view(np.int64) for w in own], pa.list_(pa.int64())),
                    pa.array([shingle_hashes(w, n).view(np.int64) for w in own], pa.list_(pa.int64())),
                ],
                names=["item_id", "item_key", "words", "seeds"],
            )

    return run


def _stretches(n: int, bitmap):
    """Per document, the maximal stretches of words under hits of the bitmap."""

    def run(batches):
        for batch in batches:
            words, offs = word_hashes(batch.column(1), LETTERS)
            seeds = shingle_hashes(words, n)
            at = bitmap.value.find(seeds)
            row = np.searchsorted(offs, at, side="right") - 1
            whole = at + n <= offs[row + 1]  # a seed ends with its document
            at, row = at[whole], row[whole]
            ids, starts, runs, grams = [], [], [], []
            if len(at):
                new = np.append(True, (at[1:] > at[:-1] + n) | (row[1:] != row[:-1]))
                begin = np.flatnonzero(new)
                stop = np.append(begin[1:], len(at)) - 1
                for b, e in zip(begin, stop, strict=True):
                    lo, hi = at[b], at[e] + n
                    ids.append(row[b])
                    starts.append(lo - offs[row[b]])
                    runs.append(words[lo:hi].view(np.int64))
                    grams.append(seeds[at[b : e + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ids, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(runs, pa.list_(pa.int64())),
                    pa.array(grams, pa.list_(pa.int64())),
                ],
                names=["id", "start", "words", "seeds"],
            )

    return run


def _rolling(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin prefix values and the base's powers (mod 2^64)."""
    power = np.cumprod(np.full(len(words) + 1, _BASE, dtype=np.uint64))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return total, power


def _windows(total: np.ndarray, power: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``s`` unmarked words and their hashes, shifted to a common power."""
    if len(free) < s:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    marked = np.append(0, np.cumsum(~free))
    starts = np.flatnonzero(marked[s:] == marked[:-s])
    size = len(power) - 1
    return starts, (total[starts + s] - total[starts]) * power[size - starts - 1]


def tile(item: np.ndarray, runs: list[np.ndarray], n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of ``item`` against ``runs``: (place in item, place in the joined runs, length)."""
    # runs are joined with a gap that is marked from the start, so no tile crosses it
    size = sum(len(r) + 1 for r in runs)
    text, free_t, at = np.zeros(size, np.uint64), np.zeros(size, dtype=bool), 0
    for r in runs:
        text[at : at + len(r)], free_t[at : at + len(r)] = r, True
        at += len(r) + 1
    free_p = np.ones(len(item), dtype=bool)
    longest = max(len(item), size)
    pad = lambda x: np.append(x, np.zeros(longest - len(x), np.uint64))  # noqa: E731  equal lengths, equal powers
    hash_p, power = _rolling(pad(item))
    hash_t, _ = _rolling(pad(text))
    hash_p, hash_t = hash_p[: len(item) + 1], hash_t[: size + 1]
    tiles: list[tuple[int, int, int]] = []
    s = max(n, len(item))
    while True:
        found: list[tuple[int, int, int]] = []
        starts_p, keys_p = _windows(hash_p, power, free_p, s)
        starts_t, keys_t = _windows(hash_t, power, free_t, s)
        at_key = defaultdict(list)
        for p, k in zip(starts_p.tolist(), keys_p.tolist(), strict=True):
            at_key[k].append(p)
        hits = np.flatnonzero(np.isin(keys_t, keys_p))
        for t, k in zip(starts_t[hits].tolist(), keys_t[hits].tolist(), strict=True):
            for p in at_key[k]:
                if p and t and free_p[p - 1] and free_t[t - 1] and item[p - 1] == text[t - 1]:
                    continue  # part of a match that begins further left
                length = 0
                while (
                    p + length < len(item)
                    and t + length < size
                    and free_p[p + length]
                    and free_t[t + length]
                    and item[p + length] == text[t + length]
                ):
                    length += 1
                if length >= s:
                    found.append((length, p, t))
        for length, p, t in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_p[p : p + length].all() and free_t[t : t + length].all():
                free_p[p : p + length] = free_t[t : t + length] = False
                tiles.append((p, t, length))
        if found:
            continue  # what a taken tile has cut may still hold runs of this length
        if s == n:
            return tiles
        s = max(n, s // 2)


def _tiling(n: int):
    def run(batches):
        for batch in batches:
            count, covered = [], []
            for item, runs in zip(batch.column("item_words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                tiles = tile(
                    np.array(item, np.int64).view(np.uint64), [np.array(r, np.int64).view(np.uint64) for r in runs], n
                )
                count.append(len(tiles))
                covered.append(sum(x[2] for x in tiles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(count, pa.int64()), pa.array(covered, pa.int64())],
                names=["id", "item_id", "item_size", "tiles", "covered"],
            )

    return run


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 5,
    coverage: float = 0.8,
    max_bits: int = MAX_BITS,
    pooled: bool = True,
) -> DataFrame:
    """One row per document and item whose tiles cover ``coverage`` of the item's words or more.

    Columns: the document's id, the item's id, ``item_size``, ``tiles``,
    ``covered`` (words) and ``coverage``.  Without ``pooled`` the id must tell
    texts apart: rows that share it are copies, whose stretches count once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    kind, item_kind = texts.schema["id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    items = materialise(
        asked.mapInArrow(_items(n), f"item_id {item_kind}, item_key long, words array<long>, seeds array<long>"), "items"
    )
    total = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    bitmap = spark.sparkContext.broadcast(
        build_bitmap(items.select(F.explode("seeds")), total, max_bits=max_bits)
    )
    found = materialise(
        texts.mapInArrow(
            _stretches(n, bitmap), f"id {kind}, start long, words array<long>, seeds array<long>"
        ),
        "stretches",
    )
    # items with the same words are tiled once
    distinct = items.groupBy("item_key").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds"))
    distinct = materialise(distinct, "distinct-items")
    asked_seeds = distinct.select("item_key", F.size("words").alias("item_size"), F.posexplode("seeds").alias("pos", "seed"))
    seeds = found.select("id", F.explode("seeds").alias("seed")).distinct()
    shared = seeds.join(asked_seeds, "seed").groupBy("id", "item_key", "item_size").agg(
        F.array_sort(F.collect_set("pos")).alias("places")
    )
    gaps = F.transform(
        F.sequence(F.lit(1), F.size("places")),
        lambda i: F.least(F.lit(n), F.coalesce(F.get("places", i), F.lit(1 << 30)) - F.element_at("places", i)).cast("long"),
    )
    most = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    pairs = shared.filter(most >= F.col("item_size") * coverage).select(
        F.col("id").alias("pair_id"), "item_key", "item_size"
    )
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select("pair_id").distinct()
    runs = found.join(wanted, F.col("id").eqNullSafe(F.col("pair_id")), "left_semi")
    if not pooled:
        runs = runs.dropDuplicates(["id", "start"])
    runs = runs.groupBy("id").agg(F.collect_list("words").alias("runs"))
    ready = (
        pairs.join(runs, F.col("id").eqNullSafe(F.col("pair_id")))
        .join(distinct.select("item_key", F.col("words").alias("item_words")), "item_key")
        .select("id", "item_key", "item_size", "item_words", "runs")
    )
    tiled = ready.mapInArrow(_tiling(n), f"id {kind}, item_id long, item_size int, tiles long, covered long")
    share = F.col("covered") / F.col("item_size")
    hits = tiled.withColumn("coverage", share).filter(F.col("coverage") >= coverage)
    return hits.withColumnRenamed("item_id", "item_key").join(items.select("item_id", "item_key"), "item_key").select(
        F.col("id").alias(id_col),
        F.col("item_id").alias(item_col),
        F.col("item_size").cast("long").alias("item_size"),
        "tiles",
        "covered",
        "coverage",
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False, **options
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    ``by_row``: rows are told apart by id and text, so that each text is judged
    alone; otherwise rows that repeat an id are one document.
    """
    if by_row:
        text = F.col(f"`{text_col}`")
        key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tag"))
        texts = docs.select(key.alias("key"), text.alias("text"))
        bad = contaminated_pairs(texts, benchmark, "key", "text", pooled=False, **options).select("key.id", "key.tag").distinct()
        bad = bad.select(F.col("id").alias("_bad_id"), F.col("tag").alias("_bad_tag"))
        same = F.col(f"`{id_col}`").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(text) == F.col("_bad_tag"))
        return docs.join(bad, same, "left_anti")
    bad = contaminated_pairs(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("_bad_id")).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col("_bad_id")), "left_anti")
