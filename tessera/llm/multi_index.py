"""Approximate nearest neighbours by an inverted multi-index (largest inner product).

1. Two codebooks, one for each half of the vectors, are fitted by k-means on a
   bounded sample.  A vector's cell is the pair of its halves' nearest
   centroids; every row is indexed.
2. A query walks the pairs of centroids in order of the summed inner products
   of its halves with them, by a heap over the two sorted lists, until the cells
   it has met hold a share of all vectors.  The share is measured on the sample:
   the one at which ``recall`` of the exact neighbours have been met.
3. Cells are packed into blocks of about ``block`` vectors (a larger cell is cut
   into several), which are what tasks work on.  The entries of a query's cells
   are reranked by the exact inner product, in double precision, and the ``k``
   best stay; ties go to the smaller id.

Queries meet blocks in groups of ``block`` by ``block`` at most, so a crowded
cell is spread over many tasks and memory stays bounded.  Rows that repeat both
id and vector count once.  Of equal vectors only the ``k + 1`` smallest ids can be
among anyone's ``k`` nearest, and only they are indexed; the others are never
returned by the exact search either.  Places are for ids, not rows: a block gives
its best ``k`` ids, and a walk meets more vectors than any ``k`` ids have, so that
one id's many vectors never push others out.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do vectors of another length than the most common
one (the longer, if two are equally common).  A query's own id is never its
neighbour; of rows that repeat an id each distinct vector is a candidate, the
best of them is returned, and the query takes the one with the smallest hash.
Null ids take no part.  With fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialise


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; empty clusters take the worst placed points."""
    k = min(k, len(x))
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        away = (centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T
        own = away.argmin(axis=1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            centroids[empty] = x[np.argsort(-away[np.arange(len(x)), own], kind="stable")[: len(empty)]]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T).argmin(axis=1)


def multi_sequence(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(second) + j) by falling ``first[i] + second[j]`` until they hold ``enough`` vectors."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    seen, out, held = {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(first[a[p]] + second[b[q]]), p, q))
    return out


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the vectors that take part, as arrays of double."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
    )
    return rows.filter(_finite("v") & F.exists("v", lambda x: x != 0.0))


def _finite(name: str) -> Column:
    return F.coalesce(
        F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def share_to_meet(
    sample: np.ndarray, half: int, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, queries: int = 256
) -> float:
    """The share of vectors a walk must meet to have met ``recall`` of the exact ``k`` nearest, on a sample."""
    asked = sample[: min(queries, len(sample))]
    cell = nearest(sample[:, :half], books[0]) * len(books[1]) + nearest(sample[:, half:], books[1])
    sizes = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
    first, second = asked[:, :half] @ books[0].T, asked[:, half:] @ books[1].T
    needed = []
    for i in range(len(asked)):
        walk = multi_sequence(first[i], second[i], sizes, len(sample))
        met = np.zeros(len(sizes), np.int64)
        met[walk] = np.cumsum(sizes[walk])
        needed.append(met[cell[near[i]]])
    return min(1.0, float(np.quantile(np.concatenate(needed), recall)) / len(sample))


def pack_cells(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of every cell: small cells share a block, a large one has several."""
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, room = 0, block
    for c, size in enumerate(sizes):
        if size > room and room < block:
            at, room = at + 1, block
        first[c] = at
        if size > block:
            count[c] = -(-size // block)
            at, room = at + int(count[c]), block
        else:
            room -= int(size)
    return first, count


def search(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    recall: float = 0.97,
    cell_rows: int = 100,
    max_codes: int = 256,
    sample: int = 20_000,
    block: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for every row with ``is_query`` (a condition on ``id``)."""
    spark = rows.sparkSession
    vectors = valid_vectors(rows, id_col, vector_col)
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths.d
    vectors = vectors.filter(F.size("v") == dim).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(2), "v")})
    vectors = vectors.groupBy("id", "h1", "h2").agg(F.first("v").alias("v"))
    copies = Window.partitionBy("h1", "h2").orderBy("id")
    distinct = vectors.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("id", "v")
    distinct = materialise(distinct, "vectors")
    n = distinct.count()
    half = max(1, dim // 2)
    drawn = distinct.orderBy(F.xxhash64(F.lit(23), "id"), "id", F.xxhash64("v")).limit(sample).toArrow()
    drawn = _matrix(drawn.column("v"), dim)
    codes = max(1, min(max_codes, round(math.sqrt(n / cell_rows))))
    pair = (kmeans(drawn[:, :half], codes, seed=1), kmeans(drawn[:, half:], codes, seed=2))
    most = [r["count"] for r in distinct.groupBy("id").count().orderBy(F.desc("count")).limit(k).collect()]
    enough = max(math.ceil(share_to_meet(drawn, half, pair, k, recall) * n), min(n, sum(most) + 1))
    books = spark.sparkContext.broadcast(pair)
    width = len(pair[1])

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            cell = nearest(x[:, :half], books.value[0]) * width + nearest(x[:, half:], books.value[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["id", "v", "cell"])

    index = materialise(distinct.mapInArrow(assign, "id long, v array<double>, cell long"), "index")
    sizes = np.zeros(len(pair[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most max_codes ** 2 cells
        sizes[r["cell"]] = r["count"]
    held = spark.sparkContext.broadcast((sizes, *pack_cells(sizes, block)))

    def walk(batches):
        sizes, first_block, n_blocks = held.value
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            first, second = x[:, :half] @ books.value[0].T, x[:, half:] @ books.value[1].T
            blocks = []
            for i in range(len(x)):
                cells = np.array(multi_sequence(first[i], second[i], sizes, enough), np.int64)
                counts = n_blocks[cells]
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at, own = np.repeat(first_block[cells], counts) + inner, np.repeat(cells, counts)
                order = np.lexsort((own, at))
                at, own = at[order], own[order]
                cut = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
                blocks.append([np.append(b, part) for b, part in zip(at[cut], np.split(own, cut[1:]), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(blocks, pa.list_(pa.list_(pa.int64())))], names=["qid", "q", "blocks"]
            )

    def place(batches):
        _, first_block, n_blocks = held.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            spread = batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            at = first_block[cell] + (spread % n_blocks[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=["id", "v", "cell", "block"])

    queries = (
        vectors.filter(is_query)
        .groupBy(F.col("id").alias("qid"))
        .agg(F.min(F.struct("h1", "h2", "v")).alias("s"))
        .select("qid", F.col("s.v").alias("q"))
        .mapInArrow(walk, "qid long, q array<double>, blocks array<array<long>>")
    )
    queries = materialise(queries, "queries")
    # a visit is a block and the query's cells in it
    visits = queries.select("qid", "q", F.explode("blocks").alias("visit")).select(
        "qid", "q", F.get("visit", F.lit(0)).alias("block"), F.slice("visit", F.lit(2), F.size("visit")).alias("cells")
    )
    # where many queries meet a block they are cut into groups
    groups = materialise(
        visits.groupBy("block").agg(F.ceil(F.count("*") / block).cast("int").alias("groups")), "blocks"
    )
    right = (
        index.mapInArrow(place, "id long, v array<double>, cell long, block long")
        .join(groups, "block")
        .select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "id", "v", "cell")
    )
    left = visits.join(groups, "block").select(
        "block", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int").alias("group"), "qid", "q", "cells"
    )

    def rerank(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))})
        q, x = _matrix(asked.column("q"), dim), _matrix(stored.column("v"), dim)
        qid, ids = asked.column("qid").to_numpy(), stored.column("id").to_numpy()
        cells, own = np.unique(stored.column("cell").to_numpy(), return_inverse=True)
        met = asked.column("cells").to_pylist()
        names, name = np.unique(ids, return_inverse=True)
        rough = q @ x.T
        out_q, out_id, out_s = [], [], []
        for i in range(len(q)):
            here = np.zeros(len(cells) + 1, dtype=bool)
            place_of = np.searchsorted(cells, met[i])
            here[place_of[cells[np.minimum(place_of, len(cells) - 1)] == met[i]]] = True
            out_of_reach = (ids == qid[i]) | ~here[own]
            line = np.where(out_of_reach, -np.inf, rough[i])
            if len(names) == len(ids):
                of_id = line
            else:
                of_id = np.full(len(names), -np.inf)
                np.maximum.at(of_id, name, line)
            if len(of_id) > k:
                bar = np.partition(of_id, len(of_id) - k)[len(of_id) - k]
                at = np.flatnonzero(line >= bar - 1e-9 * max(1.0, abs(bar)))
            else:
                at = np.arange(len(line))
            at = at[~out_of_reach[at]]
            exact = (q[i] * x[at]).sum(axis=1)  # one order of addition for equal vectors wherever they are
            at_order = np.lexsort((ids[at], -exact))
            if len(names) < len(ids):  # the best row of each id
                at_order = at_order[np.sort(np.unique(ids[at][at_order], return_index=True)[1])]
            at_order = at_order[:k]
            out_q.append(np.full(len(at_order), qid[i]))
            out_id.append(ids[at][at_order])
            out_s.append(exact[at_order])
        return pa.table({"qid": np.concatenate(out_q), "id": np.concatenate(out_id), "score": np.concatenate(out_s)})

    keys = ["block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "qid long, id long, score double")
    best = found.groupBy("qid", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
    )
