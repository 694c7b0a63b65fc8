import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.multi_index import multi_sequence, pack_cells, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k, is_query):
    good = {}
    dims = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            dims[len(v)] = dims.get(len(v), 0) + 1
            good.setdefault(i, []).append(np.array(np.float32(v), float))
    dim = max(dims, key=lambda d: (dims[d], d))
    good = {i: [v for v in vs if len(v) == dim] for i, vs in good.items()}
    out = {}
    for q, vs in good.items():
        if vs and is_query(q):
            scores = [(-max(float((vs[0] * x).sum()) for x in xs), i) for i, xs in good.items() if i != q and xs]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def check(spark, rows, k, least, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in search(df, F.col("id") % 5 == 0, k=k, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = exact(rows, k, lambda i: i % 5 == 0)
    assert set(got) == {q for q, near in want.items() if near}
    met = total = 0
    for q, near in want.items():
        assert sorted(got.get(q, {})) == list(range(1, len(near) + 1))
        ranked = [got[q][x + 1] for x in range(len(near))]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0]))
        met += len({i for i, _ in near} & {i for i, _ in ranked})
        total += len(near)
        if least == 1:
            assert [i for i, _ in ranked] == [i for i, _ in near]
            assert [s for _, s in ranked] == pytest.approx([s for _, s in near], abs=1e-12)
    assert met >= least * total


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    data = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    check(spark, [(i, [float(x) for x in v], 0) for i, v in enumerate(data)], 10, 0.9, cell_rows=30, block=128)


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], 0) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0], 0) for i in range(70)]  # more copies than k + 1
    rows += [(200, None, 0), (205, [0.0] * 4, 0), (210, [1.0, None, 0.0, 0.0], 0), (215, [math.nan, 1.0, 1.0, 1.0], 0)]
    rows += [(220, [math.inf, 1.0, 1.0, 1.0], 0), (225, [], 0), (230, [1.0, 1.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 0)]
    check(spark, rows, 6, 1, recall=1.0, cell_rows=20, block=8)


def test_few_candidates_and_empty_tables(spark):
    check(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.0, 1.0], 0)], 20, 1, recall=1.0)
    empty = spark.createDataFrame([], SCHEMA)
    assert search(empty, F.col("id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(5, [1.0], 0), (5, [1.0], 0)], SCHEMA)
    assert search(one, F.col("id") % 5 == 0).count() == 0  # a query is not its own neighbour


def test_extra_columns_may_clash(spark):
    df = spark.createDataFrame(
        [(i, [float(i + 1), 1.0], "x", 3) for i in range(6)], "vec_id long, embedding array<float>, v string, id int"
    )
    assert search(df, F.col("id") % 5 == 0, k=2).count() == 4


def test_walk_is_by_falling_sum_and_meets_every_cell():
    rng = np.random.default_rng(2)
    a, b, sizes = rng.normal(size=7), rng.normal(size=5), rng.integers(0, 4, 35)
    cells = multi_sequence(a, b, sizes, 10**9)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums, reverse=True) and sorted(cells) == list(np.flatnonzero(sizes))
    part = multi_sequence(a, b, sizes, 6)
    assert part == cells[: len(part)] and sizes[part].sum() >= 6 > sizes[part[:-1]].sum()


def test_cells_are_packed_into_bounded_blocks():
    sizes = np.array([3, 4, 9, 30, 1, 0, 10, 2])
    first, count = pack_cells(sizes, 10)
    load = {}
    for c, s in enumerate(sizes):
        for b in range(first[c], first[c] + count[c]):
            load[b] = load.get(b, 0) + s / count[c]
    assert max(load.values()) <= 10 and count[3] == 3


def test_repeated_ids_take_one_place_each(spark):
    rng = np.random.default_rng(4)
    some = lambda n, at: [(at + i, [float(x) for x in rng.integers(-3, 4, 3)], 0) for i in range(n)]
    near = [3.0, 3.0, 3.0]
    rows = [(5, near, 0)] * 30 + [(7, near, 0)] + some(60, 11)
    check(spark, rows, 5, 1, recall=1.0, cell_rows=10, block=8)
    # an id with many vectors, all better than anyone else's, and the same rows again
    rows += [(8, [3.0 + i, 3.0, 3.0], 0) for i in range(30)] * 2 + [(9, [4.0 - i / 8, 3.0, 3.0], 0) for i in range(25)]
    check(spark, rows, 5, 1, recall=1.0, cell_rows=10, block=8)
    check(spark, rows, 5, 0, recall=0.1, cell_rows=10, block=8)  # however short the walk, k ids are found
