import random

import numpy as np
import pytest

from tessera.llm.bitmap import build_bitmap
from tessera.llm.decontaminate import contaminated_pairs, decontaminate, tile


def naive_tiles(item, text, n):
    """Greedy string tiling by trying every pair of starts."""
    free_p, free_t, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and free_p[p + k] and free_t[t + k] and item[p + k] == text[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < n:
            return total
        for x in range(k):
            free_p[p + x] = free_t[t + x] = False
        total += k


def test_tiling_matches_the_naive_one():
    rnd = random.Random(3)
    for _ in range(60):
        letters = rnd.choice([2, 6, 30])
        item = [rnd.randrange(letters) + 1 for _ in range(rnd.randint(5, 30))]
        text = [rnd.randrange(letters) + 1 for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.5:
            cut = rnd.randrange(len(item))
            text = text[:10] + item[cut:] + text[10:] + item[:cut]
        tiles = tile(np.array(item, np.uint64), [np.array(text, np.uint64)], 3)
        covered = sum(k for _, _, k in tiles)
        assert all(k >= 3 and item[p : p + k] == text[t : t + k] for p, t, k in tiles)
        assert len({x for p, _, k in tiles for x in range(p, p + k)}) == covered
        if letters > 2:  # with two letters ties of equal length may be taken in another order
            assert covered == naive_tiles(item, text, 3)


@pytest.fixture
def bench(spark):
    item = " ".join(f"q{i}" for i in range(40))
    rows = [(1, item), (2, "short one"), (3, None), (4, " ".join(f"r{i}" for i in range(12))), (4, " ".join(f"s{i}" for i in range(9)))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_copies_reordered_passages_and_clean_documents(docs, bench):
    q = [f"q{i}" for i in range(40)]
    junk = " ".join(f"j{i}" for i in range(3000))
    reordered = " ".join(q[20:]) + " and then " + " ".join(q[:20])
    rows = [
        (1, junk + " Q0, " + " ".join(q[1:]) + " " + junk),  # case and punctuation do not matter
        (2, reordered),
        (3, " ".join(q[:30])),  # three quarters: below the threshold
        (4, " ".join(q[i] for i in range(0, 40, 2))),
        (5, "short one"),
        (6, None),
        (7, ""),
        (8, " ".join(q[:16]) + " x " + " ".join(q[16:32])),  # exactly four fifths
        (9, " ".join(q[:20])),
        (9, " ".join(q[20:])),  # one document in two rows
        (None, " ".join(f"r{i}" for i in range(12))),
        (11, junk),
    ]
    got = contaminated_pairs(docs(*rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.covered) for r in got} == {
        (1, 1, 40), (2, 1, 40), (8, 1, 32), (9, 1, 40), (None, 4, 12)
    }
    assert {r.tiles for r in got if r.doc_id == 2} == {2}
    left = decontaminate(docs(*rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7, 11]
    assert left.columns == docs().columns


def test_the_pipeline_stage_judges_each_text_of_an_id_alone(spark, bench, docs, tmp_path):
    import corpus_pipeline

    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    q = [f"q{i}" for i in range(40)]
    dirty, junk = " ".join(q), " ".join(f"j{i}" for i in range(50))
    rows = [
        (None, dirty), (None, junk), (None, None), (7, junk + " x"), (7, junk + " " + dirty), (7, junk + " " + dirty),
        (9, " ".join(q[:20])), (9, " ".join(q[20:])),  # parts of an item, none of which reaches the threshold
    ]
    left = corpus_pipeline.decontamination(spark, docs(*rows), str(tmp_path))
    gone = {(None, dirty), (7, junk + " " + dirty)}
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(str(r) for r in rows if r not in gone)
    assert left.columns == docs().columns


def test_copies_of_a_text_do_not_add_up(spark, docs):
    once = " ".join(f"p{i}" for i in range(10))
    twice = spark.createDataFrame([(1, once + " " + once)], "item_id long, text string")
    rows = [(None, once), (None, once)]  # each covers one half of the item
    assert decontaminate(docs(*rows), twice, by_row=True).count() == 2


def test_empty_tables_and_extra_columns(spark, docs, bench):
    assert contaminated_pairs(docs(), bench).count() == 0
    assert contaminated_pairs(docs((1, "a b c d e f")), bench.filter("item_id > 99")).count() == 0
    odd = spark.createDataFrame([(1, "s0 s1 s2 s3 s4 s5 s6 s7 s8", 5)], "doc_id long, text string, item_id int")
    assert [(r.doc_id, r.item_id) for r in contaminated_pairs(odd, bench).collect()] == [(1, 4)]


def test_bitmap_never_misses(spark):
    values = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    bitmap = build_bitmap(df, 5000)
    assert len(bitmap.find(values.view(np.uint64))) == 5000
    other = np.random.default_rng(6).integers(0, 2**63, 50_000).astype(np.uint64)
    assert len(bitmap.find(other)) < 500
