import re

import pytest

from tessera.llm.curriculum import mix_curriculum, plan_curriculum, stream_places

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, share, most):
    """Water filling step by step."""
    left, out = dict(sizes), {}
    demand = share * sum(sizes.values())
    while True:
        total = sum(weights[s] for s in left)
        level = {s: demand * weights[s] / total for s in left} if left else {}
        over = [s for s in left if level[s] > most * sizes[s]]
        if not over:
            return out | level
        for s in over:
            out[s] = most * sizes[s]
            demand -= out[s]
            del left[s]


def rows_of(n=240):
    names = [None, "a", "b", "Z", "é"]
    return [(i, "w " * (1 + i * 7 % 23) + ("\tx" if i % 3 else ""), names[0 if i % 3 == 0 else i % 5]) for i in range(n)]


@pytest.mark.parametrize("slice_rows", [7, 100_000])
def test_targets_and_words_taken(docs, slice_rows):
    rows = rows_of() + [(900, None, "b"), (901, "", "a"), (902, "one two", "b"), (902, "one two", "b")]
    got = plan_curriculum(docs(*rows), slice_rows=slice_rows).collect()
    assert len(got) == len(rows)
    sizes, taken, longest = {}, {}, {}
    for i, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        longest[source] = max(longest.get(source, 0), n)
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    wanted = targets(sizes, weights, 1.5, 2)
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and len(r.positions) * r.size == r.taken
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= longest[s] / 2 + 1


def test_reruns_and_partitioning_agree(docs):
    df = docs(*rows_of(120))
    a = sorted((r.doc_id, r.taken, tuple(r.positions)) for r in plan_curriculum(df).collect())
    b = sorted((r.doc_id, r.taken, tuple(r.positions)) for r in plan_curriculum(df.repartition(13), slice_rows=11).collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b, strict=True):
        assert x[2] == pytest.approx(y[2])


def test_positions_follow_the_schedules(docs):
    """At each time the words placed before it are the integral of the source's schedule."""
    rows = [(i, "w w w w", s) for i, s in enumerate("abc" * 400)]
    got = plan_curriculum(docs(*rows), share=0.9)
    curve = {"a": lambda t: 0.5 * t + 0.5 * t * t, "b": lambda t: 1.5 * t - 0.5 * t * t,
             "c": lambda t: 0.5 * t + t * t if t < 0.5 else 0.5 + 1.5 * (t - 0.5) - (t - 0.5) ** 2}
    placed = {}
    for r in got.collect():
        for p in r.positions:
            placed.setdefault(r.source, []).append(p)
    for s, times in placed.items():
        for t in (0.1, 0.3, 0.5, 0.8, 1.0):
            assert sum(p <= t for p in times) / len(times) == pytest.approx(curve[s](t), abs=0.02)


def test_stream_is_sorted_and_named_schedules_count(docs):
    rows = [(i, "w w", "x" if i % 2 else "y") for i in range(100)]
    schedules = {"x": [(0, 0), (0.5, 0), (1, 4)], "y": [(0, 1), (1, 1)]}
    out = mix_curriculum(docs(*rows), schedules=schedules, share=1.0).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert min(r.position for r in out if r.source == "x") >= 0.5
    assert {r.copy for r in out} <= {0, 1}


def test_empty_table_clashing_columns_and_plan(spark, docs):
    assert plan_curriculum(docs()).count() == 0 and mix_curriculum(docs()).count() == 0
    assert plan_curriculum(docs((1, None), (2, ""))).agg({"taken": "sum"}).first()[0] == 0
    odd = spark.createDataFrame([(1, "a b", "s", 9, "k")], "doc_id long, text string, source string, target int, note string")
    row = plan_curriculum(odd).first()
    assert (row.size, row.target, row.note) == (2, 3.0, "k")
    plan = plan_curriculum(docs((1, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_places_are_those_of_the_sorted_stream(docs):
    rows = rows_of(150) + [(900, None, "b"), (902, "one two", "b"), (902, "one two", "b"), (None, "no id here", "a")]
    stream = [(r.doc_id, r.copy) for r in mix_curriculum(docs(*rows)).collect()]
    planned = plan_curriculum(docs(*rows), keep_text=False)
    assert "text" not in planned.columns
    got = stream_places(planned).collect()
    assert len(got) == len(rows) and all(len(r.places) == len(r.positions) for r in got)
    placed = {p: (r.doc_id, k) for r in got for k, p in enumerate(r.places)}
    assert [placed[k] for k in range(len(stream))] == stream
    by_place = [x for _, x in sorted((p, x) for r in got for p, x in zip(r.places, r.positions))]
    assert by_place == sorted(by_place)
    assert stream_places(plan_curriculum(docs(), keep_text=False)).count() == 0
