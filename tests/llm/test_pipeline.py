import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage leaves."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages_in_order_and_their_columns(spark, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(d.columns == columns for d in kept[:-1])
    counts = [d.count() for d in kept[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[0] == counts[1] > counts[2] >= counts[3] > 0


def test_each_stage_against_brute_force(spark, kept):
    from tests.llm.test_line_dedup import brute as brute_lines
    from tests.llm.test_near_dedup import brute as brute_groups

    first = [(r.doc_id, r.text) for r in kept[0].collect()]
    lines = {i: text for i, text, *_ in brute_lines(first, 10)}
    second = {r.doc_id: r for r in kept[1].collect()}
    assert {i: r.text for i, r in second.items()} == lines
    assert all(r.n_chars == len(r.text) for r in second.values())
    groups = brute_groups([(i, r.text) for i, r in second.items()], 5, 8, 10)
    third = {r.doc_id for r in kept[2].collect()}
    assert third == {i for i, _, component in groups if i == component}
    fourth = {r.doc_id for r in kept[3].collect()}
    import re

    words = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i in third - fourth:
        own = set()
        text = words(second[i].text)
        own = {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
        best = 0.0
        for item in items:
            cover = {x for k in range(len(item) - 4) if tuple(item[k : k + 5]) in own for x in range(k, k + 5)}
            best = max(best, len(cover) / len(item))
        assert best >= 0.8
    for i in fourth:
        text = " ".join(words(second[i].text))
        assert not any(" ".join(item) in text for item in items if len(item) >= 5)
    stream = kept[4].collect()
    assert {r.doc_id for r in stream} <= fourth
    words_of = kept[3].select(F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))).first()[0]
    taken = sum(len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w]) for r in stream)
    assert abs(taken - 1.5 * words_of) < 0.1 * words_of
    assert [r.position for r in stream] == sorted(r.position for r in stream)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(Q.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = Q.QUERIES[name](spark, SF).select(*columns).collect()
    shape = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, map(shape, want.fetchall()))) == sorted(map(str, map(shape, rows)))


def test_the_entry_lists_one_query_of_each_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
