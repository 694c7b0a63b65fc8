import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.token_store import BLOCK_IDS, COUNTS, WIDTHS, TokenFile, TokenFileWriter, pack, read_tokens, text_encoder, unpack, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


class Source:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, size, offset):
        return self.data[offset : offset + size]


class Sink(io.BytesIO):
    def close(self):
        self.data = self.getvalue()
        super().close()


def plain_pack(ids, block):
    """Greedy packing, one word after the other."""
    words, escapes, counts = [], [], []
    for at in range(0, len(ids), block):
        part, i, n, out = list(ids[at : at + block]), 0, 0, 0
        while i < len(part):
            for s in range(1, 15):
                take = part[i : i + int(COUNTS[s])]
                if all(v < 1 << int(WIDTHS[s]) for v in take):
                    words.append((s << 60) | sum(v << (k * int(WIDTHS[s])) for k, v in enumerate(take)))
                    i += int(COUNTS[s])
                    break
            else:
                words.append(out)
                escapes.append(part[i])
                out, i = out + 1, i + 1
            n += 1
        counts.append(n)
    return words, counts, escapes


IDS = st.lists(
    st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 50_000), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1)),
    max_size=300,
)


@settings(max_examples=150, deadline=None)
@given(IDS, st.sampled_from([7, 64, 100]))
def test_words_equal_greedy_packing_and_come_back(ids, block):
    array = np.array(ids, np.uint64)
    words, n_words, escapes, n_escapes = pack(array, block)
    assert (words.tolist(), n_words.tolist(), escapes.tolist()) == plain_pack(ids, block)
    assert unpack(words, n_words, escapes, n_escapes, len(ids), block).tolist() == ids


def test_files_random_access_and_long_documents():
    rng = np.random.default_rng(0)
    docs = [(i if i % 7 else None, rng.integers(0, 2 ** int(rng.integers(1, 33)), int(rng.integers(0, 900))).astype(np.uint64)) for i in range(300)]
    docs.insert(5, (77, rng.integers(0, 49_000, 2_500_000).astype(np.uint64)))
    docs.append((-3, np.array([2**63, 2**64 - 1, 0, 2**60], np.uint64)))
    sink = Sink()
    writer = TokenFileWriter(sink)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    file = TokenFile(Source(sink.data))
    got = list(file.documents())
    assert [i for i, _ in got] == [i for i, _ in docs] and all(np.array_equal(a, b) for (_, a), (_, b) in zip(got, docs))
    stream = np.concatenate([ids for _, ids in docs])
    assert len(sink.data) < 5 * len(stream) and file.n_blocks == -(-len(stream) // BLOCK_IDS)
    for a, b in [(0, 1), (1000, 5000), (len(stream) - 3, len(stream)), (2048, 2048), (1024, 3072)]:
        assert np.array_equal(file.ids(a, b), stream[a:b])
    with pytest.raises(ValueError, match="cut short"):
        TokenFile(Source(sink.data[:-5]))
    bad = bytearray(sink.data)
    bad[15] |= 0xF0
    with pytest.raises(ValueError, match="unknown selector|as many ids"):
        TokenFile(Source(bytes(bad))).ids(0, 10)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  'stσΣ́É<|>"))))
def test_pieces_one_by_one_give_the_ids_of_the_text(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    for encode in ENCODERS:
        assert encode(text.encode()).tolist() == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pieces_give_the_ids_of_the_test_documents():
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist():
        want = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        assert ENCODERS[1]((text or "").encode()).tolist() == want


TOKENIZER = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as _f:
    _V = _f.read()
ENCODERS = [text_encoder(_V, "words", 50), text_encoder(_V, "letters", 80), text_encoder(_V)]


def expected(rows):
    ids = lambda text: TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        t = ids(text)
        out.append((i, start, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
        start += len(t)
    return out


def digest(spark, folder):
    rows = read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


@pytest.mark.parametrize("pieces", ["texts", "words", "letters"])
def test_round_trip(spark, tmp_path, pieces):
    rows = [(i * 3 % 101 - 20, f"Word{i} it's <|endoftext|> ÉÜ {'ab ' * (i % 9)}\x0b\x0c{i}") for i in range(101)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "x" * 5000), (904, "véry long " * 40_000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    manifest = write_tokens(df, f"file://{tmp_path}/a", PATH, roll_ids=500, pieces=pieces)
    assert digest(spark, f"file://{tmp_path}/a") == expected(rows)
    listed = manifest.orderBy("start").collect()
    assert len(listed) > 3 and [r.name for r in listed] == sorted(r.name for r in listed)
    assert all(os.path.getsize(f"{tmp_path}/a/{r.name}") == r.bytes for r in listed) and not os.path.exists(f"{tmp_path}/a/_temporary")
    with pytest.raises(FileExistsError):
        write_tokens(df, f"file://{tmp_path}/a", PATH)


def test_repeated_ids_spread_over_tasks_and_keep_the_order(spark, tmp_path):
    rows = [(5, "same text")] * 400 + [(5, f"other {i}") for i in range(50)] + [(i, "few") for i in range(10)] + [(None, "same text")] * 50
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    manifest = write_tokens(df, f"file://{tmp_path}/a", PATH, num_shards=8)
    got = digest(spark, f"file://{tmp_path}/a")
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert manifest.filter("docs > 150").count() == 0


def test_empty_table_and_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([("7", "x", 1, "p")], "doc_id string, text string, place int, key string")
    write_tokens(df, f"file://{tmp_path}/x", PATH, end_id=40_000)
    got = read_tokens(spark, f"file://{tmp_path}/x").first()
    assert (got.doc_id, got.start, got.n_tokens) == (7, 0, 2) and np.frombuffer(got.ids, "<u4")[1] == 40_000
    write_tokens(df.limit(0), f"file://{tmp_path}/e", PATH)
    assert read_tokens(spark, f"file://{tmp_path}/e").count() == 0
