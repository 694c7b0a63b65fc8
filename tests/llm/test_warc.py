import base64
import hashlib
import os

import pytest

from tessera.llm.warc import encode_record, read_warc, write_warc

PAGES = "page_id long, url string, html string"


def expected(rows, min_bytes):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        holder = max(ids, default=None)
        again = len(payload) >= min_bytes and len(groups[html or ""]) > 1 and holder is not None and i != holder
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "revisit" if again else "response", holder if again else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (9, None, "<p>é</p>"), (4, "http://c/\r\nx", "x\r\n\r\ny"), (5, "http://d/", None),
    (6, "http://e/", ""), (7, "http://f/", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (7, "http://f/2", "other"), (9, "http://g/", "<p>é</p>"),
    (None, "http://h/", "only nulls"), (None, "http://i/", "only nulls"), (None, "http://j/", "x\r\n\r\ny"), (2, "http://k/", "z" * 300_000),
]


@pytest.mark.parametrize("min_bytes", [0, 7])
def test_round_trip(spark, tmp_path, min_bytes):
    folder = f"file://{tmp_path}/a"
    write_warc(spark.createDataFrame(ROWS, PAGES), folder, min_bytes=min_bytes, shard_bytes=60_000, roll_bytes=200)
    got = read_warc(spark, folder, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS, min_bytes)
    for r in got:
        want = [h or "" for i, _, h in ROWS if i == r.page_id]
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload).decode() in want
    assert {r.url for r in got} == {None if u is None else u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in ROWS}


def files(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder) if n.endswith(".warc.gz")}


def test_same_rows_give_the_same_files(spark, tmp_path):
    rows = [(i, f"http://h{i}/", f"text {i % 40} " * 50) for i in range(400)]
    df = spark.createDataFrame(rows, PAGES)
    manifest = write_warc(df, f"file://{tmp_path}/a", shard_bytes=20_000, roll_bytes=2_000)
    write_warc(df.repartition(11), f"file://{tmp_path}/b", shard_bytes=20_000, roll_bytes=2_000)
    a, b = files(f"{tmp_path}/a"), files(f"{tmp_path}/b")
    assert a == b and len(a) > 5
    listed = {r["name"]: r for r in manifest.collect()}
    assert set(listed) == set(a) and sum(r.records for r in listed.values()) == 400
    assert all(r.bytes == len(a[n]) for n, r in listed.items())
    assert len({r.shard for r in listed.values()}) > 1 and max(r.part for r in listed.values()) > 0
    # shards are ranges of page ids, in order
    seen = [(r.file, r.page_id) for r in read_warc(spark, f"file://{tmp_path}/a").collect()]
    by_file = {}
    for f, i in seen:
        by_file.setdefault(f, []).append(i)
    spans = [(min(v), max(v)) for _, v in sorted(by_file.items())]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert not os.path.exists(f"{tmp_path}/a/_temporary")


def test_only_committed_files_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    df = spark.createDataFrame([(1, "http://a/", "x")], PAGES)
    write_warc(df, folder)
    open(f"{tmp_path}/a/pages-999999-00000.warc.gz", "wb").write(encode_record(5, "http://z/", b"z", "k", 0, None))
    assert [r.page_id for r in read_warc(spark, folder).collect()] == [1]
    with pytest.raises(FileExistsError):
        write_warc(df, folder)


def test_damage_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    write_warc(spark.createDataFrame([(1, "http://a/", "x")], PAGES), folder)
    name = next(n for n in os.listdir(f"{tmp_path}/a") if n.endswith(".gz"))
    bad = encode_record(1, "http://a/", b"x", "k", 0, None)
    import gzip

    open(f"{tmp_path}/a/{name}", "wb").write(gzip.compress(gzip.decompress(bad).replace(b"\r\n\r\nx\r\n", b"\r\n\r\ny\r\n")))
    with pytest.raises(Exception, match="does not match its digest"):
        read_warc(spark, folder).collect()


def test_empty_table_and_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x", 3, "k")], PAGES + ", shard int, key string")
    write_warc(df, f"file://{tmp_path}/x")
    assert read_warc(spark, f"file://{tmp_path}/x").first().record_type == "response"
    write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0
