"""A deterministic sharded WARC writer, and its reader.

1. Payload lengths and SHA-256 keys are written once.  Among records with equal
   payloads of at least ``min_bytes`` the one with the largest page id is the
   response; the others become revisits that refer to it.
2. Records are sorted into ranges of page ids.  The bounds are quantiles of the
   ids with the smallest hash, and the number of shards follows from the total
   payload size, so the same rows always give the same shards, whatever the
   partitioning or the attempt.
3. Each shard is written in order of page id as gzip members, one a record, and
   rolls over to the next file once ``roll_bytes`` compressed bytes are reached.
   Headers, lengths and digests are generated anew.
4. Files are written under names of their attempt's own.  The manifest holds
   the files of successful attempts only; a second job renames them (an attempt
   that finds the rename done goes on) and the committed manifest, written
   last, makes the archive valid.  Readers open what it lists and nothing else.

Payloads travel once; a record is held in memory one at a time.  Files go
through ``pyarrow.fs`` (``file:``, ``hdfs:``, ``s3:`` ...), so the folder must
be one that every executor reaches.

Defined cases: a null payload is empty, a null url is left out.  Null page ids
come first and are smaller than any id; a group of null ids alone has responses
only.  Rows that repeat a page id are records of their own: with equal payloads
all that bear the largest id are responses.  Extra columns are not written.  An
empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "temp string, name string, shard long, part long, records long, bytes long"
RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "file string, payload binary"
)


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, key: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{key}/{number}')}>"


def encode_record(page_id, url, payload: bytes, key: str, number: int, holder, date: str = DATE) -> bytes:
    """One record as a gzip member; ``holder`` is the page id that a revisit refers to, or None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if holder is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if holder is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, key, number)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if holder is not None:
        lines += [
            f"WARC-Refers-To: {record_id(holder, key, 0)}",
            f"WARC-Refers-To-Page-ID: {holder}",
            f"WARC-Profile: {PROFILE}",
        ]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Shards:
    """Writes one task's records, rolling files by shard and compressed size."""

    def __init__(self, folder: str, roll_bytes: int):
        self.store, self.root = _filesystem(folder)
        self.roll_bytes = roll_bytes
        self.out = None
        self.done: list[tuple] = []
        self.shard, self.part = -1, 0

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.size >= self.roll_bytes:
            self.close()
            self.part += 1
        if self.out is None:
            self.temp = f"_temporary/{uuid.uuid4().hex}"
            self.store.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.store.open_output_stream(f"{self.root}/{self.temp}")
            self.size = self.records = 0
        self.out.write(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.done.append((self.temp, name, self.shard, self.part, self.records, self.size))
            self.out = None


def _write(folder: str, roll_bytes: int, date: str):
    def manifest(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["temp", "name", "shard", "part", "records", "bytes"],
        )

    def run(batches):
        shards = _Shards(folder, roll_bytes)
        decided, last, number = (None, None, None), (None, None), 0
        for batch in batches:
            for shard, page_id, key, kind, holder, url, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0:  # a decision, sorted in front of the records it is about
                    decided = (page_id, key, holder)
                    continue
                number = number + 1 if (page_id, key) == last else 0
                last = (page_id, key)
                refers = decided[2] if decided[:2] == last else None
                payload = (html or "").encode("utf-8", "surrogatepass")
                shards.add(shard, encode_record(page_id, url, payload, key, number, refers, date))
        shards.close()
        yield manifest(shards.done)

    return run


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    shard_bytes: int = 1 << 28,
    roll_bytes: int = 1 << 26,
    sample: int = 200_000,
    date: str = DATE,
) -> DataFrame:
    """Write ``pages`` as a WARC archive in ``folder`` (which must not hold one) and return its manifest."""
    spark = pages.sparkSession
    store, root = _filesystem(folder)
    if store.get_file_info(f"{root}/manifest").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an archive already")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("html"),
    ).withColumn("key", F.sha2("html", 256))
    keys = materialise(
        rows.select("page_id", "key", F.octet_length("html").cast("long").alias("bytes"), F.xxhash64("key").alias("h")),
        "warc-keys",
    )
    groups = (
        keys.filter(F.col("bytes") >= min_bytes)
        .groupBy("key")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        .filter("n > 1 and holder is not null")
        .select(F.xxhash64("key").alias("h"), "key", "holder")  # an exchange of its own: hot keys can be split
    )
    decisions = (
        keys.select("page_id", "key", "h")
        .join(groups, ["h", "key"])
        .filter("page_id is null or page_id <> holder")
        .select("page_id", "key", "holder")
        .distinct()
    )
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    n_shards = max(1, math.ceil(total / shard_bytes))
    drawn = (
        keys.select("page_id")
        .filter("page_id is not null")
        .orderBy(F.xxhash64(F.lit(17), "page_id"), "page_id")
        .limit(min(sample, 50 * n_shards))
    )
    ids = np.sort(np.array([r.page_id for r in drawn.collect()], np.int64)) if n_shards > 1 else np.empty(0, np.int64)
    bounds = np.unique(ids[[len(ids) * k // n_shards for k in range(1, n_shards)]]) if len(ids) else ids
    least = -(1 << 63)

    @F.pandas_udf("long")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, page_id.to_numpy(np.int64), side="right"))

    both = rows.select("page_id", "key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("holder"), "url", "html").union(
        decisions.select(
            "page_id", "key", F.lit(0), "holder", F.lit(None).cast("string"), F.lit(None).cast("string")
        )
    )
    order = ["shard", "page_id", "key", "kind", "url"]
    ready = (
        both.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(least))))
        .select("shard", "page_id", "key", "kind", "holder", "url", "html")
        .repartitionById(min(n_shards, 20_000), F.col("shard").cast("int"))  # no two shards meet by chance of a hash
        .sortWithinPartitions(*order)
    )
    written = ready.mapInArrow(_write(folder, roll_bytes, date), MANIFEST)
    written.write.parquet(f"{folder}/_written")
    files = spark.read.schema(written.schema).parquet(f"{folder}/_written")

    def commit(batches):
        store, root = _filesystem(folder)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{temp}").type != fs.FileType.NotFound:
                    store.move(f"{root}/{temp}", f"{root}/{name}")
                elif store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield batch

    files.mapInArrow(commit, MANIFEST).drop("temp").write.parquet(f"{folder}/manifest")
    if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")  # what failed attempts have left
    return spark.read.parquet(f"{folder}/manifest")


def decode_records(stream):
    """(headers, block) of every record of a gzip stream, one at a time."""
    with gzip.GzipFile(fileobj=stream) as text:
        while True:
            line = text.readline()
            if not line:
                return
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := text.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b": ")
                headers[name.decode().lower()] = value.decode("utf-8", "surrogatepass")
            block = text.read(int(headers["content-length"]))
            if text.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield headers, block


def _parse(headers: dict, block: bytes, name: str, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if digest32(block) != headers["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"{name}: a block does not match its digest")
    if kind == "response" and digest32(payload) != digest:
        raise ValueError(f"{name}: a payload does not match its digest")
    number = lambda h: int(headers[h]) if h in headers else None
    return (
        number("warc-page-id"),
        headers.get("warc-target-uri"),
        kind,
        int(fields[b"Content-Length"]),
        digest,
        number("warc-refers-to-page-id"),
        name,
        payload if with_payload and kind == "response" else None,
    )


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False, batch_bytes: int = 1 << 24) -> DataFrame:
    """The records of a committed archive; digests are checked on the way."""
    files = spark.read.parquet(f"{folder}/manifest").select("name")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "payload"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
        )

    def run(batches):
        store, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for headers, block in decode_records(raw):
                        rows.append(_parse(headers, block, name, with_payload))
                        held += 200 + (len(block) if with_payload else 0)
                        if held >= batch_bytes:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    count = max(1, files.count())
    return files.repartition(min(count, 10_000), "name").mapInArrow(run, RECORDS)
