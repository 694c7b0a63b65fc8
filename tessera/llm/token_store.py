"""Token ids as word-aligned binary files: Simple-8b packing, and the reader.

1. Documents are range-sorted by id (ties by a hash of the text, then by place),
   so the text travels once.  The task that holds a range encodes its texts,
   appends the end id and writes files that roll over after ``roll_ids`` ids, at
   the end of a document.
2. A file is a stream of ids in blocks of ``BLOCK_IDS``.  A block is a run of
   64-bit words: four bits of selector and 60 of payload, which hold 60 ids of
   one bit, 30 of two and so on to one of sixty.  Each word takes as many of the
   next ids as fit.  An id of 2^60 or more is an escape: selector 0, whose
   payload is its place in the list of escapes of the block.  The tables at the
   end give each block's first word and first escape and each document's id and
   length, so any range of ids is decoded from its own blocks.
3. Packing and unpacking are vectorised: all blocks of a batch are walked in
   step, and the words of one selector are filled or read together.
4. Files are written under names of their attempt's own; a second job renames
   those of successful attempts, and the manifest, written last, makes the store
   valid.  It also holds each file's first position, a prefix sum over files (one
   row a file).  Readers open what it lists and nothing else.

A word tokenizer's ids of a text are those of its pieces one after the other, so
pieces are encoded once and kept in a bounded table, which tasks of one Python
worker share.  ``pieces`` says what the tokenizer allows: ``texts`` (nothing: whole
texts are encoded), ``words`` (white space enters no token) or ``letters`` (besides,
case makes no difference and no token holds letters and anything else; words with
an apostrophe, a ``<`` or a character that is neither ASCII nor a Latin letter stay
whole).

The vocabulary travels as a broadcast of its file, whose size is that of the
vocabulary.  Files go through ``pyarrow.fs``, so the folder must be one that every
executor reaches.

Defined cases: a null or empty text is the end id alone.  Null ids come first.
Rows that repeat an id are documents of their own, one after the other.  Extra
columns are not written.  An empty table gives a store without files.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How many ids of how many bits a word of each selector holds (selector 0 is the escape, 15 is not used).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
MAGIC = b"S8BTOK01"
BLOCK_IDS = 1024
#: Ids packed or unpacked at a time.
BATCH_IDS = 1 << 20
_PAD = 60
_FOOTER = struct.Struct("<6Q8s")
MANIFEST = "temp string, name string, shard long, part long, docs long, ids long, bytes long"


def pack(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, escapes, escapes of each block) of unsigned ids."""
    n = len(ids)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, np.empty(0, np.uint64), none
    rows = -(-n // block)
    # a row a block, with zeros behind its end, so that a word may reach over it
    grid = np.zeros((rows, block + _PAD), np.uint64)
    full = n // block
    grid[:full, :block] = ids[: full * block].reshape(full, block)
    if full < rows:
        grid[full, : n - full * block] = ids[full * block :]
    length = np.full(rows, block)
    length[-1] = n - (rows - 1) * block
    # the narrowest selector that holds an id by itself: 1 to 14, or 15
    least = np.ones(grid.shape, np.uint8)
    small = grid.astype(np.uint32) if not n or int(ids.max()) < 1 << 32 else grid
    for s in range(1, 15):
        if int(WIDTHS[s]) < 8 * small.itemsize:
            least += small >= small.dtype.type(1 << int(WIDTHS[s]))
    # what fits a narrow selector from some place on fits all wider ones
    choice = np.full((rows, block), 15, np.uint8)
    over = np.zeros((rows, block + _PAD + 1), np.int16)
    for s in range(1, 15):
        count = int(COUNTS[s])
        np.cumsum(least > s, axis=1, dtype=np.int16, out=over[:, 1:])
        choice -= over[:, count : count + block] == over[:, :block]
    choice[choice == 15] = 0
    step = COUNTS[choice]
    starts = np.zeros((rows, block), bool)
    row, at = np.arange(rows), np.zeros(rows, np.int64)
    while len(row):
        starts[row, at] = True
        at = at + step[row, at]
        more = at < length[row]
        if not more.all():
            row, at = row[more], at[more]
    row, at = np.nonzero(starts)
    chosen = choice[row, at]
    place = row * (block + _PAD) + at
    flat = grid.ravel()
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        of = np.flatnonzero(chosen == s)
        if len(of):
            first = place[of]
            value = flat[first]
            for k in range(1, int(COUNTS[s])):
                value = value | (flat[first + k] << np.uint64(k * int(WIDTHS[s])))
            words[of] |= value
    out = chosen == 0
    escapes = flat[place[out]]
    n_escapes = np.bincount(row[out], minlength=rows)
    if len(escapes):
        words[out] |= (np.arange(len(escapes)) - (np.cumsum(n_escapes) - n_escapes)[row[out]]).astype(np.uint64)
    return words, np.bincount(row, minlength=rows), escapes, n_escapes


def unpack(words, n_words, escapes, n_escapes, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ``n`` ids of whole blocks (the last may be short); the inverse of ``pack``."""
    rows = len(n_words)
    if not rows:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 15).any():
        raise ValueError("a word has an unknown selector")
    row = np.repeat(np.arange(rows), n_words)
    count = COUNTS[selector]
    before = np.cumsum(count) - count
    held = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
    length = np.full(rows, block)
    length[-1] = n - (rows - 1) * block
    if (held < length).any() or (held >= length + _PAD).any():
        raise ValueError("a block does not hold as many ids as it should")
    place = before - (np.cumsum(held) - held)[row] + row * (block + _PAD)
    out = np.empty(rows * (block + _PAD), np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for s in range(1, 15):
        of = np.flatnonzero(selector == s)
        if len(of):
            first, value, mask = place[of], payload[of], np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(int(COUNTS[s])):
                out[first + k] = (value >> np.uint64(k * int(WIDTHS[s]))) & mask
    of = np.flatnonzero(selector == 0)
    if len(of):
        base = np.cumsum(n_escapes) - n_escapes
        out[place[of]] = escapes[base[row[of]] + payload[of].astype(np.int64)]
    return out.reshape(rows, block + _PAD)[:, :block].ravel()[:n]


class TokenFileWriter:
    """Writes one file to a binary stream: documents are added in order, then ``close``."""

    def __init__(self, out):
        self.out = out
        self.out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.tables = [[], [], []]  # words, escapes of blocks; escapes
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BATCH_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting).astype(np.uint64) if self.waiting else np.empty(0, np.uint64)
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        for at in range(0, whole, BATCH_IDS):
            words, n_words, escapes, n_escapes = pack(ids[at : min(at + BATCH_IDS, whole)])
            self.out.write(words.astype("<u8").tobytes())
            for kept, new in zip(self.tables, (n_words, n_escapes, escapes)):
                kept.append(new)
        self.waiting = [ids[whole:]]
        self.n_waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        n_words, n_escapes, escapes = [np.concatenate(t) if t else np.empty(0, np.uint64) for t in self.tables]
        self.out.write(escapes.astype("<u8").tobytes())
        for counts in (n_words, n_escapes):
            self.out.write(np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
        doc = np.array([d[0] for d in self.docs], "<i8"), np.array([d[1] for d in self.docs], "u1"), np.array([d[2] for d in self.docs], "<u8")
        for column in doc:
            self.out.write(column.tobytes())
        self.out.write(
            _FOOTER.pack(int(n_words.sum()), len(escapes), len(n_words), len(self.docs), self.n_ids, BLOCK_IDS, MAGIC)
        )
        self.out.close()


class TokenFile:
    """Reads a file by its tables; ``source`` is a random-access file (``read_at(size, offset)`` and ``size()``)."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        raw = source.read_at(_FOOTER.size, max(0, end - _FOOTER.size))
        if len(raw) < _FOOTER.size or not raw.endswith(MAGIC):
            raise ValueError("not a token file, or cut short")
        self.n_words, self.n_escapes, self.n_blocks, self.n_docs, self.n_ids, self.block, _ = _FOOTER.unpack(raw)
        at = len(MAGIC) + 8 * self.n_words
        escapes = 8 * self.n_escapes
        tables = source.read_at(16 * (self.n_blocks + 1) + 17 * self.n_docs, at + escapes)
        self.escapes_at = at
        cut = 8 * (self.n_blocks + 1)
        self.first_word = np.frombuffer(tables, "<u8", self.n_blocks + 1).astype(np.int64)
        self.first_escape = np.frombuffer(tables, "<u8", self.n_blocks + 1, cut).astype(np.int64)
        ids = np.frombuffer(tables, "<i8", self.n_docs, 2 * cut)
        null = np.frombuffer(tables, "u1", self.n_docs, 2 * cut + 8 * self.n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.lengths = np.frombuffer(tables, "<u8", self.n_docs, 2 * cut + 9 * self.n_docs).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``last`` (exclusive)."""
        w0, w1 = self.first_word[first], self.first_word[last]
        e0, e1 = self.first_escape[first], self.first_escape[last]
        words = np.frombuffer(self.source.read_at(int(8 * (w1 - w0)), int(len(MAGIC) + 8 * w0)), "<u8")
        raw = self.source.read_at(int(8 * (e1 - e0)), int(self.escapes_at + 8 * e0)) if e1 > e0 else b""
        n = min(last * self.block, self.n_ids) - first * self.block
        counts = np.diff(self.first_word[first : last + 1]), np.diff(self.first_escape[first : last + 1])
        return unpack(words, counts[0], np.frombuffer(raw, "<u8"), counts[1], n, self.block)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at positions ``start`` to ``stop`` (exclusive) of the file, from their own blocks."""
        if start >= stop:
            return np.empty(0, np.uint64)
        first, last = start // self.block, -(-stop // self.block)
        return self.blocks(first, last)[start - first * self.block : stop - first * self.block]

    def documents(self):
        """(doc id, ids) of every document in order, some blocks in memory at a time."""
        stop = np.cumsum(self.lengths)
        per = max(1, BATCH_IDS // self.block)
        held, held_from, nxt = np.empty(0, np.uint64), 0, 0
        for doc_id, n, end in zip(self.doc_ids, self.lengths.tolist(), stop.tolist()):
            parts = []
            at = end - n
            while at < end:
                if at >= held_from + len(held):
                    held_from = nxt * self.block
                    held = self.blocks(nxt, min(nxt + per, self.n_blocks))
                    nxt += per
                take = held[at - held_from : end - held_from]
                parts.append(take)
                at += len(take)
            yield doc_id, np.concatenate(parts) if len(parts) != 1 else parts[0]


#: Words that fall into pieces: ASCII without apostrophe and ``<``, and Latin letters beyond it (in UTF-8).
_PLAIN = re.compile(rb"(?:[!-&(-;=-~]|[\xc3-\xc8][\x80-\xbf])+")
_PIECE = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff]+")


def _as_bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Pieces(dict):
    """The ids of a piece as bytes, encoded when first met."""

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most

    def encode(self, piece: bytes) -> bytes:
        return _as_bytes(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def __missing__(self, piece: bytes) -> bytes:
        got = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = got
        return got


class _Letters(_Pieces):
    """Runs of letters, digits and runs of other characters; the model alone knows lower-case ASCII letters."""

    def encode(self, piece: bytes) -> bytes:
        if piece.isalpha():
            return _as_bytes([t.id for t in self.model.tokenize(piece.decode())])
        return super().encode(piece)


class _Words(_Pieces):
    """Words between white space, put together from their pieces where they have such."""

    def __init__(self, tokenizer, most: int):
        super().__init__(tokenizer, most)
        self.letters = _Letters(tokenizer, most)

    def encode(self, piece: bytes) -> bytes:
        if piece.isalpha():
            return self.letters[piece.lower()]
        if _PLAIN.fullmatch(piece) and (piece.isascii() or _latin(piece)):
            return b"".join(map(self.letters.__getitem__, _PIECE.findall(piece.lower())))
        return super().encode(piece)


def _latin(word: bytes) -> bool:
    """Whether all that is not ASCII is letters (the two signs among U+00C0 to U+023F are not)."""
    return b"\xc3\x97" not in word and b"\xc3\xb7" not in word


_ENCODERS: dict = {}


def text_encoder(vocabulary: str, pieces: str = "texts", table: int = 1 << 20):
    """A function from the bytes of a text to its ids; ``vocabulary`` is the text of a tokenizer file."""
    if pieces not in ("texts", "words", "letters"):
        raise ValueError(f"Unknown pieces: {pieces}")
    key = hashlib.sha256(vocabulary.encode()).digest(), pieces, table
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _make_encoder(vocabulary, pieces, table)
    return _ENCODERS[key]


def _make_encoder(vocabulary: str, pieces: str, table: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if pieces == "texts":
        return lambda text: np.array(tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
    known = (_Pieces if pieces == "words" else _Words)(tokenizer, table)
    # bytes are split at ASCII white space only
    return lambda text: np.frombuffer(b"".join(map(known.__getitem__, text.split())), "<u4")


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    roll_ids: int = 1 << 26,
    pieces: str = "texts",
    table: int = 1 << 20,
    num_shards: int | None = None,
) -> DataFrame:
    """Encode ``docs`` into a store in ``folder`` (which must not hold one) and return its manifest.

    ``num_shards`` fixes the number of ranges; by default Spark's shuffle settings do.
    """
    spark = docs.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/manifest").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds a token store already")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # the last key parts rows that are equal in all else, so that no value is bound to one task
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        text.cast("binary").alias("text"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )
    by = ["doc_id", "key", "place"]
    ranged = rows.repartitionByRange(num_shards, *by) if num_shards else rows.repartitionByRange(*by)
    ready = ranged.sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches):
        encode = text_encoder(vocabulary.value, pieces, table)
        end = np.array([end_id], "<u4")
        target, base = fs.FileSystem.from_uri(folder)
        shard, part, writer, done = TaskContext.get().partitionId(), 0, None, []

        def close():
            writer.close()
            info = target.get_file_info(f"{base}/{temp}")
            name = f"ids-{shard:06d}-{part:05d}.s8b"
            done.append((temp, name, shard, part, len(writer.docs), writer.n_ids, info.size))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is not None and writer.n_ids >= roll_ids:
                    close()
                    writer, part = None, part + 1
                if writer is None:
                    temp = f"_temporary/{uuid.uuid4().hex}"
                    target.create_dir(f"{base}/_temporary", recursive=True)
                    writer = TokenFileWriter(target.open_output_stream(f"{base}/{temp}"))
                writer.add(doc_id, np.concatenate([encode(text.as_py()), end]))
        if writer is not None:
            close()
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = [pa.string(), pa.string()] + [pa.int64()] * 5
        columns = list(zip(*done)) if done else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    ready.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_written")
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_written")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def commit(batches):
        target, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist()):
                if target.get_file_info(f"{base}/{temp}").type != fs.FileType.NotFound:
                    target.move(f"{base}/{temp}", f"{base}/{name}")
                elif target.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield batch

    placed.mapInArrow(commit, f"{MANIFEST}, start long").drop("temp").write.parquet(f"{folder}/manifest")
    if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")  # what failed attempts have left
    vocabulary.unpersist()
    return spark.read.parquet(f"{folder}/manifest")


DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary, file string"


def read_tokens(spark: SparkSession, folder: str, batch_bytes: int = 1 << 24) -> DataFrame:
    """The documents of a committed store: ``ids`` are little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(f"{folder}/manifest").select("name", "start", "ids")
    names = [c.split()[0] for c in DOCUMENTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        target, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, n_ids in zip(*[c.to_pylist() for c in batch.columns]):
                with target.open_input_file(f"{base}/{name}") as source:
                    file = TokenFile(source)
                    if file.n_ids != n_ids:
                        raise ValueError(f"{name} does not hold the ids that the manifest lists")
                    rows, held = [], 0
                    for doc_id, ids in file.documents():
                        rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), name))
                        start += len(ids)
                        held += 100 + 4 * len(ids)
                        if held >= batch_bytes:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    count = max(1, files.count())
    return files.repartition(min(count, 10_000), "name").mapInArrow(run, DOCUMENTS)
