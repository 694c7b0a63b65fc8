"""Word and shingle hashes of whole text columns, vectorised over the bytes of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer text is cut between words, so memory stays bounded.
BLOCK = 1 << 21
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_ODD = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Words are runs of anything but ASCII white space.
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[9, 10, 11, 12, 13, 32]] = False
#: Words are runs of ASCII letters and digits and of any character beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if len(column) == 0 or pa.types.is_null(column.type):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offs


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _STEP, dtype=np.uint64))
    return _POWERS


_POWERS = np.cumprod(np.full(4096, _STEP, dtype=np.uint64))


def _block(data: np.ndarray, breaks: np.ndarray, word: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and of their prefixes, one row a kind; word starts)."""
    inside = word[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[breaks] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.empty((1 + len(prefixes), 0), np.uint64), starts
    first = starts[0]
    values = np.where(word, _BYTE, np.uint64(0))[data[first:]]
    spans = np.diff(np.append(starts, len(data)))
    within = np.arange(first, len(data)) - np.repeat(starts, spans)
    values *= _powers(int(spans.max()))[within]
    hashes = [mix(np.add.reduceat(values, starts - first))]
    for k in prefixes:
        hashes.append(mix(np.add.reduceat(np.where(within < k, values, np.uint64(0)), starts - first) + np.uint64(k)))
    return np.stack(hashes), starts


def word_hashes(column: pa.Array, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each row's words); A-Z are lower-cased."""
    hashes, offs = word_kinds(column, word, ())
    return hashes[0], offs


def word_kinds(column: pa.Array, word: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, with a further row of hashes for the first ``k`` bytes of each word, for each prefix ``k``."""
    data, offs = text_buffers(column)
    parts, places = [], []
    pos, end = int(offs[0]), int(offs[-1])
    while pos < end:
        cut = min(pos + BLOCK, end)
        if cut < end:
            row = offs[np.searchsorted(offs, cut, side="right") - 1]
            if row > pos:
                cut = int(row)
            else:  # inside one long text: back to a byte between words, else on to the next one
                gaps = np.flatnonzero(~word[data[pos:cut]])
                if len(gaps):
                    cut = pos + int(gaps[-1]) + 1
                else:
                    stop = int(offs[np.searchsorted(offs, cut, side="right")])
                    gaps = np.flatnonzero(~word[data[cut:stop]])
                    cut = cut + int(gaps[0]) + 1 if len(gaps) else stop
        breaks = offs[(offs >= pos) & (offs < cut)] - pos
        hashes, starts = _block(data[pos:cut], breaks, word, prefixes)
        parts.append(hashes)
        places.append(starts + pos)
        pos = cut
    if not parts:
        return np.empty((1 + len(prefixes), 0), np.uint64), np.zeros(len(offs), np.int64)
    where = np.concatenate(places)
    return np.concatenate(parts, axis=1), np.searchsorted(where, offs)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words (empty if there are fewer)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += words[j : j + count] * _ODD[j]
    return mix(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; with fewer than ``n`` words, the whole sequence as one."""
    if len(words) >= n:
        return np.unique(shingle_hashes(words, n))
    if len(words):
        return shingle_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.empty(0, np.uint64)
