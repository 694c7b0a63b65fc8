"""Quality by a linear-chain conditional random field over lines.

Every line gets features of its own (length, shares of capitals, digits and
symbols, repetition, punctuation ...) and those of the lines before and after.
A two-state chain (bad, good) scores whole documents; forward-backward gives
the probability that each line is good, and their mean, weighted by line
length in code points, is the document's quality.

Training: a bounded sample of labelled rows (``max_labelled`` ids, those with the
smallest hash, one text of each; of these, in order of the hash, the texts whose
lines together stay within ``max_lines``), whose lines take their document's label.  Only rows
for which ``may_learn`` holds are learned from; labels, language, source and id
are never inputs of a score.  The conditional likelihood is maximised by
full-batch gradient steps on the driver; scoring runs over every whole text.

Defined cases: a null or empty text is one empty line, whose probability is the
score.  Null labels are not learned from; an id with several labels counts as
good only if all are.  Without labelled rows of both classes every score is the
smoothed base rate.  Repeated rows are scored one by one; extra columns pass
by; columns named like the outputs are replaced.  An empty table yields an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.toxicity import score_texts, smallest_by_hash
from tessera.llm.words import LETTERS, text_buffers, word_hashes

__all__ = ["LineCrf", "fit_quality", "line_features", "score_texts"]

#: Bytes looked at in one go (a longer text is looked at alone).
CHUNK = 1 << 22
_CLASS = np.zeros((6, 256), dtype=bool)
_CLASS[0, 65:91] = True  # capitals
_CLASS[1, 97:123] = True  # small letters
_CLASS[2, 48:58] = True  # digits
_CLASS[3, [9, 11, 12, 13, 32]] = True  # white space within a line
_CLASS[4, [ord(c) for c in ".,;:!?'\"()-"]] = True  # punctuation of prose
_CLASS[5, [c for c in range(33, 127) if chr(c) not in ".,;:!?'\"()-" and not chr(c).isalnum()]] = True  # symbols
_END = np.zeros(256, dtype=bool)
_END[[ord("."), ord("!"), ord("?")]] = True
N_OWN = 17


def _sums(flags: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[stops] - total[starts]


def _own_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offs = text_buffers(column)
    lo = int(offs[0])
    data, offs = data[lo : int(offs[-1])], offs - lo
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    # the line after a document's last line feed starts where the next document does: ties keep both
    row_of_break = np.searchsorted(offs, breaks, side="right") - 1
    per_row = 1 + np.bincount(row_of_break, minlength=len(column))
    line_offs = np.append(0, np.cumsum(per_row))
    last = np.zeros(len(starts), dtype=bool)
    last[line_offs[1:] - 1] = True
    stops = np.empty(len(starts), np.int64)
    stops[last] = offs[1:]
    stops[~last] = breaks
    chars = _sums((data & 0xC0) != 0x80, starts, stops)
    counts = [_sums(_CLASS[k][data], starts, stops) for k in range(6)]
    # two-byte Latin capitals: C3 80 .. C3 9E
    accented = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    counts[0] = counts[0] + _sums(accented, starts, stops)
    ends = _sums(_END[data], starts, stops)
    bars = _sums(data == ord("|"), starts, stops)
    same = np.zeros(len(data), dtype=bool)
    same[1:] = (data[1:] == data[:-1]) & ~_CLASS[1][data[1:]] & ~_CLASS[3][data[1:]]
    runs = _sums(same, starts, stops)
    words, word_offs = _line_words(data, starts, stops)
    n_words = np.diff(word_offs)
    line = np.repeat(np.arange(len(starts)), n_words)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((words, line))
    repeat = np.zeros(len(words), dtype=bool)
    repeat[1:] = (words[order][1:] == words[order][:-1]) & (line[order][1:] == line[order][:-1])
    repeated = np.bincount(line[order][repeat], minlength=len(starts))
    adjacent = np.bincount(line[again], minlength=len(starts))
    n = np.maximum(chars, 1)
    w = np.maximum(n_words, 1)
    letters = counts[0] + counts[1]
    full = stops > starts
    final = np.where(full, data[np.maximum(stops - 1, 0)], 0) if len(data) else np.zeros(len(starts), np.uint8)
    initial = np.where(full, data[np.minimum(starts, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(len(starts), np.uint8)
    own = np.stack(
        [
            np.log1p(chars),
            chars == 0,
            counts[0] / np.maximum(letters, 1),
            counts[2] / n,
            counts[4] / n,
            counts[5] / n,
            np.minimum(counts[5] / w, 4.0),
            np.minimum(bars / w, 2.0),
            runs / n,
            np.log1p(n_words),
            np.minimum(chars / w, 30.0),
            repeated / w,
            adjacent / w,
            ends / w,
            _END[final],
            _CLASS[0][initial] | (initial >= 0xC3),
            (repeated / w) * (n_words >= 8),
        ],
        axis=1,
    ).astype(np.float64)
    return own, line_offs, chars


def _line_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lines, given as spans of the bytes that lie one after another."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    offsets[0] = 0
    column = pa.Array.from_buffers(
        pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )
    return word_hashes(column, LETTERS)


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, offsets of each row's lines, line lengths in code points).

    The features are a line's own, those of the line before and of the line after.
    """
    own, offs, chars = _own_features(column)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[offs[:-1]] = 0
    after[offs[1:] - 1] = 0
    edge = np.zeros((len(own), 2))
    edge[offs[:-1], 0] = 1
    edge[offs[1:] - 1, 1] = 1
    return np.concatenate([own, before, after, edge], axis=1), offs, chars


def forward_backward(emit: np.ndarray, offs: np.ndarray, start: np.ndarray, trans: np.ndarray):
    """Log forward and backward values of all chains at once; ``emit`` is the log odds of good per line."""
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    first, sorted_size = offs[:-1][order], size[order]
    score = np.stack([np.zeros_like(emit), emit], axis=1)
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[first] = start + score[first]
    longest = int(sorted_size[0]) if len(sorted_size) else 0
    for t in range(1, longest):
        at = first[: np.searchsorted(-sorted_size, -t)] + t  # chains longer than t
        prev = alpha[at - 1]
        alpha[at] = np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1]) + score[at]
    for t in range(longest - 2, -1, -1):
        at = first[: np.searchsorted(-sorted_size, -(t + 1))] + t
        nxt = beta[at + 1] + score[at + 1]
        beta[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
    return alpha, beta, score


@dataclass
class LineCrf:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    start: np.ndarray
    trans: np.ndarray

    def marginals(self, features: np.ndarray, offs: np.ndarray) -> np.ndarray:
        emit = ((features - self.mean) / self.spread) @ self.weights + self.bias
        alpha, beta, _ = forward_backward(emit, offs, self.start, self.trans)
        both = alpha + beta
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))

    def score(self, column: pa.Array) -> np.ndarray:
        """Length-weighted share of good lines of every row."""
        out = np.empty(len(column))
        _, offs = text_buffers(column)
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK, side="right")) - 1)
            features, lines, chars = line_features(column.slice(row, stop - row))
            good = self.marginals(features, lines)
            total = np.add.reduceat(chars, lines[:-1])
            mean = np.add.reduceat(good, lines[:-1]) / np.diff(lines)
            weighted = np.add.reduceat(good * chars, lines[:-1]) / np.maximum(total, 1)
            out[row:stop] = np.where(total > 0, weighted, mean)
            row = stop
        return np.clip(out, 0.0, 1.0)


def train_crf(
    features: np.ndarray, offs: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3
) -> LineCrf:
    """Maximise the conditional likelihood of the line labels (Adam on the whole sample)."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = (features - mean) / spread
    n, m = x.shape
    first = offs[:-1]
    inner = np.ones(n, dtype=bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen_trans = np.zeros((2, 2))
    np.add.at(seen_trans, (label[at - 1], label[at]), 1)
    seen_start = np.bincount(label[first], minlength=2)
    theta = np.zeros(m + 1 + 2 + 4)
    g1, g2 = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        weights, bias, start, trans = theta[:m], theta[m], theta[m + 1 : m + 3], theta[m + 3 :].reshape(2, 2)
        alpha, beta, score = forward_backward(x @ weights + bias, offs, start, trans)
        both = alpha + beta
        total = np.logaddexp(both[:, 0], both[:, 1])
        p = np.exp(both - total[:, None])
        wait = label - p[:, 1]
        pair = alpha[at - 1][:, :, None] + trans[None] + (score[at] + beta[at])[:, None, :] - total[at][:, None, None]
        grad = np.concatenate(
            [x.T @ wait, [wait.sum()], seen_start - p[first].sum(axis=0), (seen_trans - np.exp(pair).sum(axis=0)).reshape(-1)]
        ) / n - ridge * theta
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        theta = theta + rate * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.99**k)) + 1e-8)
    return LineCrf(mean, spread, theta[:m], float(theta[m]), theta[m + 1 : m + 3], theta[m + 3 :].reshape(2, 2))


def _training_lines(batches):
    for batch in batches:
        features, offs, _ = line_features(batch.column(0))
        own = [features[a:b].reshape(-1) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.list_(pa.float64())), batch.column(1)], names=["features", "label"]
        )


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = 4000,
    max_lines: int = 300_000,
) -> LineCrf:
    """Fit on rows for which ``may_learn`` (a condition on ``id_col``) holds."""
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & may_learn)
        .groupBy(id_col)
        .agg(F.min(F.col(label_col).cast("long")).alias("label"))
    )
    known = smallest_by_hash(known, id_col, max_labelled)
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    # at most max_labelled rows: one text of each id
    labelled = texts.join(F.broadcast(known), id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    labelled = materialise(
        labelled.withColumns({"h": F.xxhash64(F.lit(11), F.col(id_col)), "n": F.size(F.split(F.coalesce("text", F.lit("")), "\n"))}),
        "quality-texts",
    ).filter(F.col("n") <= max_lines)
    whole = Window.orderBy("h", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = labelled.select(id_col, F.sum("n").over(whole).alias("upto")).filter(F.col("upto") <= max_lines).select(id_col)
    rows = (
        labelled.join(F.broadcast(taken), id_col)
        .select("text", "label")
        .mapInArrow(_training_lines, "features array<double>, label long")
        .toArrow()
    )
    label = rows.column("label").to_numpy()
    width = 3 * N_OWN + 2
    if not len(label) or label.min() == label.max():
        base = (label.sum() + 1) / (len(label) + 2)
        return LineCrf(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(base / (1 - base))), np.zeros(2), np.zeros((2, 2)))
    lists = rows.column("features").combine_chunks()
    features = lists.flatten().to_numpy().reshape(-1, width)
    offs = np.append(0, np.cumsum(lists.value_lengths().to_numpy() // width))
    return train_crf(features, offs, np.repeat(label, np.diff(offs)))
