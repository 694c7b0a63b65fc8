"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters.  Every word and word prefix of a bounded sample of labelled rows is
   counted by label; the ones that stand clearly for label 1 become lexicon
   voters.  A few fixed patterns (insulting address, masked swearing)
   vote as well.  A voter votes 1 or abstains.
2. Label model.  The votes of all documents, labels unseen, are counted by
   pattern of votes; expectation maximisation over these counts estimates each
   voter's rates in either class and the posterior of the hidden label.  Voters
   that agree beyond what the label explains are correlated; by the residual
   correlations, estimated from the same posteriors, a vote shares its evidence
   with the correlated votes of its row, so that ten spellings of one cue count
   about once.  Tasks add up the expectations; sums over voters come back.
3. Classifier.  A logistic regression over the presence of words and prefixes
   is trained on the posterior labels of the labelled sample's texts and scores
   every whole text; the known labels set its intercept, so that the best cut
   lies at ``threshold``.

Bounds (parameters): ``max_labelled`` labelled rows (distinct ids, one text of
each), ``max_voters`` voters, ``max_features`` weights.  The sample is the rows
with the smallest hash of their id, so reruns agree.  Only rows for which
``may_learn`` holds are learned from; labels, language, source and id are never
inputs of a score.

Defined cases: null and empty texts have no feature and get the score of the
intercept.  Null labels are not learned from; an id with several labels counts
as 1 if any is 1.  Without labelled rows of both classes every score is the
smoothed base rate.  Repeated rows are scored one by one.  Extra columns pass
by; columns named like the outputs are replaced.  An empty table yields an
empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise
from tessera.llm.words import LETTERS, word_kinds

PREFIXES = (4, 5)
#: Votes of fixed patterns, and texts (case folded) one of which each needs.
PATTERNS = (
    re.compile(r"\b(?:you|u)(?:'re| are| r)? (?:an? )?(?:such an? )?(?:idiot|moron|loser|clown|pig|fool)", re.I),
    re.compile(r"\b(?:shut up|get lost|go to hell|drop dead)\b", re.I),
    re.compile(r"\b[a-z]\*{2,}[a-z]+\b", re.I),
    re.compile(r"\bi hate (?:you|them|those)\b", re.I),
)
NEEDED = (
    ("idiot", "moron", "loser", "clown", "pig", "fool"),
    ("shut up", "get lost", "go to hell", "drop dead"),
    ("**",),
    ("i hate ",),
)


def pattern_votes(text: str | None) -> int:
    """A bit for each pattern that the text holds."""
    folded = (text or "").casefold()
    return sum(
        1 << k
        for k, (pattern, needed) in enumerate(zip(PATTERNS, NEEDED, strict=True))
        if any(x in folded for x in needed) and pattern.search(text)
    )


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct word and prefix of every row, as parallel arrays."""
    kinds, offs = word_kinds(column, LETTERS, PREFIXES)
    row = np.repeat(np.arange(len(column)), np.diff(offs))
    return np.tile(row, len(kinds)), kinds.reshape(-1)


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if not len(row):
        return row, value
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))
    return row[new], value[new]


def _count(batches):
    for batch in batches:
        row, value = _distinct(*_features(batch.column(0)))
        label = batch.column(1).to_numpy()[row] if len(row) else np.empty(0, np.int64)
        keys, where = np.unique(value, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.view(np.int64)),
                pa.array(np.bincount(where, minlength=len(keys)).astype(np.int64)),
                pa.array(np.bincount(where, weights=label, minlength=len(keys)).astype(np.int64)),
            ],
            names=["feature", "n", "n1"],
        )


@dataclass
class Vocabulary:
    """Sorted feature hashes, with a bitmap that spares most words the search."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.bits = bits

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the vocabulary's features in each row, distinct."""
        row, value = _features(column)
        maybe = self.bits[(value >> np.uint64(44)).astype(np.int64)]
        row, value = row[maybe], value[maybe]
        if not len(value):
            return row, np.empty(0, np.int64)
        index = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        found = self.hashes[index] == value
        return _distinct(row[found], index[found])


def _observe(vocabulary: Vocabulary):
    def run(batches):
        for batch in batches:
            row, index = vocabulary.find(batch.column(0))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            votes = [pattern_votes(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([index[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())),
                    pa.array(votes, pa.int64()),
                    batch.column(1),
                ],
                names=["features", "patterns", "label"],
            )

    return run


def _gain(n: Column, n1: Column, rate: float) -> Column:
    p = (n1 + rate) / (n + 1)
    both = n1 * F.log(p / rate) + (n - n1) * F.log((1 - p) / (1 - rate))
    return F.when(p > rate, both).otherwise(-both)


def _pairs(lists) -> tuple[np.ndarray, np.ndarray]:
    lengths = lists.map(len).to_numpy()
    values = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lengths.sum() else np.empty(0, np.int64)
    return np.repeat(np.arange(len(lists)), lengths), values


def choose_voters(
    rows: np.ndarray, cols: np.ndarray, label: np.ndarray, gain: np.ndarray, rate: float, most: int
) -> np.ndarray:
    """Features that are evidence for label 1 on rows that no stronger voter explains.

    A prefix whose rows all hold one telling word adds nothing once the word is
    a voter; what is left of it is judged by itself.
    """
    order = np.argsort(cols, kind="stable")
    rows, cut = rows[order], np.searchsorted(cols[order], np.arange(len(gain) + 1))
    open_rows = np.ones(len(label), dtype=bool)
    out: list[int] = []
    for j in np.argsort(-gain, kind="stable"):
        if gain[j] <= 0 or len(out) == most:
            break
        mine = rows[cut[j] : cut[j + 1]]
        left = mine[open_rows[mine]]
        n, n1 = len(left), int(label[left].sum())
        if n1 < 3 or n1 < 0.8 * n or n1 * np.log(1 / rate) < 5:
            continue
        open_rows[mine] = False
        out.append(int(j))
    return np.array(out, np.int64)


@dataclass
class LabelModel:
    """Rates of the voters in both classes, what silence says, and how votes share evidence."""

    prior: float
    p1: np.ndarray | None = None
    p0: np.ndarray | None = None
    hush: float = 0.0
    pull: np.ndarray | None = None

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of label 1, for each row of a 0/1 matrix of votes (rows x voters)."""
        silent = ~votes.any(axis=1)
        if self.p1 is None:  # before the first step
            return np.where(silent, self.prior * 0.1, 0.9)
        crowd = 1.0 if self.pull is None else 1 + votes @ self.pull
        score = np.log(self.prior / (1 - self.prior)) + (votes / crowd) @ np.log(self.p1 / self.p0) + silent * self.hush
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def expectations(self, votes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Rows, rows of label 1, silent ones of both, and votes of both, as sums."""
        post, silent = count * self.posterior(votes), ~votes.any(axis=1)
        return np.concatenate([[count.sum(), post.sum(), count @ silent, post @ silent], count @ votes, post @ votes])

    def residuals(self, votes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The products of what the label leaves of each two votes, as sums."""
        post = self.posterior(votes)
        rest = votes - np.outer(post, self.p1) - np.outer(1 - post, self.p0)
        return (rest.T @ (rest * count[:, None])).ravel()


def estimate_labels(sums, voters: int, prior: float, rounds: int = 25) -> LabelModel:
    """Expectation maximisation; ``sums(f)`` is the sum of ``f(votes, counts)`` over all patterns of votes."""
    # the prior stays: with few voters the classes' sizes are not identified
    model, pull = LabelModel(float(np.clip(prior, 1e-4, 1 - 1e-4))), None
    for step in range(rounds):
        got = sums(model.expectations)
        n, ones, quiet, quiet_ones = got[:4]
        said, said_ones = got[4 : 4 + voters], got[4 + voters :]
        p1 = (said_ones + 0.5) / (ones + 1.0)
        p0 = np.minimum((said - said_ones + 0.05) / (n - ones + 1.0), p1)  # a voter votes for label 1 or says nothing
        # silence of one voter is no evidence, silence of all of them together is
        hush = np.log((quiet_ones + 0.5) / (ones + 1.0)) - np.log((quiet - quiet_ones + 0.5) / (n - ones + 1.0))
        model = LabelModel(model.prior, p1, p0, float(hush), pull)
        if step in (5, 15):  # residual correlations, given the label as it is now believed
            cross = sums(model.residuals).reshape(voters, voters)
            spread = np.sqrt(np.diag(cross) / n) + 1e-9
            corr = cross / n / np.outer(spread, spread)
            np.fill_diagonal(corr, 0.0)
            pull = np.where(corr > 0.1, corr, 0.0)
    return model


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of label 1 for each row of a 0/1 matrix of votes (rows x voters)."""
    n, m = votes.shape
    if not n or not m:
        return np.full(n, prior)
    return estimate_labels(lambda f: f(votes, np.ones(n)), m, prior, rounds).posterior(votes)


def _vote_matrix(lists, patterns: np.ndarray, place: np.ndarray, voters: int) -> np.ndarray:
    """0/1 votes (rows x voters and patterns) from lists of features and bits of patterns."""
    rows, cols = _pairs(lists)
    votes = np.zeros((len(lists), voters + len(PATTERNS)))
    mine = place[cols] >= 0
    votes[rows[mine], place[cols[mine]]] = 1
    for k in range(len(PATTERNS)):
        votes[:, voters + k] = (patterns >> k) & 1
    return votes


def pattern_sums(counted: DataFrame, voters: int):
    """``sums`` for ``estimate_labels`` over rows (voted array<long>, patterns long, n long), added up in Spark."""

    def sums(f):
        def run(batches):
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096).to_pandas()
                    votes = _vote_matrix(part["voted"], part["patterns"].to_numpy(), np.arange(voters), voters)
                    got = f(votes, part["n"].to_numpy(float))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

        added = counted.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.empty(added.num_rows)
        out[added.column("i").to_numpy()] = added.column("v").to_numpy()
        return out

    return sums


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, m: int, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sparse 0/1 features and soft labels (Adam, full batch)."""
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    g1, g2 = np.zeros(m + 1), np.zeros(m + 1)
    for k in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.append(np.bincount(cols, weights=error[rows], minlength=m) + ridge * w, error.sum())
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        step = 0.1 * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def calibrate(z: np.ndarray, label: np.ndarray, threshold: float) -> float:
    """The shift that puts the cut with the fewest errors on the known labels at ``threshold``.

    Of equally good cuts the middle of the widest gap is taken.
    """
    order = np.argsort(z, kind="stable")
    z, label = z[order], label[order]
    errors = np.append(0, np.cumsum(label)) + np.append(np.cumsum((1 - label)[::-1])[::-1], 0)
    low, high = np.append(z[0] - 1.0, z), np.append(z, z[-1] + 1.0)
    wide = np.where(errors == errors.min(), high - low, -1.0)
    cut = (low[wide.argmax()] + high[wide.argmax()]) / 2
    return float(np.log(threshold / (1 - threshold)) - cut)


def smallest_by_hash(ids: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The ``limit`` ids with the smallest hash: a sample that reruns repeat."""
    return ids.orderBy(F.xxhash64(F.lit(11), F.col(id_col)), id_col).limit(limit)


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.intercept)
        if len(self.weights):
            row, index = self.vocabulary.find(column)
            total += np.bincount(row, weights=self.weights[index], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 12000,
    max_voters: int = 256,
    max_features: int = 2048,
    min_support: int = 3,
    threshold: float = 0.3,
) -> ToxicityModel:
    """Fit on rows for which ``may_learn`` (a condition on ``id_col``) holds; ``threshold`` is the score to cut at."""
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & may_learn)
        .groupBy(id_col)
        .agg(F.max(F.col(label_col).cast("long")).alias("label"))
    )
    known = smallest_by_hash(known, id_col, max_labelled)
    # at most max_labelled rows: one text of each id
    labelled = texts.join(F.broadcast(known), id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    labelled = materialise(labelled.select("text", "label"), "labelled-texts")
    counts = (
        labelled.mapInArrow(_count, "feature long, n long, n1 long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
        .filter(F.col("n") >= min_support)
    )
    sizes = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("n1")).first()
    total, ones = sizes.n or 0, sizes.n1 or 0
    base = (ones + 1) / (total + 20)
    empty = ToxicityModel(Vocabulary(np.empty(0, np.uint64)), np.empty(0), float(np.log(base / (1 - base))))
    if not ones or ones == total:
        return empty
    # evidence for label 1: log likelihood of a feature's rows at their own rate against the base rate
    rate = ones / total
    chosen = counts.withColumn("gain", _gain(F.col("n"), F.col("n1"), rate)).orderBy(F.col("gain").desc(), "feature")
    chosen = chosen.limit(max_features).toPandas()
    if chosen.empty:
        return empty
    hashes = chosen["feature"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    chosen, vocabulary = chosen.iloc[order], Vocabulary(hashes[order])
    marked = labelled.mapInArrow(_observe(vocabulary), "features array<long>, patterns long, label long").toArrow().to_pandas()
    voters = choose_voters(
        *_pairs(marked["features"]), marked["label"].to_numpy(), chosen["gain"].to_numpy(), rate, max_voters
    )
    # the voters alone, by their place among themselves, over all documents
    ranked = np.sort(vocabulary.hashes[voters])
    place = np.full(len(vocabulary.hashes), -1)
    place[voters] = np.searchsorted(ranked, vocabulary.hashes[voters])
    counted = (
        texts.filter(may_learn)
        .select("text", F.lit(None).cast("long").alias("label"))
        .mapInArrow(_observe(Vocabulary(ranked)), "features array<long>, patterns long, label long")
        .withColumnRenamed("features", "voted")
        .groupBy("voted", "patterns")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = materialise(counted, "vote-patterns")
    if counted.isEmpty():
        return empty
    model = estimate_labels(pattern_sums(counted, len(voters)), len(voters) + len(PATTERNS), rate)
    post = model.posterior(_vote_matrix(marked["features"], marked["patterns"].to_numpy(), place, len(voters)))
    rows, cols = _pairs(marked["features"])
    n = len(marked)
    weights, intercept = logistic(rows, cols, n, len(vocabulary.hashes), post)
    z = np.bincount(rows, weights=weights[cols], minlength=len(marked)) + intercept
    return ToxicityModel(vocabulary, weights, intercept + calibrate(z, marked["label"].to_numpy(), threshold))


def score_texts(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``; ``model.score`` sees the text column only."""
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = shared.value.score(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*base.schema.fields, *more])
    return base.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, may_learn: Column, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    model = fit_toxicity(docs, labels, may_learn, threshold=threshold, **options)
    return score_texts(docs, model, threshold=threshold).filter("predicted = 0").drop("score", "predicted")
