import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_quality as Q
from tessera.llm import toxicity as X




def words(rnd, n, extra=()):
    out = [f"w{rnd.randrange(300)}" for _ in range(n)] + list(extra)
    rnd.shuffle(out)
    return " ".join(out)


@pytest.fixture(scope="module")
def toxic_rows():
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        cue = rnd.choice([("nasty",), ("vile",), (f"grob{rnd.choice('abcdefgh')}{rnd.randrange(40)}",), ("nasty", "vile")]) if bad else ()
        rows.append((i, words(rnd, rnd.randint(3, 60), cue), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, docs, toxic_rows):
    df = docs(*[(i, t) for i, t, _ in toxic_rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    out = X.held_out(F.col("doc_id"), 4, 2)
    model = X.fit_toxicity(df, labels, ~out)
    scored = X.score_texts(df, model).withColumn("out", out).collect()
    truth = {i: y for i, _, y in toxic_rows}
    unseen = [r for r in scored if r.out]
    assert 100 < len(unseen) < 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    left = X.drop_toxic(df, labels, ~out)
    assert left.columns == df.columns
    assert abs(left.count() - sum(1 - y for y in truth.values())) < 20


def test_labels_outside_the_permitted_rows_do_not_matter(spark, docs, toxic_rows):
    df = docs(*[(i, t) for i, t, _ in toxic_rows])
    out = X.held_out(F.col("doc_id"), 4, 2)
    honest = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    upset = honest.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    texts = pa.array([t for _, t, _ in toxic_rows[:50]])
    assert np.allclose(X.fit_toxicity(df, honest, ~out).score(texts), X.fit_toxicity(df, upset, ~out).score(texts))


def test_odd_rows_for_both_classifiers(spark, docs):
    everything = F.lit(True)
    long = "w " * 400_000 + "nasty"
    rows = [(1, None), (2, ""), (3, "\n\n"), (3, "\n\n"), (None, "x"), (5, long), (6, "nasty"), (7, "calm")] + [(10 + i, "nasty" if i % 2 else "calm day") for i in range(40)]
    df = docs(*rows)
    known = [(10 + i, i % 2, 1 - i % 2) for i in range(40)] + [(1, None, None), (None, 1, 1), (2, 0, 1), (2, 0, 0), (99, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, toxic int, quality int")
    tox, good = X.fit_toxicity(df, labels, everything), Q.fit_quality(df, labels, everything)
    for model in (tox, good):
        got = X.score_texts(df, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.predicted for r in X.score_texts(df, tox).collect()}
    assert by_id[6] == 1 and by_id[7] == 0 and by_id[5] == 1  # whole texts are read
    none = labels.limit(0)
    for model in (X.fit_toxicity(df, none, everything), Q.fit_quality(df, none, everything)):
        assert len({r.score for r in X.score_texts(df, model).collect()}) == 1
    empty = docs()
    for model in (X.fit_toxicity(empty, labels, everything), Q.fit_quality(empty, labels, everything)):
        assert X.score_texts(empty, model).count() == 0
    odd = spark.createDataFrame([(1, "nasty", 0.5, "z")], "doc_id long, text string, score double, features string")
    row = X.score_texts(odd, tox).first()
    assert row.predicted == 1 and row.features == "z"


def test_label_model_finds_accuracies_and_shares_correlated_votes():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    rates = [0.6, 0.5, 0.4, 0.5]
    votes = np.stack([(rng.random(4000) < np.where(y, r, 0.01)) for r in rates], axis=1).astype(float)
    post = X.label_model(votes, 0.2)
    assert np.mean((post > 0.5) == y) > 0.9
    # four more spellings of one voter change next to nothing
    crowd = np.concatenate([votes, np.repeat(votes[:, :1], 4, axis=1)], axis=1)
    again = X.label_model(crowd, 0.2)
    assert np.mean((again > 0.5) == y) > 0.9 and np.abs(again - post).mean() < 0.05


def plain_label_model(votes, prior, rounds):
    """Row by row and voter by voter, in plain Python."""
    n, m = len(votes), len(votes[0])
    post = [0.9 if any(v) else prior * 0.1 for v in votes]
    share = [[1.0] * m for _ in range(n)]
    for step in range(rounds):
        ones, zeros = sum(post), n - sum(post)
        p1 = [(sum(p * v[j] for p, v in zip(post, votes)) + 0.5) / (ones + 1) for j in range(m)]
        p0 = [min((sum((1 - p) * v[j] for p, v in zip(post, votes)) + 0.05) / (zeros + 1), p1[j]) for j in range(m)]
        quiet = [p for p, v in zip(post, votes) if not any(v)]
        hush = np.log((sum(quiet) + 0.5) / (ones + 1)) - np.log((len(quiet) - sum(quiet) + 0.5) / (zeros + 1))
        odds = [
            np.log(prior / (1 - prior)) + (0 if any(v) else hush) + sum(v[j] / share[i][j] * np.log(p1[j] / p0[j]) for j in range(m))
            for i, v in enumerate(votes)
        ]
        post = [1 / (1 + np.exp(-x)) for x in odds]
        if step in (5, 15):
            rest = [[v[j] - p * p1[j] - (1 - p) * p0[j] for j in range(m)] for p, v in zip(post, votes)]
            size = [np.sqrt(sum(r[j] ** 2 for r in rest) / n) + 1e-9 for j in range(m)]
            corr = [[sum(r[j] * r[k] for r in rest) / n / size[j] / size[k] if j != k else 0.0 for k in range(m)] for j in range(m)]
            share = [[1 + sum(v[k] * corr[k][j] for k in range(m) if corr[k][j] > 0.1) for j in range(m)] for v in votes]
    return post


def test_label_model_equals_the_plain_steps_and_the_counts_in_spark(spark):
    rng = np.random.default_rng(6)
    y = rng.random(300) < 0.3
    votes = np.stack([rng.random(300) < np.where(y, r, 0.03) for r in (0.7, 0.5, 0.6)] + [y & (rng.random(300) < 0.5)] * 2, axis=1).astype(float)
    post = X.label_model(votes, 0.3, rounds=18)
    assert np.allclose(post, plain_label_model(votes.tolist(), 0.3, 18))
    # the same as counted patterns, with the last columns as fixed patterns
    most = 1
    every = np.concatenate([votes[:, :most], votes[:, most:], np.zeros((300, 0))], axis=1)
    rows = {}
    for v in every.astype(int).tolist():
        key = (tuple(j for j in range(most) if v[j]), sum(x << k for k, x in enumerate(v[most:])))
        rows[key] = rows.get(key, 0) + 1
    counted = spark.createDataFrame([(list(a), b, c) for (a, b), c in rows.items()], "voted array<long>, patterns long, n long")
    model = X.estimate_labels(X.pattern_sums(counted.repartition(3), most), 5, 0.3, rounds=18)
    assert np.allclose(model.posterior(votes), post)


def test_logistic_regression_reaches_the_minimum():
    rng = np.random.default_rng(7)
    x = (rng.random((400, 6)) < 0.4).astype(float)
    y = 1 / (1 + np.exp(-(x @ rng.normal(size=6) * 2 - 0.5)))
    rows, cols = np.nonzero(x)
    w, b = X.logistic(rows, cols, 400, 6, y, ridge=1e-3, steps=3000)
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ error / 400 + 1e-3 * w).max() < 3e-3 and abs(error.mean()) < 3e-3
    weights, shift = np.zeros(6), 0.0  # plain Newton steps
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ weights + shift)))
        full = np.column_stack([x, np.ones(400)])
        hess = full.T @ (full * (p * (1 - p))[:, None]) / 400 + np.diag([1e-3] * 6 + [0.0])
        move = np.linalg.solve(hess, full.T @ (p - y) / 400 + 1e-3 * np.append(weights, 0.0))
        weights, shift = weights - move[:-1], shift - move[-1]
    assert np.allclose(w, weights, atol=0.1) and abs(b - shift) < 0.1


def test_an_id_in_half_of_all_rows_is_one_labelled_row(spark, docs, toxic_rows):
    rows = [(i, t) for i, t, _ in toxic_rows]
    df = docs(*rows, *[(6, "calm words only " + str(k)) for k in range(900)])
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    model = X.fit_toxicity(df, labels, F.lit(True), max_labelled=700)
    scored = {r.doc_id: r.predicted for r in X.score_texts(docs(*rows), model).collect()}
    assert np.mean([scored[i] == y for i, _, y in toxic_rows]) > 0.9


def test_patterns_need_their_texts():
    texts = ["You are an idiot", "u loser", "SHUT UP now", "f**k", "a ** b", "I hate them", "i hate it", "PIG", "ſhut up", None]
    for t in texts:
        assert X.pattern_votes(t) == sum(1 << k for k, p in enumerate(X.PATTERNS) if p.search(t or ""))


@pytest.fixture(scope="module")
def quality_rows():
    rnd = random.Random(9)
    rows = []
    for i in range(500):
        good = i % 3 > 0
        lines = []
        for _ in range(rnd.randint(1, 12)):
            line = words(rnd, rnd.randint(4, 30))
            kind = rnd.randrange(3)
            junk = [line.upper() + "!!", " | ".join(line.split()), " ".join([line.split()[0]] * 12)][kind]
            lines.append(line.capitalize() + "." if good else junk)
        rows.append((i, "\n".join(lines), int(good)))
    return rows


def test_quality_on_held_out_rows(spark, docs, quality_rows):
    df = docs(*[(i, t) for i, t, _ in quality_rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in quality_rows], "doc_id long, quality int")
    out = X.held_out(F.col("doc_id"), 5, 0)
    model = Q.fit_quality(df, labels, ~out)
    truth = {i: y for i, _, y in quality_rows}
    unseen = [r for r in X.score_texts(df, model).withColumn("out", out).collect() if r.out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.95


def test_training_lines_are_bounded_and_an_id_counts_once(spark, docs, quality_rows, monkeypatch):
    df = docs(*[(i, t) for i, t, _ in quality_rows], *[(3, "again\n" * k) for k in range(300)], (7000, "x\n" * 50_000))
    labels = spark.createDataFrame([(i, y) for i, _, y in quality_rows] + [(7000, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "train_crf", lambda f, offs, y, old=Q.train_crf: seen.append((len(f), len(offs) - 1)) or old(f, offs, y))
    model = Q.fit_quality(df, labels, F.lit(True), max_lines=1200)
    lines, texts = seen[0]
    assert 1000 < lines <= 1200 and texts < len(quality_rows)
    truth = {i: y for i, _, y in quality_rows}
    scored = X.score_texts(docs(*[(i, t) for i, t, _ in quality_rows]), model).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in scored]) > 0.9


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(3)
    offs = np.array([0, 1, 5, 8])
    emit, start, trans = rng.normal(size=8), rng.normal(size=2), rng.normal(size=(2, 2))
    alpha, beta, _ = Q.forward_backward(emit, offs, start, trans)
    both = alpha + beta
    got = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        weight, marg = 0.0, np.zeros(b - a)
        for y in product((0, 1), repeat=int(b - a)):
            s = start[y[0]] + sum(e * k for e, k in zip(emit[a:b], y, strict=True)) + sum(trans[p, q] for p, q in zip(y, y[1:], strict=False))
            weight += np.exp(s)
            marg += np.exp(s) * np.array(y)
        assert np.allclose(got[a:b], marg / weight)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["A b.\nC | d | e\n\n", None, "", "É E\nx", "\n", "1 2 3!!! ### a a a"]
    whole, offs, chars = Q.line_features(pa.array(texts))
    assert [int(n) for n in np.diff(offs)] == [len((t or "").split("\n")) for t in texts]
    assert chars.tolist() == [len(x) for t in texts for x in (t or "").split("\n")]
    for i, t in enumerate(texts):
        alone = Q.line_features(pa.array([t], pa.string()))[0]
        assert np.allclose(alone, whole[offs[i] : offs[i + 1]])
