import hashlib
import random
import zlib

import pytest

from tessera.llm.conversation_trie import conversation_trie, copies_sha, sweep

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tid(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def words(text):
    return len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w])


def plain(rows):
    """All nodes from the rebuilt sequences, prefix by prefix."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, tid(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = turns.get(c - c % 20, [])[:h] + mine[h:]
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    below = {k: [x for x in members if x[: len(k)] == k] for k in members}
    children = {k: [x for x in below[k] if len(x) == len(k) + 1] for k in members}
    out = []
    for k, m in members.items():
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in below[k] if x)
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        leaves = sum(not children[x] for x in below[k])
        out.append((min(m), len(k), parent, len(m), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **options):
    got = conversation_trie(spark.createDataFrame(rows, TURNS), **options)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def sample(seed, n=60, deep=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), n):
        like = rng.choice([0, 0, 1, 2])
        length = rng.choice([1, 1, 2, 3, 5, deep])
        for t in range(length):
            text = "same words here" if like == 0 and t < 8 else f"{rng.choice('ab')} b" if like == 1 else f"w{rng.randrange(3)} \t x"
            rows.append((c, t, rng.choice(["u", "u", "u", None]) if t == 4 else "u", text))
    return rows


@pytest.mark.parametrize(("limit", "window", "chunk"), [(0, 1, 1), (3, 2, 2), (9, 16, 4096), (10_000, 3, 3)])
def test_against_all_prefixes(spark, limit, window, chunk):
    rows = sample(limit + window)
    rng = random.Random(7)
    rng.shuffle(rows)
    assert trie(spark, rows, limit=limit, window=window, chunk=chunk) == plain(rows)


def test_defined_cases(spark):
    rows = [(None, 1, "u", "no conversation"), (1, None, None, None), (1, None, None, None), (1, 0, "u", "x"), (1, 0, "u", "y"), (1, 0, "u", "x")]
    rows += [(2, 5, "u", ""), (3, 1, "u", None), (20, 3, "u", "a  b\tc"), (20, 1, "s", "first"), (21, 1, "s", "first"), (39, 0, "q", "alone"), (-7, 1, "u", "neg")]
    for c in range(40, 60):  # no conversation 40 to 59 has a base but 40
        rows.append((c, 0, "u", "one turn"))
    assert trie(spark, rows, limit=1, window=2) == plain([r for r in rows])


def test_one_long_conversation_and_copies(spark):
    long = [(t, "u", f"turn {t % 50}") for t in range(400)]
    rows = [(20, *t) for t in long] + [(40, *t) for t in long] + [(60, *t) for t in long[:399]]
    rows += [(c, t, "u", f"copy {t}") for c in range(100, 160) for t in range(3)]
    assert trie(spark, rows, limit=64, window=16, chunk=32) == plain(rows)


def test_empty_turnless_and_extra_columns(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "u", "x")]) == []
    # a conversation whose turns are all replaced by those of an absent one
    only = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    assert trie(spark, [(only, 0, "u", "gone")]) == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]
    rows = [(c, t, "u", f"{t}", 1, "k") for c in range(6) for t in range(4)]
    df = spark.createDataFrame(rows, TURNS + ", pos int, k1 string")
    assert sorted((tuple(r) for r in conversation_trie(df).collect()), key=str) == plain([r[:4] for r in rows])


def test_sweep_of_a_container():
    turns = lambda s: [(x.encode(), 2) for x in s]
    got = sweep([(5, 1, 0, turns("abc")), (3, 2, 0, turns("ab")), (9, 1, 0, turns("ad"))], 4)
    assert got == [(3, 4, None, 4, 2, 2, 10, None), (3, 5, 3, 3, 1, 1, 4, 3), (5, 6, 3, 1, 0, 1, 0, 5), (9, 5, 3, 1, 0, 1, 0, 9)]


def test_hash_of_many_copies_in_pieces(spark):
    rows = [(r, c) for r in (1, 2) for c in range(r, 300, 2)]
    got = dict(copies_sha(spark.createDataFrame(rows, "rep long, c long").repartition(5), per_piece=7).collect())
    assert got == {r: hashlib.sha256(",".join(map(str, range(r, 300, 2))).encode()).hexdigest() for r in (1, 2)}
