import random
import re

import pytest

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_the_rules(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            checks = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and pii.luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }
            if checks[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rnd = random.Random(8)
    pieces = ["a", "B.c", "@", "@x.org", "1", "22", ".", "...", "+", "-", " ", "  ", "(", ")", "\n", "é", "255", "4111111111111111", "10.0.0.1", "+1 (555) 123-4567", "_", "%", "٣"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == by_the_rules(text), repr(text)


def test_scanning_long_runs_is_linear():
    for text in ("9" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1 " * 100_000, "@" * 100_000, "4 " * 150_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    texts = []
    for _ in range(200):
        digits = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
        card = next(digits + str(c) for c in range(10) if pii.luhn(digits + str(c)))
        texts.append(f"pay with {card} at once")
        texts.append(f"call +1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)} now")
        texts.append(f"write to u{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.com soon")
        texts.append(f"host {rnd.randrange(256)}.{rnd.randrange(256)}.7.{rnd.randrange(256)} up")
    return pii.train_spans(texts, most=120, steps=60)


def test_method_adds_what_the_rules_miss(model):
    card = "4111111111111111"
    text = f"cards {card} {card} end"  # one run of digits for the rules
    assert pii.base_spans(text) == []
    assert model.added(text, []) == [("card", 6, 22), ("card", 23, 39)]
    phone = "call 1 (212) 555-0187 today"
    assert [k for k, *_ in model.added(phone, pii.base_spans(phone))] == ["phone"]


def test_base_spans_stay_and_plain_numbers_are_left_alone(model):
    text = "mail ab@c.de or 4111111111111111"
    base = pii.base_spans(text)
    assert model.added(text, base) == [] and len(base) == 2
    for text in (*pii.PLAIN, "a year 1999, 12 of 30", "4790808788808394", "999.1.1.1", ""):
        assert model.added(text, pii.base_spans(text)) == [], text


@pytest.fixture(scope="module")
def varied():
    """Taught by addresses without digits, of one to four labels in front of the site."""
    rnd = random.Random(2)
    names, hosts = ["anna", "john", "mary.lee", "j.von-berg", "info", "x"], ["uni", "mail", "dept.uni", "cs.dept.uni"]
    texts = [
        f"please write to {rnd.choice(names)}@{rnd.choice(hosts)}.example.{rnd.choice(['org', 'com', 'edu'])} soon"
        for _ in range(200)
    ]
    return pii.train_spans(texts, most=120, steps=60)


@pytest.mark.parametrize(
    "kind, span",
    [
        ("email", "anna-maria.von-der-heide [at] uni.example.org"),
        ("email", "x [at] research.department.university.example.edu"),
        ("email", "john at example dot com"),
        ("email", "a.b.c.d.e.f.g.h.i.j.k.l.m.n.o.p [at] mail.example.com"),
        ("phone", "1 2 1 2 5 5 5 0 1 8 7 3 4"),
        ("phone", "1 2 1 2 5 5 5 0 1 8 7 3 4 6 2"),
        ("card", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
    ],
)
def test_whole_long_spans_are_candidates_of_a_region(varied, kind, span):
    text = f"please write or call: {span} thanks"
    a, b = text.index(span), text.index(span) + len(span)
    assert any(lo <= a and b <= hi for lo, hi in pii.regions(text))
    found = set()
    for lo, hi in pii.regions(text):
        cuts, segments = pii._candidates(text, lo, hi)
        found |= {(pii.KINDS[k], cuts[i], cuts[j]) for i, j, k, _ in segments}
    assert (kind, a, b) in found
    if kind == "email":
        assert varied.added(text, pii.base_spans(text)) == [(kind, a, b)]
        assert all(varied.added(t, pii.base_spans(t)) == [] for t in pii.PLAIN)


def test_a_base_span_that_starts_early_stays_taken(model):
    text = "a" * 450 + "@example.com 5"
    assert list(pii._within([(0, 462)], 440, 464)) == [(0, 462)]
    assert model.added(text, pii.base_spans(text)) == []


def test_regions_of_long_runs_are_linear(model):
    for text in ("9" * 300_000, "a" * 300_000 + "@", "1." * 20_000, "@" * 100_000, "(" * 20_000 + "1", "a at b.c " * 2_000):
        model.added(text, pii.base_spans(text))


def test_decoding_is_the_best_segmentation(model):
    """Dynamic programming against all segmentations of a short region."""
    text = "x 1 (212) 555-0187 4111111111111111"
    cuts, segments = pii._candidates(text, 0, len(text))

    def best(i):
        if i == len(cuts) - 1:
            return 0.0
        here = [best(i + 1)]
        for a, b, k, f in segments:
            if a == i:
                here.append(model.weights[k, f].sum() + best(b))
        return max(here)

    found = model.decode(text, 0, len(text))
    place = {c: n for n, c in enumerate(cuts)}
    score = sum(
        next(model.weights[k, f].sum() for a, b, k, f in segments if (a, b, pii.KINDS[k]) == (place[s], place[e], kind))
        for kind, s, e in found
    )
    assert score == pytest.approx(best(0))


def test_rows_nulls_long_texts_and_empty_tables(spark, docs):
    long = "plain words " * 200_000 + "ab@c.de"
    rows = [(1, "ab@c.de 1.2.3.4"), (1, "ab@c.de 1.2.3.4"), (2, None), (3, ""), (None, long), (5, "é" * 10 + "+49 (30) 123456")]
    df = docs(*rows)
    model = pii.fit_spans(df)
    got = {(r.doc_id, len(r.base)): r for r in pii.find_personal_data(df, model).collect()}
    assert {k: len(v.base) for k, v in got.items()} == {(1, 2): 2, (2, 0): 0, (3, 0): 0, (None, 1): 1, (5, 1): 1}
    assert tuple(got[5, 1].base[0])[1:] == (10, 25)
    assert tuple(got[None, 1].base[0]) == ("email", 2_400_000, 2_400_007)
    assert pii.find_personal_data(docs(), pii.fit_spans(docs())).count() == 0
    odd = spark.createDataFrame([(1, "a@b.c", "x")], "doc_id long, text string, base string")
    assert pii.find_personal_data(odd, model).first().base[0].kind == "email"
