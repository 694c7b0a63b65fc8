import random

import pytest

from tessera.llm.url_rules import RULES, judge_urls, match_rules, mine_rules

PAGES = "page_id long, url string, html string"


def expected(url, rules=RULES):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        r for r, _ in rules
        if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])
    ]
    return host, path, max(fits, key=len, default=None)


URLS = [
    "http://a.net/x", "http://net/", "http://a.net", "http://example.net/en/p", "http://www.EXAMPLE.net/en/p", "http://badexample.net/en/p",
    "http://example.com/de/1.html", "http://x.org/fr/", "http://x.org/fr", "https://ünet.org/FR/É?a=1#b", "ftp://h:80/p;x?q://z", "http://?a",
    "no scheme", "", None, "a://b://c/d", "http://u@h.net/", "http://h.net\n/x", "http://h.net?x=/y", "http://h.org#/fr/",
]


def test_parts_and_fixed_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, "http://q.net/", "x")]
    got = judge_urls(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    verdicts = dict(RULES)
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        r = by_id[i]
        assert (r.host, r.path, r.rule) == expected(u), u
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdicts[r.rule])
    assert by_id[None].rule == "net/"


def test_the_first_scheme_mark_decides_where_the_path_is_empty(spark):
    urls = ["http://example.com?u=http://other.com/de/x", "https://a.org#x://y/fr/z"]
    got = judge_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)).collect()
    for r in got:
        assert (r.host, r.path, r.rule) == expected(urls[r.page_id]) == (("example.com", "a.org")[r.page_id], "", None)


def test_mined_rules_have_their_support_and_confidence(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(400):
        tokens = {t for t in "abcdef" if rnd.random() < 0.4} | {"z"}
        bad = {"a", "b"} <= tokens or "c" in tokens and rnd.random() < 0.9
        rows.append((sorted(tokens), "block" if bad else "allow"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = {(tuple(r.tokens), r.verdict): r for r in mine_rules(labelled, 0.05, 0.8).collect()}
    every = {}
    from itertools import combinations

    for n in (1, 2, 3, 4, 5, 6, 7):
        for combo in combinations("abcdefz", n):
            met = [label for tokens, label in rows if set(combo) <= set(tokens)]
            for verdict in ("allow", "block"):
                k = met.count(verdict)
                if met and k / 400 >= 0.05 and k / len(met) >= 0.8:
                    every[combo, verdict] = k / len(met)
    kept = {
        (c, v) for (c, v), p in every.items()
        if not any(v == w and set(d) < set(c) and q >= p - 1e-12 for (d, w), q in every.items())
    }
    assert set(rules) == kept
    for key, r in rules.items():
        assert r.confidence == pytest.approx(every[key])


def test_index_matches_as_a_scan_does(spark):
    rnd = random.Random(6)
    rules = [
        (k, sorted(rnd.sample("abcdefgh", rnd.randint(1, 3))), rnd.choice(["allow", "block"]), rnd.choice([0.8, 0.9, 1.0]), rnd.choice([0.1, 0.2]))
        for k in range(12)
    ]
    sets = [(f"s{i}", sorted(rnd.sample("abcdefgh", rnd.randint(1, 6)))) for i in range(60)]
    got = dict(
        match_rules(
            spark.createDataFrame(sets, "key string, tokens array<string>"),
            spark.createDataFrame(rules, "rule_id long, tokens array<string>, verdict string, confidence double, support double"),
        ).collect()
    )
    for key, tokens in sets:
        fits = [(c, s, len(t), v) for _, t, v, c, s in rules if set(t) <= set(tokens)]
        assert got.get(key) == (max(fits)[3] if fits else None)


@pytest.mark.parametrize(
    "url",
    [
        "https://x{i}.com/a/b/c/{w}/1",
        "https://x{i}.com/?a=1&b=1&c=1&d=1&{w}=1",
        "https://{w}.d.c.b.a.x{i}.com/",
    ],
)
def test_tokens_far_behind_tell(spark, url):
    """Segment 4, key 5 and host label 5 in front of the site."""
    make = lambda a, n: [url.format(i=a + i, w="bad" if i % 2 else "good") for i in range(n)]
    labels = [(u, "block" if i % 2 else "allow") for i, u in enumerate(make(0, 40))]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(make(500, 20))], PAGES)
    got = judge_urls(pages, rules=(), labels=spark.createDataFrame(labels, "url string, label string")).collect()
    assert {(r.page_id % 2, r.verdict) for r in got} == {(0, "allow"), (1, "block")}


def test_many_keys_of_one_template_are_mined_and_told_apart(spark):
    keys = "&".join(f"k{j}=1" for j in range(30))  # 2**30 frequent sets if mined one by one
    labels = [(f"http://a{i}.com/?{keys}", "block") for i in range(30)] + [(f"http://b{i}.com/", "allow") for i in range(30)]
    labels = spark.createDataFrame(labels, "url string, label string")
    pages = spark.createDataFrame([(j, f"http://c.com/?k{j}=2", None) for j in range(30)] + [(30, "http://c.com/", None)], PAGES)
    got = {r.page_id: r.verdict for r in judge_urls(pages, rules=(), labels=labels, support=0.05).collect()}
    assert got == {j: "block" if j < 30 else "allow" for j in range(31)}


def test_labels_teach_and_the_unlabelled_are_allowed(spark):
    pages = [(i, f"http://site{i % 7}.com/{'spam' if i % 2 else 'news'}/{i}", None) for i in range(80)]
    df = spark.createDataFrame(pages, PAGES)
    labels = spark.createDataFrame(
        [(f"http://other{i}.org/{'spam' if i % 2 else 'news'}/{i}", "block" if i % 2 else "allow") for i in range(60)] + [(None, "block"), ("http://x.y/", None)],
        "url string, label string",
    )
    got = judge_urls(df, rules=(), labels=labels).collect()
    assert {(r.page_id % 2, r.verdict) for r in got} == {(0, "allow"), (1, "block")}
    assert {r.verdict for r in judge_urls(df, rules=()).collect()} == {"allow"}
    assert judge_urls(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "http://a.net/", "x", "y")], "page_id long, url string, host string, verdict string")
    assert judge_urls(odd).first().verdict == "block"


def test_many_frequent_keys_that_go_with_one_label(spark):
    """Forty keys, each in most of the URLs but not in the same ones: 2**40 frequent sets, forty rules."""
    rnd = random.Random(8)
    keys = lambda: "&".join(f"k{j}=1" for j in range(40) if rnd.random() < 0.85)
    pages = [(i, f"http://h.net/p{i % 5}?{keys()}", None) for i in range(300)]
    pages += [(1000 + j, f"http://c.com/?k{j}=2", None) for j in range(40)] + [(2000, "http://example.net/en/a", None), (2001, "http://c.com/z", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(pages, PAGES)).collect()}
    assert all(got[i] == ("net/", "block") for i in range(300)) and all(got[1000 + j] == (None, "block") for j in range(40))
    assert got[2000] == ("example.net/en/", "allow") and got[2001] == (None, "allow")
