"""Randomised parity of the JVM value expressions with Python's own string functions."""

import random
import re
import unicodedata

from tessera.functions import naming as N
from tessera.functions import values as V

ALPHABET = (
    list("abcXYZ019 _-.:/|*?<>\"") + ["\t", "\n", "　", "\xa0", "\x1c", "\x85", " "]
    + ["ß", "Ａ", "ｂ", "ﬁ", "İ", "ǅ", "①", "é", "Σ", "ς", "ｶﾞ", "日", "㍿", "Ⅸ"]
)


def _strings(seed, n=300):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_unicode_expressions_match_python(spark):
    texts = _strings(7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, v string")
    st = df.schema["v"].dataType
    rows = df.select(
        "i",
        V.nfkc("v").alias("nfkc"),
        V.casefold("v").alias("fold"),
        V.fold_key("v").alias("key"),
        V.trim_ws("v").alias("trim"),
        V.collapse_ws("v").alias("collapse"),
        V.is_blank(df["v"], st).alias("blank"),
    ).orderBy("i").collect()
    for t, r in zip(texts, rows):
        assert r["nfkc"] == unicodedata.normalize("NFKC", t), repr(t)
        assert r["fold"] == t.casefold(), repr(t)
        assert r["key"] == unicodedata.normalize("NFKC", t).strip().casefold(), repr(t)
        assert r["trim"] == t.strip(), repr(t)
        assert r["collapse"] == re.sub(r"\s+", " ", t), repr(t)
        assert r["blank"] == (not t.strip()), repr(t)


def test_safe_path_names_hold_nothing_unsafe(spark):
    texts = _strings(11) + ["con", "LPT1", "a.", " . ", "x" * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, v string")
    rows = [r["n"] for r in df.select("i", N.safe_path_name("v").alias("n")).orderBy("i").collect()]
    assert rows[-5:] == ["_con", "_LPT1", "a", "output", "x" * 180]
    for name in rows:
        assert name and len(name) <= 180 and not set(name) & set('<>:"/\\|?*\t\n'), repr(name)
        assert not name.endswith((".", " ")) and name.upper() not in N.RESERVED_NAMES, repr(name)


def test_display_and_canonical_match_python(spark):
    texts = _strings(23) + ["EMPTY", " empty ", "  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, v string")
    st = df.schema["v"].dataType
    rows = df.select(
        "i", V.display_value(df["v"], st).alias("d"), V.canonical_value(df["v"], st).alias("c")
    ).orderBy("i").collect()
    for t, r in zip(texts, rows):
        shown = unicodedata.normalize("NFKC", t).strip()
        empty = not t.strip()
        assert r["d"] == ("EMPTY" if empty else shown), repr(t)
        assert r["c"] == (V.EMPTY_KEY if empty or shown == "EMPTY" else shown.casefold()), repr(t)
        if not empty:
            assert r["c"] == V.selection_key(t), repr(t)
