import re
from collections import defaultdict

from tessera.llm.line_dedup import dedup_lines

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(UPPER)
    seen = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(i)
    gone = {k for k, ids in seen.items() if k and len(ids) >= min_docs}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def check(docs, rows, min_docs):
    got = dedup_lines(docs(*rows), min_docs=min_docs)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows, min_docs)


def test_brute_force(docs):
    rows = [(i, f"Shared line \n own {i}\n\n  ÉCOLE\t\nshared LINE") for i in range(4)]
    rows += [(9, "école\nx"), (10, None), (11, ""), (12, "\n\n"), (13, "shared line"), (14, "a\rb\nshared line\r")]
    check(docs, rows, 3)


def test_repeated_rows_count_as_one_document(docs):
    rows = [(1, "twice\na"), (1, "twice\na"), (1, "twice\nb"), (2, "twice\nc"), (None, "twice"), (None, "twice\nd")]
    check(docs, rows, 3)  # ids 1, 2 and null
    check(docs, rows, 4)


def test_long_text_with_many_cuts(docs):
    long = "\n".join(f"line {i % 700}" for i in range(40_000))
    check(docs, [(1, long), (2, "\n".join(f"line {i}" for i in range(0, 700, 2)) + "\nrest"), (3, "line 5")], 2)


def test_empty_table_and_clashing_columns(spark, docs):
    assert dedup_lines(docs()).count() == 0
    odd = spark.createDataFrame([(1, "a\nb", 7, "x"), (2, "a", 8, "y")], "doc_id long, text string, n_lines long, `_pos` string")
    got = dedup_lines(odd, min_docs=2).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped, r["_pos"]) for r in got] == [("b", 2, 1, "x"), ("", 1, 1, "y")]


def test_no_python_on_the_main_path(docs):
    plan = dedup_lines(docs((1, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
