"""Personal data by a semi-Markov conditional random field over candidate spans.

Base spans are found by fixed rules over the whole text: leftmost and
non-overlapping for each kind, matches that fail a kind's check dropped.  The
method then looks at what is left around digits, ``@`` and a spelled-out at or
dot, whole tokens up to white space.  The text there is cut into atoms (runs of
digits, runs of letters, single other characters); any stretch of up to
``MAX_ATOMS`` atoms may be one segment of a kind, beyond that any digits and
separators up to the most digits of a kind, and any well-formed address.
Whole-span features score it: digit and group counts, checksum, separators, enclosing
characters, words in front.  Dynamic programming over segment ends chooses
boundaries and kinds jointly.  Base spans stay; the segments between them that
score above the empty labelling are added.

The weights are trained by conditional likelihood (forward-backward over
segmentations) on a bounded sample of documents: base spans are the truth, and
each is repeated in spellings that the rules miss (a phone without its plus, an
``at`` for ``@``, other separators).  A few fixed counter-examples (dates,
versions, amounts) are trained as empty.

Defined cases: a null text is empty and has no span.  Spans are half-open
ranges of code points.  Ties between segmentations go to the earlier, then the
longer segment.  Rows that repeat an id are looked at one by one.  Scanning is
linear in the text's length.  An empty table yields an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Any shape up to so many atoms; longer segments must have the shape of their kind.
MAX_ATOMS = 24
#: 19 digits written singly, with up to four separators after each.
MAX_NUMERIC = 19 * 5
#: A local part of 64 and a domain of 255, with all its dots and the at-sign spelled out.
MAX_CHARS = 64 + 255 + 127 * 6 + 6
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # starts only where a run of digits does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOT = r"(?:\.| ?[\[(] ?[dD][oO][tT] ?[\])] ?| [dD][oO][tT] )"
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?(?:[aA][tT]|[dD][oO][tT]) ?[\])]| [aA][tT] (?=[A-Za-z0-9-]{1,63}" + _DOT + "[A-Za-z0-9])")
_AT = re.compile(r"@| ?[\[(] ?[aA][tT] ?[\])] ?| [aA][tT] ")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63})+")
_SPELLED_DOT = re.compile(r"[\[( ]dot[\]) ]", re.I)
_NUMERIC = frozenset("0123456789+() .-")
_WHITE = re.compile(r"\s")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_FRONT = {
    "email": re.compile(r"mail|contact|write|@", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server", re.I),
    "card": re.compile(r"card|visa|master|credit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|cell", re.I),
}
#: Fixed counter-examples: none of these is personal data.
PLAIN = (
    "on 2024-01-15 at 10:30",
    "version 12.4.1 of 2021",
    "pages 120-135, 2nd ed.",
    "1,250,000 or 3.14159",
    "ISO 9001:2015 and RFC 2119",
    "order 20240115000123",
    "section 4.2.10.3.1 part 7",
    "look @ this, 5 of 10",
    "10 000 000 - 20 000 000",
    "2019-2020 2021-2022",
    "look at example.com for more",
    "we met at noon.Then all left",
    "she is good at dot painting",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules, by kind, then start."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str, reach: int = 24) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, within lines and up to white space, merged where they meet."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        hi = min(len(text), m.end() + reach)
        line = text.find("\n", m.end(), hi)
        hi = line if line >= 0 else hi
        if out and m.start() < out[-1][1] and hi <= out[-1][1]:
            continue  # every character is passed once, however many triggers a token has
        if not text[hi - 1].isspace():
            white = _WHITE.search(text, hi)
            hi = white.start() if white else len(text)
        lo = max(0, m.start() - reach)
        line = text.rfind("\n", lo, m.start())
        lo = line + 1 if line >= 0 else lo
        done = out[-1][1] if out else 0
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        if out and lo <= done:
            out[-1][1] = max(done, hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _plausible(kind: str, s: str) -> bool:
    """Hard limits of a candidate; everything softer is scored."""
    if kind == "email":
        return not s.startswith("@") and ("@" in s or "at" in s.lower()) and len(s) >= 6
    digits = _digits(s)
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if any(c not in _NUMERIC for c in s):
        return False
    if kind == "card":
        return "+" not in s and "(" not in s and 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and "+" not in s[1:]


N_FEATURES = 41


def span_features(kind: str, text: str, a: int, b: int) -> list[int]:
    """Indices of the whole-span features of ``text[a:b]`` as one segment."""
    s = text[a:b]
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[a - 1 : a], text[b : b + 1]
    out = [0]
    out.append(1 + min(len(digits) // 3, 6))  # 1..7
    out.append(8 + min(len(groups), 6))  # 8..14
    out.append(15 if s.startswith("+") else 16 if s.startswith("(") else 17 if s[0].isdigit() else 18)
    if before.isalnum() or before in ("_", "."):
        out.append(19)
    if after.isalnum() or after == "_":
        out.append(20)
    if after == "." and text[b + 1 : b + 2].isalnum():
        out.append(21)
    if before in ("+", "-", "/", "$", "#", "="):
        out.append(22)
    separators = {c for c in s if not c.isalnum() and c not in "+()"}
    out.append(23 + min(len(separators), 3))  # 23..26
    if 13 <= len(digits) <= 19 and luhn(digits):
        out.append(27)
    if len(groups) > 2 and len({len(g) for g in groups[:-1]}) == 1:
        out.append(28)
    if _FRONT[kind].search(text[max(0, a - 24) : a]):
        out.append(29)
    if kind == "email":
        out.append(30 if s.count("@") == 1 else 31)
        if re.fullmatch(r"[\w.%+-]+ ?(?:@|[\[(] ?at ?[\])]| at ) ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z0-9-]+)*(?:\.| ?[\[(]? ?dot ?[\])]? ?)[A-Za-z]{2,}", s, re.I):
            out.append(32)
        if " " in s and not re.search(r"[\[(] ?at ?[\])]", s, re.I):
            out.append(33)
        if _SPELLED_DOT.search(s):
            out.append(40)
    elif re.search(r"[ .()-]{3,}", s):
        out.append(34)
    if s.count("(") == 1 and re.search(r"\([0-9]{2,4}\)", s):
        out.append(35)
    if s.count("(") != s.count(")"):
        out.append(36)
    if not s[-1].isalnum() or not (s[0].isalnum() or s[0] in "+("):
        out.append(37)
    if re.match(r"(?:19|20)[0-9]{2}[-. ]", s):
        out.append(38)
    if len(groups) == 1:
        out.append(39)
    return out


def _candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, int, list[int]]]]:
    """Atom boundaries of a region and its plausible segments (first atom, end atom, kind, features)."""
    cuts = [m.start() for m in _ATOM.finditer(text, lo, hi)] + [hi]
    n = len(cuts) - 1
    out = []

    def numeric(a: int, b: int) -> bool:
        return b - a <= MAX_NUMERIC and _NUMERIC.issuperset(text[a:b]) and len(_digits(text[a:b])) <= 19

    for i in range(n):
        head = text[cuts[i]]
        if not (head.isalnum() or head in "+("):
            continue
        for j in range(i + 1, min(n, i + MAX_NUMERIC) + 1):
            if cuts[j] - cuts[i] > MAX_CHARS:
                break
            if j - i > MAX_ATOMS and not (set(text[cuts[j - 1] : cuts[j]]) <= _NUMERIC and numeric(cuts[i], cuts[j])):
                break
            if cuts[j] - cuts[i] < 6 or not text[cuts[j] - 1].isalnum():
                continue
            s = text[cuts[i] : cuts[j]]
            for k, kind in enumerate(KINDS):
                if _plausible(kind, s):
                    out.append((i, j, k, span_features(kind, text, cuts[i], cuts[j])))
    place = {c: x for x, c in enumerate(cuts)}
    long = set()
    for a, b in _addresses(text, lo, hi):
        i, j = place.get(a), place.get(b)
        if i is not None and j is not None and j - i > MAX_ATOMS:
            long.add((i, j))
    if long:
        out += [(i, j, 0, span_features("email", text, cuts[i], cuts[j])) for i, j in long]
        out.sort(key=lambda x: x[:3])
    return cuts, out


def _addresses(text: str, lo: int, hi: int):
    """Whole addresses, as far as they go to both sides of an at-sign or its spelling."""
    for m in _AT.finditer(text, lo, hi):
        a = m.start()
        while a > max(lo, m.start() - 64) and text[a - 1] in _LOCAL:
            a -= 1
        while a < m.start() and not text[a].isalnum():
            a += 1
        domain = _SPELLED_DOMAIN.match(text, m.end(), min(hi, m.end() + MAX_CHARS))
        if a < m.start() and domain:
            b = domain.end()
            while not text[b - 1].isalnum():
                b -= 1
            yield a, b


@dataclass
class SpanModel:
    weights: np.ndarray  # kinds x features

    def decode(self, text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
        """The best segmentation of one region."""
        cuts, segments = _candidates(text, lo, hi)
        if not segments:
            return []
        ending: dict[int, list] = {}
        for i, j, k, features in segments:
            ending.setdefault(j, []).append((i, k, float(self.weights[k, features].sum())))
        best = np.zeros(len(cuts))
        back: list[tuple[int, int] | None] = [None] * len(cuts)
        for j in range(1, len(cuts)):
            best[j] = best[j - 1]
            for i, k, score in ending.get(j, ()):
                if best[i] + score > best[j] + 1e-9:
                    best[j], back[j] = best[i] + score, (i, k)
        out, j = [], len(cuts) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((KINDS[k], cuts[i], cuts[j]))
                j = i
        return out[::-1]

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Segments outside the base spans."""
        taken: list[tuple[int, int]] = []  # disjoint
        for a, b in sorted((a, b) for _, a, b in base):
            if taken and a <= taken[-1][1]:
                taken[-1] = taken[-1][0], max(b, taken[-1][1])
            else:
                taken.append((a, b))
        out = []
        for lo, hi in regions(text):
            free = lo
            for a, b in [x for x in _within(taken, lo, hi)] + [(hi, hi)]:
                if a - free >= 6:
                    out += self.decode(text, free, min(a, hi))
                free = max(free, b)
        return out


def _within(spans: list[tuple[int, int]], lo: int, hi: int):
    """Those of the disjoint ``spans`` that meet ``lo`` to ``hi``."""
    k = bisect.bisect_right(spans, lo, key=lambda s: s[1])
    while k < len(spans) and spans[k][0] < hi:
        yield spans[k]
        k += 1


def _objective(weights: np.ndarray, examples: list) -> np.ndarray:
    """Gradient of the conditional log likelihood of the examples."""
    grad = np.zeros_like(weights)
    for n, segments, gold in examples:
        scores = [weights[k, f].sum() for _, _, k, f in segments]
        ahead, back = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for x, (i, j, _, _) in enumerate(segments):
            ahead[i].append(x)
            back[j].append(x)
        alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *[alpha[segments[x][0]] + scores[x] for x in back[j]]])
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *[beta[segments[x][1]] + scores[x] for x in ahead[i]]])
        for x, (i, j, k, f) in enumerate(segments):
            p = np.exp(min(0.0, alpha[i] + scores[x] + beta[j] - alpha[n]))
            grad[k, f] += (x in gold) - p
    return grad


def _spellings(kind: str, span: str) -> list[str]:
    """Other ways to write a span that the fixed rules miss or match alike."""
    if kind == "phone":
        bare = span.lstrip("+")
        return [bare, re.sub(r"^[0-9]{1,3} ", "", bare), re.sub(r"[ ()-]+", "-", bare), re.sub(r"[ ()-]+", ".", bare)]
    if kind == "email":
        name, _, domain = span.partition("@")
        return [
            f"{name} [at] {domain}",
            f"{name}(at){domain}",
            f"{name} at {domain.replace('.', ' dot ')}",
            f"{name} [at] {domain.replace('.', ' [dot] ')}",
        ]
    if kind == "card":
        digits = _digits(span)
        return ["-".join(digits[i : i + 4] for i in range(0, len(digits), 4)), " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return []


def train_spans(texts: list[str], most: int = 400, steps: int = 60, ridge: float = 0.02) -> SpanModel:
    """Weights from the base spans of ``texts``, at most ``most`` examples a kind."""
    marked: list[tuple[str, list[tuple[str, int, int]]]] = [(t, []) for t in PLAIN]
    seen = dict.fromkeys(KINDS, 0)
    plain = 0
    for text in texts:
        base = base_spans(text)
        for lo, hi in regions(text):
            own = [(k, a, b) for k, a, b in base if a >= lo and b <= hi]
            snippet = text[lo:hi]
            if not own and plain < most:
                plain += 1
                marked.append((snippet, []))
            for kind, a, b in own[:1]:
                if seen[kind] < most and len(own) == 1:
                    seen[kind] += 1
                    front, rear = text[lo:a], text[b:hi]
                    for s in [text[a:b], *_spellings(kind, text[a:b])[seen[kind] % 4 :: 4]]:
                        marked.append((front + s + rear, [(kind, len(front), len(front) + len(s))]))
    examples = []
    for snippet, gold in marked:
        cuts, segments = _candidates(snippet, 0, len(snippet))
        want = {(a, b, KINDS.index(k)) for k, a, b in gold}
        hits = {x for x, (i, j, k, _) in enumerate(segments) if (cuts[i], cuts[j], k) in want}
        if segments and len(hits) == len(want):
            examples.append((len(cuts) - 1, segments, hits))
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -2.0
    if not examples:
        return SpanModel(weights - 100.0)  # nothing to learn from: nothing is added
    g1, g2 = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        grad = _objective(weights, examples) / len(examples) - ridge * weights / len(examples)
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        weights = weights + 0.2 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
    return SpanModel(weights)


def fit_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_sample: int = 1500) -> SpanModel:
    """Train on a bounded sample: of the texts with an at-sign or six digits in a row or a plus, those with the smallest hash.

    The sample holds regions, not whole texts: at most eight of each.
    """
    text = F.col(f"`{text_col}`")
    some = docs.filter(text.rlike(r"@|[0-9]{6}|\+[0-9]")).select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    ids = some.select("id", F.xxhash64(F.lit(3), "id", "text").alias("h")).orderBy("h", "id").limit(max_sample)

    def cut(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                out.append([t[a:b] for a, b in regions(t)[:8]])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["parts"])

    picked = some.withColumn("h", F.xxhash64(F.lit(3), "id", "text")).join(F.broadcast(ids.select("h").distinct()), "h")
    rows = picked.select("text").mapInArrow(cut, "parts array<string>").collect()  # at most max_sample rows
    return train_spans(sorted(p for r in rows for p in r.parts))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def find_personal_data(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``base`` and ``added`` spans (array of kind, start, end)."""
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                if not text or not _TRIGGER.search(text):
                    base.append([])
                    added.append([])
                    continue
                found = base_spans(text)
                more = shared.value.added(text, found)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                added.append([{"kind": k, "start": a, "end": b} for k, a, b in more])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span), pa.array(added, span)], names=[id_col, "base", "added"]
            )

    kind = texts.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return texts.mapInArrow(run, f"`{id_col}` {kind}, base {spans}, added {spans}")


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    """Lower-case hex SHA-256 of the joined spans (the empty text without any)."""
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
