"""Personal data: exact patterns, and spans that a semi-Markov conditional random field adds.

The base patterns are matched leftmost and without overlap within a kind, in time linear in the text; matches that fail
their check are dropped and not tried again.  The field works on stretches: runs of number characters, and MOST_TOKENS tokens on either
side of an address's at sign, in capitals or not, so every span that it has features for lies whole in one.
It scores whole candidate spans of at most MOST_TOKENS tokens by features of the span (digits, groups, separators,
checksums, its neighbours) and one dynamic program picks the best set of boundaries and kinds; base spans
are fixed and added ones never overlap them; of equal scores the one that leaves a token outside comes first, then the span that starts first.  Its weights are fitted by gradient ascent on the conditional likelihood
of generated stretches in which spans and look-alikes are known (seeded; no table is read).

Null text counts as empty, which has no spans; offsets are code points, ends exclusive; repeated rows give repeated rows; an
empty table gives none; other columns are ignored by find() and kept by redact().
"""
from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, kept, lean

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 16
ROWS = 1024

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\d")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# -- the field ------------------------------------------------------------------------------------

AT = re.compile(r"@|[\[({<] ?at ?[\])}>]|(?<=\w) at (?=\w)", re.I)
DOT = re.compile(r"\.|[\[({<] ?dot ?[\])}>]|(?<=\w) dot (?=\w)", re.I)
ADDRESS = re.compile(r"[^\W_][\w.+ \[\](){}<>@-]*[^\W_]$")
NUMBER = re.compile(r"[+(]?[0-9][0-9 ().\-/]*[0-9]$")
#: The same in a form that is quick to rule out; what can't stand in an address; characters of numbers, the fewest that a candidate has.
AT_WORD = re.compile(r"[aA][tT][ \])}>]")
NO_ADDRESS = re.compile(r"[^\w.+ \[\](){}<>@-]")
RUN = re.compile(r"[0-9][0-9 ().\-/]{6,}")
GROUP = re.compile(r"[0-9]+")
CUES = {"email": {"mail", "email", "contact", "write"}, "ip": {"ip", "host", "server", "address"}, "card": {"card", "visa", "pay", "credit"}, "phone": {"call", "phone", "tel", "mobile", "fax"}}
FEATURES = 20


def candidates(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, str]]]:
    """Tokens of the stretch, and (first, last + 1, kind) of the spans that some feature can favour."""
    tokens = [m.span() for m in TOKEN.finditer(text, lo, hi)]
    ats = [m.span() for m in AT.finditer(text, lo, hi)]
    at_starts = [a for a, _ in ats]
    out = []
    for i, (s, _) in enumerate(tokens):
        first = text[s]
        if not (first.isalnum() or first in "+(") or s and text[s - 1].isalnum() and first.isalnum():
            continue
        most = min(i + MOST_TOKENS, len(tokens))
        k = bisect.bisect_right(at_starts, s)
        at_end = ats[k][1] if k < len(ats) else hi + 1  # of the first sign that can lie in an address from here
        number = first in "+(" or first in "0123456789"
        address = at_end <= tokens[most - 1][1] and first not in "+("
        for j in range(i + 1, most + 1 if number or address else 0):
            e = tokens[j - 1][1]
            if not text[e - 1].isalnum() or e < len(text) and text[e].isalnum():
                continue
            span = text[s:e]
            if "\n" in span:
                break
            if number:
                if NUMBER.match(span):
                    n = len(_digits(span))
                    if n > 19:
                        break
                    if 7 <= n <= 15:
                        out.append((i, j, "phone"))
                    if n >= 13:
                        out.append((i, j, "card"))
                    if 4 <= n <= 12 and len(re.findall("[0-9]+", span)) == 4:
                        out.append((i, j, "ip"))
                    continue
                if not address and text[e - 1] not in "0123456789":
                    break  # no longer span is a number
            if address and at_end <= e and ADDRESS.match(span) and DOT.search(span, at_end - s):
                out.append((i, j, "email"))
    return tokens, out


def features(text: str, s: int, e: int, kind: str) -> np.ndarray:
    span = text[s:e]
    groups = re.findall("[0-9]+", span)
    n = sum(map(len, groups))
    seps = {c for c in span if not c.isalnum()}
    before = re.search(r"(\w+)\W*$", text[max(0, s - 24) : s])
    tail = re.search(r"[^\W\d_]+$", span)
    at, rest = AT.search(span), ""
    if at:
        rest = span[at.end() :]
    plain = bool(at) and at[0] != "@"
    f = np.zeros(FEATURES)
    f[0] = 1
    f[1] = bool(before) and before[1].lower() in CUES[kind]
    f[2] = text[s - 1 : s] in ("", " ", "\n", "\t", ":", "(", '"')
    f[3] = text[e : e + 1] in ("", " ", "\n", "\t", ".", ",", ")", '"', "%", "#", "&", "$", "*")
    if kind == "email":
        f[4] = at[0] == "@"
        f[5] = plain and at[0][0] != " "
        f[6] = plain and at[0][0] == " " and bool(re.search(r"\bdot\b", rest, re.I))
        f[7] = bool(tail) and 2 <= len(tail[0]) <= 4
        f[8] = len(rest.split()) > 2 * len(DOT.findall(rest)) + 1
        f[9] = " " in span[: at.start()].strip()
        f[10] = len(DOT.findall(rest)) in (1, 2, 3)
        f[11] = plain and at[0][0] == " " and not re.search(r"\bdot\b", rest, re.I)
    else:
        f[4] = n >= 13 and luhn("".join(groups))
        f[5] = n in (10, 11)
        f[6] = 12 <= n <= 15
        f[7] = n < 10
        f[8] = len(groups) in (3, 4)
        f[9] = len(groups) == 4 and len({len(g) for g in groups}) == 1 and len(groups[0]) == 4
        f[10] = bool(groups) and len(groups[-1]) == 4 and len(groups) > 1
        f[11] = len(groups) == 1
        f[12] = "(" in seps and ")" in seps
        f[13] = ("(" in seps) != (")" in seps)
        f[14] = len(groups) == 4 and all(int(g) <= 255 for g in groups)
        f[15] = seps == {"."}
        f[16] = "/" in seps
        f[17] = len(groups) == 3 and [len(g) for g in groups] in ([4, 2, 2], [2, 2, 4])
        f[18] = span[0] == "+"
        f[19] = bool(groups) and [len(g) for g in groups[-3:]] == [3, 3, 4]
    return f


class Field:
    """Weights by kind; the score of a span is its features times its kind's weights, of a token outside 0."""

    def __init__(self, weights: np.ndarray):
        self.w = weights

    def spans(self, text: str, lo: int, hi: int, fixed: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """fixed: disjoint spans in order, which no other may overlap."""
        tokens, cands = candidates(text, lo, hi)
        if fixed:
            ends = [b for _, b in fixed]
            free = lambda a, b: (k := bisect.bisect_right(ends, a)) == len(fixed) or fixed[k][0] >= b
            cands = [c for c in cands if free(tokens[c[0]][0], tokens[c[1] - 1][1])]
        if not cands:
            return []
        n = len(tokens)
        ending: dict[int, list] = {}
        for i, j, kind in cands:
            x = features(text, tokens[i][0], tokens[j - 1][1], kind)
            ending.setdefault(j, []).append((i, kind, float(x @ self.w[KINDS.index(kind)])))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for e in range(1, n + 1):
            best[e] = best[e - 1]
            for i, kind, score in ending.get(e, ()):
                if best[i] + score > best[e]:
                    best[e], back[e] = best[i] + score, (i, kind)
        out, e = [], n
        while e:
            if back[e]:
                i, kind = back[e]
                out.append((kind, tokens[i][0], tokens[e - 1][1]))
                e = i
            else:
                e -= 1
        return out[::-1]


def examples(seed: int = 11, n: int = 500) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated stretches with their spans: usual and unusual spellings, among look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "ther", "lo", "mi", "es", "ka", "tion", "ur"]) for _ in range(rng.randint(1, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", " ", "-", ".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00 {num(2)} {a} {b} {c}"])

    def mail() -> str:
        host = [word(), rng.choice(["com", "org", "net", "de", "io"])]
        at, dot = rng.choice([("@", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) ")])
        return f"{word()}{rng.choice(['', '.' + word(), num(2)])}{at}{dot.join(host)}"

    make = {"email": mail, "ip": lambda: rng.choice([".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    alike = [
        lambda: f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", lambda: f"v{num(1)}.{num(2)}.{num(1)}", lambda: num(rng.choice([4, 7, 8, 9, 12, 14, 16, 18])), lambda: f"{num(3)}.{num(2)} {num(3)}.{num(2)}",
        lambda: f"{word()} at {word()}", lambda: f"{word()} at {word()}. {word()}", lambda: f"{num(2)}/{num(2)}/20{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(1)} {num(2)} {num(1)} {num(2)} {num(3)}",
        lambda: f"9{num(2)}.4{num(2)}.{num(3)}.5{num(2)}", lambda: f"{num(4)} {num(4)}", lambda: f"dot {word()} dot {word()}", lambda: f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: "-".join([num(4)] * 2), lambda: f"{num(3)}-{num(4)}", lambda: "token = \"" + "".join(rng.choice("0123456789abcdef") for _ in range(24)) + '"',
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 5)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ", ", ": ", ".\n"])
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                if rng.random() < 0.2:
                    text += rng.choice(sorted(CUES[kind])) + " "
                got = make[kind]()
                spans.append((kind, len(text), len(text) + len(got)))
                text += got
            else:
                text += rng.choice(alike)()
            text += rng.choice([" ", ", ", ". ", "\n", "%%% "])
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=1)
def fit(rounds: int = 30, rate: float = 0.5, decay: float = 2e-3) -> Field:
    """Gradient ascent (Adagrad) on the conditional log-likelihood, by forward and backward sums over segmentations."""
    data = []
    for text, spans in examples():
        tokens, cands = candidates(text, 0, len(text))
        kinds = np.array([KINDS.index(k) for _, _, k in cands], int)
        x = np.array([features(text, tokens[i][0], tokens[j - 1][1], k) for i, j, k in cands]).reshape(len(cands), FEATURES)
        gold = {(k, s, e) for k, s, e in spans}
        y = np.array([(k, tokens[i][0], tokens[j - 1][1]) in gold for i, j, k in cands], float)
        if len(cands):
            data.append((len(tokens), [(i, j) for i, j, _ in cands], kinds, x, y))
    w = np.zeros((len(KINDS), FEATURES))
    seen = np.full_like(w, 1e-8)
    for _ in range(rounds):
        grad = -decay * len(data) * w
        for n, ends, kinds, x, y in data:
            score = (x * w[kinds]).sum(1)
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0.0
            at: list[list[int]] = [[] for _ in range(n + 1)]
            start: list[list[int]] = [[] for _ in range(n + 1)]
            for c, (i, j) in enumerate(ends):
                at[j].append(c)
                start[i].append(c)
            for e in range(1, n + 1):
                ahead[e] = ahead[e - 1]
                for c in at[e]:
                    ahead[e] = np.logaddexp(ahead[e], ahead[ends[c][0]] + score[c])
            for s in range(n - 1, -1, -1):
                behind[s] = behind[s + 1]
                for c in start[s]:
                    behind[s] = np.logaddexp(behind[s], score[c] + behind[ends[c][1]])
            p = np.exp(np.array([ahead[i] for i, _ in ends]) + score + np.array([behind[j] for _, j in ends]) - ahead[n])
            np.add.at(grad, kinds, (y - p)[:, None] * x)
        seen += grad**2
        w += rate * grad / np.sqrt(seen)
    return Field(w)


def _left(text: str, at: int) -> int:
    """Where the MOST_TOKENS tokens before `at` begin, or what can stand in an address does."""
    wide = 64
    while True:
        lo = max(0, at - wide)
        for m in NO_ADDRESS.finditer(text, lo, at):
            lo = m.end()
        tokens = [m.start() for m in TOKEN.finditer(text, lo, at)]
        if len(tokens) > MOST_TOKENS:
            return tokens[-MOST_TOKENS]
        if lo == 0 or lo > at - wide:
            return lo
        wide *= 2


def stretches(text: str) -> list[tuple[int, int]]:
    """What a field can find something in, in order and apart: runs of number characters with enough digits or groups, and up to
    MOST_TOKENS tokens on either side of an at sign, however written, that a dot follows.  Every candidate lies whole in one."""
    found = []
    for m in RUN.finditer(text):
        groups = GROUP.findall(m[0])
        if len(groups) >= 4 or sum(map(len, groups)) >= 7:
            found.append((m.start() - (text[m.start() - 1 : m.start()] in ("+", "(")), m.end()))
    if "@" in text or AT_WORD.search(text):
        for m in AT.finditer(text):
            hi = m.end()
            for t in itertools.islice(TOKEN.finditer(text, hi), MOST_TOKENS):
                hi = t.end()
            stop = NO_ADDRESS.search(text, m.end(), hi)
            hi = stop.start() if stop else hi
            if DOT.search(text, m.end(), hi):
                found.append((_left(text, m.start()), hi))
    out: list[list[int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def all_spans(field: Field, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added ones, in time linear in the text (but for the order of few spans)."""
    if not text:
        return [], []
    base = base_spans(text)
    fixed: list[tuple[int, int]] = []  # disjoint
    for s, e in sorted((s, e) for _, s, e in base):
        if fixed and s < fixed[-1][1]:
            fixed[-1] = (fixed[-1][0], max(e, fixed[-1][1]))
        else:
            fixed.append((s, e))
    starts, ends = [s for s, _ in fixed], [e for _, e in fixed]
    added = []
    for lo, hi in stretches(text):
        added += field.spans(text, lo, hi, fixed[bisect.bisect_right(ends, lo) : bisect.bisect_left(starts, hi)])
    return base, added


def find(df: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<kind, start, end, base>> of each row, by kind and start."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    lean(df.sparkSession)
    sent, name = df.sparkSession.sparkContext.broadcast(field or fit()), f"pii-{uuid.uuid4().hex}"
    kind_type = "array<struct<kind: string, start: int, end: int, base: boolean>>"

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        own = kept(name, lambda: sent.value)
        for part in chunks(batches, 1, ROWS):
            out = []
            for t in part.column(1).to_pylist():
                base, added = all_spans(own, t)
                both = [(KINDS.index(k), s, e, True) for k, s, e in base] + [(KINDS.index(k), s, e, False) for k, s, e in added]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": x} for k, s, e, x in sorted(both)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, item)], names=["key", "spans"])

    return rows.mapInArrow(go, f"key {rows.schema['key'].dataType.simpleString()}, spans {kind_type}").withColumnRenamed("key", key)


def redact(df: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """df with each span of its text replaced by its kind in angle brackets; n_chars, if there, counts anew."""
    lean(df.sparkSession)
    sent, name = df.sparkSession.sparkContext.broadcast(field or fit()), f"pii-{uuid.uuid4().hex}"
    at = df.columns.index(text)

    def one(t: str | None) -> str | None:
        base, added = all_spans(kept(name, lambda: sent.value), t)
        if not base and not added:
            return t
        out, last = [], 0
        for s, e, k in sorted((s, -e, k) for k, s, e in base + added):
            e = -e
            if e <= last:
                continue
            if s >= last:
                out += [t[last:s], f"<{k.upper()}>"]
            last = e
        return "".join(out) + t[last:]

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in chunks(batches, at, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([one(t) for t in c.to_pylist()], c.type) if k == at else c for k, c in enumerate(part.columns)], schema=part.schema)

    out = df.mapInArrow(go, df.schema)
    return out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("spans", lambda x: x.base)
    count = lambda kind: F.size(F.filter("spans", lambda x: x.base & (x.kind == kind))).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
