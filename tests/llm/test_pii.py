import hashlib
import itertools
import re
import time

from gapweave.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The patterns as they stand."""
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


ODD = ["", "@", "a@b.c@d.e", "x@y z@q.com.", "1.2.3.4.5.6.7.8", "300.1.1.1 001.2.3.255", "4111 1111-1111 1111 4111111111111111", "+1 (555) 010-9999 +49.30.123", "++1 2 3", "é@a.b ü1.2.3.4", "a" * 30 + "@", "1" * 40, "a.b@c-d.e-f..g@h.i", "+1(2)3456789()"]


def test_base_equals_patterns():
    import random

    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice(["@", ".", "1", "25", "a", "-", " ", "+", "(", ")", "4111", "é", "com"]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_long_texts_take_linear_time():
    t0 = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 60_000, "1 " * 15_000, "a@b.co x " * 110_000, "1.2.3.4 " * 30_000, "x at y. " * 10_000):
        pii.all_spans(pii.fit(), t)
    assert time.time() - t0 < 240


def test_stretches_lose_no_candidate():
    """All candidates of the whole text lie in one of its stretches."""
    import random

    rng = random.Random(4)
    bits = ["@", ".", "1", "25", "a", "-", " ", "+", "(", ")", "4111", "é", "com", " at ", " [AT] ", " dot ", "\n", ",", "/", "mail", "x" * 70, " Dot "]
    for text in [t for t, _ in pii.examples(seed=9, n=150)] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 90))) for _ in range(1500)]:
        want = {(toks[i][0], toks[j - 1][1], k) for toks, cands in [pii.candidates(text, 0, len(text))] for i, j, k in cands}
        got = {(toks[i][0], toks[j - 1][1], k) for lo, hi in pii.stretches(text) for toks, cands in [pii.candidates(text, lo, hi)] for i, j, k in cands}
        assert want == got, (text, want ^ got)


def test_dynamic_program_is_exact():
    """Viterbi equals the best of all sets of candidates that don't overlap."""
    field = pii.fit()
    for text, _ in pii.examples(seed=77, n=60):
        tokens, cands = pii.candidates(text, 0, len(text))
        scored = [(float(pii.features(text, tokens[i][0], tokens[j - 1][1], k) @ field.w[pii.KINDS.index(k)]), i, j) for i, j, k in cands]
        good = [c for c in scored if c[0] > 0][:12]
        if len(good) < len([c for c in scored if c[0] > 0]):
            continue
        best = max((sum(c[0] for c in some) for n in range(len(good) + 1) for some in itertools.combinations(good, n) if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(some, 2))), default=0)
        got = field.spans(text, 0, len(text), [])
        at = {(tokens[i][0], tokens[j - 1][1], k): float(pii.features(text, tokens[i][0], tokens[j - 1][1], k) @ field.w[pii.KINDS.index(k)]) for i, j, k in cands}
        assert abs(sum(at[s, e, k] for k, s, e in got) - best) < 1e-9


def test_held_out_spans():
    field, hit, found, true = pii.fit(), 0, 0, 0
    for text, spans in pii.examples(seed=5, n=300):
        got = field.spans(text, 0, len(text), [])
        hit += len(set(got) & set(spans))
        found, true = found + len(got), true + len(spans)
    assert hit / found > 0.9 and hit / true > 0.85, (hit, found, true)


def test_added_spans():
    field = pii.fit()
    kinds = lambda t: [k for k, *_ in pii.all_spans(field, t)[1]]
    assert kinds("write to ther.lo [at] esmi [dot] com today") == ["email"]
    assert kinds("call (555) 201-4477, please") == ["phone"]
    assert kinds("it was 2024-05-17 in v1.20.3 at 10:20:30") == []
    base, added = pii.all_spans(field, "call +1 (555) 201-4477")
    assert [k for k, *_ in base] == ["phone"] and added == []


def test_table(spark):
    data = [(1, None), (2, ""), (2, ""), (None, "mail x.y@z.com now"), (3, "é 10.0.0.1 or (555) 201-4477"), (4, "w " * 5000 + "a@b.co")]
    df = spark.createDataFrame([(*r, 5, 0) for r in data], "doc_id long, text string, spans int, n_chars long")
    rows = pii.find(df, pii.fit()).collect()
    assert len(rows) == 6
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in rows}
    assert by == {1: [], 2: [], None: [("email", 5, 14)], 3: [("ip", 2, 10)], 4: [("email", 10000, 10006)]}
    red = {r.doc_id: (r.text, r.n_chars, r.spans) for r in pii.redact(df, pii.fit()).collect()}
    assert red[None] == ("mail <EMAIL> now", 16, 5) and red[1][0] is None and red[3][0] == "é <IP> or <PHONE>"
    assert pii.find(df.limit(0)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pii.op7_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        want = plain(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]


def test_capitals_and_long_local_parts():
    field = pii.fit()
    added = lambda t: [(k, t[s:e]) for k, s, e in pii.all_spans(field, t)[1]]
    assert added("write to Ther.Lo [AT] Esmi [DOT] com today") == [("email", "Ther.Lo [AT] Esmi [DOT] com")]
    long = "therlomi.eskation.urtherka.mianlo"
    assert added(f"write to {long} [at] esmi [dot] com today") == [("email", f"{long} [at] esmi [dot] com")]
    for t in (f"x {long} at esmi.com y", f"{'an ' * 40}{long} (AT) esmi (DOT) org{' an' * 40}"):
        whole = {t[a:b] for lo, hi in pii.stretches(t) for toks, cands in [pii.candidates(t, lo, hi)] for i, j, _ in cands for a, b in [(toks[i][0], toks[j - 1][1])]}
        tokens, cands = pii.candidates(t, 0, len(t))
        assert cands and {t[tokens[i][0] : tokens[j - 1][1]] for i, j, _ in cands} == whole
