import random
import re

import numpy as np
import pytest

from gapweave.llm import jaccard
from gapweave.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def brute(rows, k=3, percent=90):
    """(doc_id, size, component) by comparing all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))
    lists = {}
    for i, s in enumerate(sets):
        seen = set()
        for x in s:
            for j in lists.setdefault(x, []):
                if j not in seen:
                    seen.add(j)
                    if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                        a, b = find(root, i), find(root, j)
                        root[max(a, b)] = min(a, b)
            lists[x].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(root, i)
        low[r] = d if low.get(r) is None else min(low[r], d) if d is not None else low[r]
    return sorted(((d if d is not None else -1), len(sets[i]), low[find(root, i)] if low[find(root, i)] is not None else -1) for i, (d, _) in enumerate(rows))


def got(df, **kw):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.linked_components(df, **kw).collect())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1090)] + [(5, 5)]
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = find(root, a), find(root, b)
            root[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {n: find(root, n) for n in root} and len(rows) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps():
    for s in range(1, 80):
        for t in range(1, 80):
            least = min(o for o in range(1, 200) if 100 * o >= 90 * (s + t - o))
            assert jaccard.needed(s, t) == least
            assert (least <= min(s, t)) == (t in jaccard.partners(s))


@pytest.fixture
def tight(monkeypatch):
    for k, v in {"HEAVY": 2, "LONG_LIST": 3, "BLOCK": 4}.items():
        monkeypatch.setattr(jaccard, k, v)


def variants(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in (3, 10, 12, 13, 21, 24, 32, 41, 70, 120, 400):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = [rng.choice(words)] if rng.random() < 0.7 else []
            rows.append((rng.randrange(10_000), (" " if rng.random() < 0.9 else "\n ").join(w)))
    common = " ".join(words[:60])
    rows += [(rng.randrange(10_000), common + " " + " ".join(rng.choice(words) for _ in range(rng.choice([4, 8, 90])))) for _ in range(25)]
    rows += [(20_000, None), (20_001, ""), (20_002, "One"), (20_003, "one"), (20_004, "one Two"), (20_004, "ONE two"), (None, "one two"), (None, "alone here now"), (20_005, "É é x"), (20_006, "x " * 3000), (20_007, "x " * 4000), (20_008, "a\x1cb c\xa0d e\tf")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, tight, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDE", seed - 1)  # by the first class alone, or from two blocks on
    rows = variants(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, c int")
    assert got(df) == brute(rows)


def test_boundary_never_matters(spark, monkeypatch):
    rows = variants(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for b in (0, 24):
        monkeypatch.setattr(jaccard, "boundary", lambda *_, b=b: b)
        assert got(df) == brute(rows)
    assert got(df, words=5, percent=80) == brute(rows, 5, 80)
    assert got(df.limit(0)) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


def test_frequent_token_connects_nothing(spark, tight, monkeypatch):
    """Long lists of texts that share a few words only: no candidates; near copies among them are found across blocks."""
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 4)
    rng = random.Random(5)
    rows = [(i, "a b c " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.choice([20, 22, 600])))) for i in range(40)]
    rows += [(100 + i, text + " more") for i, text in rows[::4]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    common = jaccard.shingler(3).sets(["a b c"])[0]
    prefix = lambda s: [int(common[0]), *(int(x) for x in s[s != common[0]][: jaccard.prefix_length(len(s)) - 1])]  # noqa: E731  as if the order had it first
    sets = jaccard.shingler(3).sets([t for _, t in rows])
    classes = [(i, len(s), prefix(s), jaccard._parity(s).tolist(), jaccard._parity(s, jaccard.BIG).tolist() if len(s) >= jaccard.BIG_FROM else None) for i, s in enumerate(sets)]
    found = jaccard._candidates(spark.createDataFrame(classes, "c long, n long, prefix array<long>, sig array<long>, big array<long>"), 90)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()} == {(4 * i, 40 + i) for i in range(10)}
    assert got(df) == brute(rows)


def test_forest():
    rng = random.Random(3)
    base = [[rng.getrandbits(63) for _ in range(k)] for k in (30, 30, 700)]
    sets = [np.array(sorted(b[: len(b) - d] + [rng.getrandbits(63) for _ in range(d)]), np.int64) for b in base for d in (0, 1, 1, 0)]
    args = np.array([len(s) for s in sets]), np.stack([jaccard._parity(s) for s in sets]), [jaccard._parity(s, jaccard.BIG) if len(s) >= jaccard.BIG_FROM else None for s in sets]
    for first in (0, 6):
        root = list(range(len(sets)))
        for a, b in jaccard.forest(*args, first):
            assert not first or a < first <= b
            x, y = find(root, a), find(root, b)
            assert x != y
            root[max(x, y)] = min(x, y)
        group = [find(root, i) for i in range(len(sets))]
        assert group == ([i // 4 * 4 for i in range(12)] if not first else [0, 1, 2, 3, 4, 4, 4, 4, 8, 9, 10, 11])


def test_frequent_tokens_reach_the_driver_as_arrays(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from gapweave.llm.common import longs

    sent, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("rows"))
    monkeypatch.setattr(DataFrame, "collect", lambda self: [got := collect(self), sent.append(len(got))][0])
    docs = spark.range(jaccard.HEAVY + 8).selectExpr("id AS doc_id", "concat('a b c d e f g h ', id) AS text")
    heavy = jaccard._heavy(docs, 3, 10)
    tokens = [t for (t,) in collect(jaccard._tokens(docs, 3, 10).groupBy("token").count().filter(f"count > {jaccard.HEAVY}").select("token"))]
    assert heavy.tolist() == sorted(tokens) and len(tokens) > 1
    n = spark.range(0, 50_000, 1, 3)
    assert longs(n.selectExpr("25000 - id")).tolist() == list(range(-24_999, 25_001)) and max(sent) <= 8
    assert longs(n.limit(0)).tolist() == []
