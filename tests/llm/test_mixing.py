import re
from collections import Counter, defaultdict
from fractions import Fraction

from gapweave.llm import mixing


def test_targets():
    t = mixing.targets({"b": 10, "a": 1, None: 1000})
    assert t["a"] == 3 and sum(t.values()) == 1011 and t["b"] == 30 and t[None] == 978
    assert mixing.targets({}) == {}
    assert mixing.targets({"x": 0, "y": 5}) == {"x": Fraction(0), "y": Fraction(5)}


def plain_targets(size):
    """Water-filling by halving the level: each source gets its weight times a level, three times its words at most."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 3.0 * sum(size.values()) + 1
    for _ in range(200):
        level = (lo + hi) / 2
        if sum(min(3.0 * size[s], weight[s] * level) for s in size) < sum(size.values()):
            lo = level
        else:
            hi = level
    return {s: min(3.0 * size[s], weight[s] * hi) for s in size}


def plain_takings(docs, target, close):
    """docs: (hash, size) of a source.  Whether each is taken beyond the whole copies, by sorting: prefixes of what fits, again and again."""
    total = sum(n for _, n in docs)
    left = round(target, 6) // 1 - (target // total * total if total else 0)
    taken, first = set(), True
    while left > close * target:
        cap = left if not first else float("inf")
        groups = defaultdict(list)
        for i, (u, n) in enumerate(docs):
            if i not in taken and 0 < n <= cap:
                groups[u].append(i)
        before, stopped = left, False
        for u in sorted(groups):
            n = sum(docs[i][1] for i in groups[u])
            if n > left:
                stopped = True
                break
            taken.update(groups[u])
            left -= n
        if not stopped or left == before and not first:
            break
        first = False
    return [int(target // total if total else 0) + (i in taken) for i in range(len(docs))]


def check(rows, docs, hashes):
    """rows of counted() against the plain versions; docs: (id, text, source), hashes: the hash of each."""
    size, own = Counter(), defaultdict(list)
    for (_, text, source), u in zip(docs, hashes, strict=True):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        size[source] += n
        own[source].append((u, n))
    goal = plain_targets(dict(size))
    got = defaultdict(list)
    for r in rows:
        assert r["copies"] <= 3 and r["source_size"] == size[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-3
        got[r["source"]].append((r["size"], r["copies"]))
    exact = {r["source"]: r["target"] for r in rows}
    took = {}
    for s in size:
        assert sorted(got[s]) == sorted((n, k) for (_, n), k in zip(own[s], plain_takings(own[s], exact[s], mixing.CLOSE), strict=True))
        took[s] = sum(n * k for n, k in got[s])
        assert took[s] <= goal[s] + 1e-3
    return took, goal


def hashes(df):
    return [r.u for r in df.select(mixing.hash_of().alias("u")).collect()]


def test_mix(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.counted(docs).collect()
    took, goal = check(rows, [tuple(r) for r in docs.collect()], hashes(docs))
    assert all(goal[s] - took[s] <= 0.03 * goal[s] + 2 for s in goal)
    again = mixing.counted(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_odd_rows(spark):
    data = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "x " * 5000, "b"), (4, "one", "b"), (4, "one", "b"), (5, "w " * 40, None), (6, "\x1c é z", "")]
    df = spark.createDataFrame([(*x, 9, "k") for x in data], "doc_id long, text string, source string, size int, key string")
    rows = mixing.counted(df).collect()
    assert len(rows) == len(data)
    check(rows, data, hashes(df))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.counted(df.limit(0)).count() == 0
