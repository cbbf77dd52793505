import math
import random

from gapweave.llm import topk


def brute(rows, every, k):
    vs = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, u in vs:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in vs if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def run(df, every, k):
    v = topk.whole_numbers(df, 256)
    q = v.filter(f"vec_id % {every} = 0").selectExpr("vec_id as query_id", "v").dropDuplicates(["query_id", "v"])
    return {tuple(r) for r in topk.top_k(v, q, k).collect()}


def test_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.0]) for _ in range(6)]) for i in range(300)]
    rows += [(600, None), (650, [0.1, None]), (700, [nan] * 6), (750, [inf] * 6), (None, [0.1] * 6), (800, []), (850, [1.0]), (900, [1e9, -1e9, 3.5e8, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    want = brute(rows, 10, 5)
    assert run(df, 10, 5) == want
    for name, value in {"SHARD_ROWS": 20, "BLOCK_QUERIES": 7, "LEAF_ROWS": 4, "MOST_PIVOTS": 6, "NEXT": 2, "BLOCK_SHARDS": 5}.items():
        monkeypatch.setattr(topk, name, value)
    assert run(df, 10, 5) == want
    assert run(df.filter("vec_id in (10, 20, 21)"), 10, 5) == brute([r for r in rows if r[0] in (10, 20, 21)], 10, 5)
    assert run(df.limit(0), 10, 5) == set()


def test_pruning_skips_nodes(monkeypatch):
    """Clustered rows: most nodes fall to the bound."""
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1000, (40, 16))
    x = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 5, (4000, 16)))
    monkeypatch.setattr(topk, "LEAF_ROWS", 16)
    tree = topk.BallTree(x, np.arange(4000))
    seen = []
    s = topk.Search(x[:50], np.arange(50), np.full(50, -np.inf), 5)
    scan = s.scan
    s.scan = lambda t, leaf, rows: (seen.append(len(leaf) * len(rows)), scan(t, leaf, rows))
    s.visit(tree, tree.root, np.arange(50))
    assert sum(seen) < 0.3 * 50 * 4000
