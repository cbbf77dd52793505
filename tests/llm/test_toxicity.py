import numpy as np

from gapweave.llm import toxicity as tox


def test_gradient():
    """Against finite differences, in double precision."""
    net = tox.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    old, tox.F32 = tox.F32, np.float64
    try:
        words = ["alpha", "be", "scum", "été"]
        lex = tox.Lexicon.of(words)
        rng = np.random.default_rng(0)
        ids = rng.integers(0, 4, (5, 3))
        mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
        y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])

        def loss():
            s = net.logits(net.project(net.embed(lex)), ids, mask).astype(float)
            return float((weight * (np.log1p(np.exp(s)) - y * s)).sum())

        g = net.gradient(lex, ids, mask, y, weight)
        for k in net.p:
            flat, grad = net.p[k].reshape(-1), np.asarray(g[k]).reshape(-1)
            for i in np.argsort(-np.abs(grad))[:4]:
                at = flat[i]
                flat[i] = at + 1e-5
                up = loss()
                flat[i] = at - 1e-5
                down = loss()
                flat[i] = at
                assert abs((up - down) / 2e-5 - grad[i]) < 1e-3 * max(1, abs(grad[i])), k
    finally:
        tox.F32 = old


def test_windows_cover_all_words():
    sizes = np.array([0, 1, 23, 24, 25, 36, 37, 1000])
    place, mask, owner = tox.windows(sizes)
    begin = np.cumsum(sizes) - sizes
    for t, n in enumerate(sizes):
        own = [sorted(set((place[:, w][mask[:, w] > 0] - begin[t]).tolist())) for w in np.flatnonzero(owner == t)]
        assert sorted({x for o in own for x in o}) == list(range(n))
        assert all(o == list(range(o[0], o[0] + min(n, tox.WINDOW))) for o in own)
        starts = [o[0] for o in own]
        assert starts == [*range(0, max(n - tox.WINDOW, 0), tox.STRIDE), n - tox.WINDOW] if n > tox.WINDOW else len(own) == min(n, 1)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    net = tox.train(tox.labelled(docs, labels))
    own = docs.join(labels, "doc_id").filter(tox.held_out())
    rows = [(r.toxic, r.score >= tox.THRESHOLD) for r in tox.score(own, net).join(labels, "doc_id").collect()]
    hit = sum(t and p for t, p in rows)
    assert len(rows) > 1000
    assert hit / sum(t for t, _ in rows) > 0.85 and hit / sum(p for _, p in rows) > 0.85


def test_odd_rows(spark):
    data = [(i, f"you are scum and trash {i}" if i % 2 else f"a fine day for walks {i}", i % 2) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(100, None, "x"), (101, "", "x"), (102, "fine " * 20000, "x"), (102, "fine " * 20000, "x"), (None, "scum trash " * 3, "x"), (103, "q" * 200_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in data] + [(100, 1, 0), (None, 1, 0), (101, None, 0)], "doc_id long, toxic int, score int")
    net = tox.train(tox.labelled(df, labels))
    got = {(r.doc_id, r.score >= tox.THRESHOLD) for r in tox.score(df, net).collect()}
    assert {(None, True), (100, False), (101, False), (102, False)} <= got and all((i, bool(y)) in got for i, _, y in data)
    assert tox.score(df, net).count() == df.count() and tox.score(df.limit(0), net).count() == 0
    assert tox.keep_clean(df, net).columns == df.columns and tox.keep_clean(df, net).filter("doc_id is null").count() == 0
    assert {r.score for r in tox.score(df, tox.train(tox.labelled(df.limit(0), labels))).collect()} == {0.0}


def test_long_words_are_read_to_their_end():
    assert tox.words_of("Ab " + "x" * tox.WORD_CHARS) == ["ab", "x" * tox.WORD_CHARS]
    for n in (65, 71, 72, 73, 128, 1000):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        parts, half = tox.words_of(word), tox.PIECE_CHARS // 2
        assert parts[0] + "".join(p[half:] for p in parts[1:]) == word
        assert all(len(p) == tox.PIECE_CHARS for p in parts[:-1]) and half < len(parts[-1]) <= tox.PIECE_CHARS
    rng = np.random.default_rng(5)
    fine, foul = "今天天气很好我们去公园", "恶毒垃圾蠢货"
    glue = lambda bad: "".join(fine[: rng.integers(1, 12)] for _ in range(rng.integers(1, 30))) + foul * bad + "".join(fine[: rng.integers(1, 12)] for _ in range(rng.integers(1, 30)))
    labels = np.arange(200) % 2
    net = tox.fit([glue(int(y)) for y in labels], labels)
    got = tox.scores(net, [fine * 100, fine * 99 + foul + fine, fine * 100 + foul, fine * 10 + foul + fine * 500, fine * 600])
    assert [bool(x) for x in got >= tox.THRESHOLD] == [False, True, True, True, False], got
