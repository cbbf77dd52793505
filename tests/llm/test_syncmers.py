import hashlib
import re

from pyspark.sql import functions as F

from gapweave.llm import syncmers


def run(spark, df):
    out = syncmers.compared(df)
    return out.withColumn("fp", syncmers.fingerprint("anchors")).withColumn("efp", syncmers.fingerprint("edited_anchors")).collect()


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    order = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    want = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        want[i] = (len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest())
    for rows in (1000, 37):
        old, syncmers.RANGE_ROWS = syncmers.RANGE_ROWS, rows
        try:
            got = {r.doc_id: r for r in run(spark, docs.repartition(5))}
        finally:
            syncmers.RANGE_ROWS = old
        assert {i: (r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for i, r in got.items()} == want
    long = [r for r in got.values() if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.6 > 0.2 > sum(r.near_next for r in long) / len(long)
    by_text = {}
    for i, t in order:
        assert by_text.setdefault(t, got[i].fp) == got[i].fp


def test_closed_syncmers(spark):
    """Every anchor is closed by definition, and all closed k-mers of a short text are anchors."""
    words = [f"w{i % 23}x{i * 7 % 11}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = sorted(x & ((1 << 24) - 1) for x in syncmers.anchored(df, "text", "a").first().a)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))], "i int, a string, b string")
    g = [r.h for r in pairs.select("i", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).orderBy("i").collect()]
    assert got == [i for i in range(len(words) - 4) if min(g[i], g[i + 3]) <= min(g[i + 1], g[i + 2])]


def test_odd_rows(spark):
    data = [(5, None), (5, ""), (3, "a b"), (3, "a b"), (None, "x " * 3000), (9, "🙂é漢字" * 50), (7, "one two three four five six")]
    df = spark.createDataFrame([(*x, 1, 2) for x in data], "doc_id long, text string, anchors int, edited int")
    rows = run(spark, df)
    assert len(rows) == len(data)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert [r.near_next for r in rows if r.doc_id == 3] [0] == 1.0
    assert syncmers.compared(df.limit(0)).count() == 0
    one = run(spark, df.filter("doc_id = 7"))[0]
    assert one.near_next == 1.0 and one.edited == "one two three four fi" + "one tw"


def test_long_texts_keep_all_anchors(spark):
    """A passage changed in a long text leaves a trace, and matches go on behind any insertions."""
    words = [f"w{i}" for i in range(4000)]
    other = [f"v{i}" for i in range(120)]
    near = words[:3000] + other[:50] + words[3050:]
    pushed = words[:1000] + other[:40] + words[1000:2000] + other[40:80] + words[2000:3000] + other[80:] + words[3000:]
    df = spark.createDataFrame([(" ".join(words), " ".join(x)) for x in (words, near, pushed, other)], "a string, b string")
    df = syncmers.anchored(syncmers.anchored(df, "a", "x"), "b", "y")
    same, changed, inserted, none = [(r.x, r.y, r.z) for r in syncmers.with_likeness(df, "x", "y", "z").collect()]
    assert len(same[0]) > 1500 and same[2] == 1.0 and none[2] == 0.0
    assert changed[0] != changed[1] and 0.97 < changed[2] < 1.0
    assert 0.95 < inserted[2] < 1.0


def plain_likeness(a, b):
    """Two lists of packed anchors, compared pair by pair."""
    if not a and not b:
        return 1.0
    split = lambda xs: {x >> 25: x & ((1 << 24) - 1) for x in xs}
    x, y = split(a), split(b)
    moves = [d for _, d in sorted((x[h], y[h] - x[h]) for h in x if h in y)]
    if not moves:
        return 0.0
    mid = sorted(moves)[len(moves) // 2]
    hits = sum(abs(d - mid) <= 16 or i > 0 and abs(d - moves[i - 1]) <= 16 or i + 1 < len(moves) and abs(d - moves[i + 1]) <= 16 for i, d in enumerate(moves))
    return 2 * hits / (len(x) + len(y))


def test_query_by_brute_force(spark):
    """Fingerprints and likenesses of a whole table, anchor by anchor."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in syncmers.op10_syncmers(spark, sf).collect()}
    edited = {i: t[: len(t) - len(t) // 4] + after[: len(t) // 4] for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True)}
    words = {w for t in [t for _, t in docs] + list(edited.values()) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", t)}
    code = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    texts = sorted({t for _, t in docs} | set(edited.values()))
    hashed = [[code[w] for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", t)] for t in texts]
    pairs = {p for h in hashed for p in zip(h, h[1:], strict=False)}
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(list(pairs), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    grams = [[two[p] for p in zip(h, h[1:], strict=False)] for h in hashed]
    closed = [[(g[i], g[i + 2], g[i + 3]) for i in range(len(g) - 3) if min(g[i], g[i + 3]) <= min(g[i + 1], g[i + 2])] for g in grams]
    three = {(r.a, r.b, r.c): r.h for r in spark.createDataFrame(list({k for c in closed for k in c}), "a long, b long, c long").select("a", "b", "c", F.xxhash64("a", "b", "c").alias("h")).collect()}
    prints = {}
    for t, h, g in zip(texts, hashed, grams, strict=True):
        if len(h) >= 5:
            first = {}
            for i in range(len(g) - 3):
                if min(g[i], g[i + 3]) <= min(g[i + 1], g[i + 2]):
                    first.setdefault(three[g[i], g[i + 2], g[i + 3]] >> 25, i)
            prints[t] = sorted((k << 25) + i for k, i in first.items())
    after = dict(zip([i for i, _ in docs], [t for _, t in docs[1:] + docs[:1]], strict=True))
    checked = 0
    for i, t in docs:
        if t in prints and edited[i] in prints and after[i] in prints:
            r = got[i]
            assert r.fingerprint == ",".join(map(str, prints[t])) and r.edited_fingerprint == ",".join(map(str, prints[edited[i]]))
            assert abs(r.near_edited - plain_likeness(prints[t], prints[edited[i]])) < 1e-12
            assert abs(r.near_next - plain_likeness(prints[t], prints[after[i]])) < 1e-12
            checked += 1
    assert checked > 150


def test_hot_id_is_split(spark):
    """An id that holds most rows is dealt to several ranges, in the order of text hashes, and no neighbour is lost."""
    rows = [(7 if i % 3 else i, f"text {i} of many words here") for i in range(900)] + [(None, f"none {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.text for r in df.select("text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("h")).orderBy("k", "h").collect()]
    old, syncmers.RANGE_ROWS = syncmers.RANGE_ROWS, 50
    try:
        got = {r.text: (r.next_text, r.b) for r in syncmers.edited_with_next(df.repartition(4)).withColumn("b", F.spark_partition_id()).collect()}
    finally:
        syncmers.RANGE_ROWS = old
    assert {t: n for t, (n, _) in got.items()} == dict(zip(order, order[1:] + order[:1], strict=True))
