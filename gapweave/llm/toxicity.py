"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (by hash bucket) beside the mean of the vectors of its character n-grams
(also by bucket; the word's ends count as characters).  A word of more than WORD_CHARS characters is read to its
end as pieces of PIECE_CHARS that overlap by half and count as a word each.  A text is read in windows of WINDOW words that overlap by half,
all of them; shorter texts are one window.  In each window one recurrent layer reads forward and one backward, an attention layer
weighs their states, and a linear layer scores the pooled state.  The text's score is the highest of its windows,
through a logistic curve.

Training: at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled texts, those of smallest hash (a documented bound on
fitting; every text is scored whole).  A toxic text's loss is on its best windows so far, a clean one's on its worst, so the label of
a text is learned without knowing where the toxic words are.  Seeded; reruns on equal rows agree.

A document that is labelled both ways counts as an example of each; texts at THRESHOLD itself are toxic.
Null text and empty text score as a text without words does: 0.  If no toxic (or no clean) label is there, all texts score 0 (or
the share of toxic labels).  Repeated rows give repeated rows; an empty table gives none; other columns are ignored by score() and
kept by keep_clean().
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, give_back, kept, lean, table

WINDOW, STRIDE = 24, 12
WORD_CHARS, PIECE_CHARS = 64, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 15
GRAMS = (3, 4, 5)
DIM, HIDDEN = 8, 8
SAMPLE_TOXIC, SAMPLE_CLEAN = 900, 1300
#: Few texts are read more often.
EPOCHS, MOST_EPOCHS, EPOCH_TEXTS = 8, 24, 8000
BATCH, RATE = 256, 0.02
THRESHOLD = 0.7
#: Windows scored side by side; a block stays in cache.
LANES = 2048
WORDS_AT_ONCE = 8192
ROWS = 1024
F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; and (word, bucket) of each of its character n-grams.  Over bytes, all words at once."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in words]
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    begin = np.cumsum(size) - size
    prime = np.uint64(0x9E3779B97F4A7C15)
    # a polynomial hash of each whole word, from sums over its places
    place = np.arange(len(flat)) - np.repeat(begin, size)
    powers = np.cumprod(np.full(int(size.max(initial=1)) + 1, np.uint64(0x100000001B3), np.uint64))
    whole = np.add.reduceat((flat + np.uint64(1)) * powers[place], begin) if len(raw) else np.zeros(0, np.uint64)
    bucket = ((whole * prime) >> np.uint64(40)) % np.uint64(WORD_BUCKETS)
    owners, grams = [], []
    for n in GRAMS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for i in range(n):
            h = (h ^ flat[i : m + i]) * np.uint64(0x100000001B3)
        inside = owner[:m] == owner[n - 1 :]
        owners.append(owner[:m][inside])
        grams.append((((h * prime) >> np.uint64(33)) % np.uint64(GRAM_BUCKETS))[inside])
    none = np.zeros(0, np.int64)
    return bucket.astype(np.int64), np.concatenate(owners or [none]), np.concatenate(grams or [none]).astype(np.int64)


class Lexicon:
    """Buckets of words and of their n-grams, which lie word by word in `gram`."""

    def __init__(self, bucket, begin, count, gram):
        self.bucket, self.begin, self.count, self.gram = bucket, begin, count, gram

    @classmethod
    def of(cls, words: list[str]) -> Lexicon:
        """WORDS_AT_ONCE by WORDS_AT_ONCE, as the hashes of n-grams take far more room than their buckets."""
        buckets, counts, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for a in range(0, len(words), WORDS_AT_ONCE):
            own = words[a : a + WORDS_AT_ONCE]
            bucket, owner, gram = word_inputs(own)
            buckets.append(bucket)
            counts.append(np.bincount(owner, minlength=len(own)))
            grams.append(gram[np.argsort(owner, kind="stable")].astype(np.int32))
        count = np.concatenate(counts)
        return cls(np.concatenate(buckets), np.cumsum(count) - count, count, np.concatenate(grams))

    def some(self, rows: np.ndarray) -> Lexicon:
        count = self.count[rows]
        begin = np.cumsum(count) - count
        at = np.arange(int(count.sum())) - np.repeat(begin, count) + np.repeat(self.begin[rows], count)
        return Lexicon(self.bucket[rows], begin, count, self.gram[at])


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n x columns: values summed by row."""
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1).astype(F32)


class Network:
    """Parameters p: word, gram (embeddings), and for each direction w (input to gates), u, b; att, out."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 0.3, s).astype(F32)
        self.p = {"word": small(WORD_BUCKETS, DIM) * F32(0.3), "gram": small(GRAM_BUCKETS, DIM) * F32(0.3), "att": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.full(1, -1.0, F32)}
        for d in "fb":
            self.p |= {f"w{d}": small(2 * DIM, 3 * HIDDEN), f"u{d}": small(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, F32)}
        self.constant: float | None = None

    def embed(self, lex: Lexicon) -> np.ndarray:
        g = np.zeros((len(lex.bucket), DIM), F32)
        has = np.flatnonzero(lex.count > 0)
        for a in range(0, len(has), WORDS_AT_ONCE):
            rows = has[a : a + WORDS_AT_ONCE]
            lo, hi = lex.begin[rows[0]], lex.begin[rows[-1]] + lex.count[rows[-1]]
            g[rows] = np.add.reduceat(self.p["gram"][lex.gram[lo:hi]], lex.begin[rows] - lo, axis=0) / np.sqrt(lex.count[rows])[:, None].astype(F32)
        return np.concatenate([self.p["word"][lex.bucket], g], 1)

    def states(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """gates: time x lanes x 3 hidden, inputs' share; mask: time x lanes.  Returns time x lanes x hidden."""
        t, n, _ = gates.shape
        h, out = np.zeros((n, HIDDEN), F32), np.empty((t, n, HIDDEN), F32)
        u, k = self.p[f"u{d}"], HIDDEN
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = h @ u
            zr = _sigmoid(gates[i, :, : 2 * k] + a[:, : 2 * k])
            c = np.tanh(gates[i, :, 2 * k :] + zr[:, k:] * a[:, 2 * k :])
            z = zr[:, :k] * mask[i][:, None]
            new = h + z * (c - h)
            if keep is not None:
                keep.append((i, h, a, zr, c))
            h = new
            out[i] = h
        return out

    def pooled(self, hs: np.ndarray, mask: np.ndarray):
        e = np.tanh(hs) @ self.p["att"]
        e = np.where(mask > 0, e, F32(-1e9))
        e = np.exp(e - e.max(0))
        w = e / e.sum(0)
        return (w[:, :, None] * hs).sum(0), w

    def logits(self, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """ids: time x lanes, rows of projected; the score of each window."""
        out = np.empty(ids.shape[1], F32)
        for a in range(0, ids.shape[1], LANES):
            i, m = ids[:, a : a + LANES], mask[:, a : a + LANES]
            hs = np.concatenate([self.states(d, projected[d][i], m) for d in "fb"], 2)
            out[a : a + LANES] = self.pooled(hs, m)[0] @ self.p["out"] + self.p["bias"]
        return out

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"}

    # -- training ------------------------------------------------------------------------------

    def gradient(self, lex: Lexicon, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the logistic loss over windows."""
        x = self.embed(lex)
        inputs = x[ids]
        kept: dict[str, list] = {"f": [], "b": []}
        hs = np.concatenate([self.states(d, inputs @ self.p[f"w{d}"] + self.p[f"b{d}"], mask, kept[d]) for d in "fb"], 2)
        pool, w = self.pooled(hs, mask)
        s = _sigmoid(pool @ self.p["out"] + self.p["bias"])
        ds = (s - y) * weight
        g = {"out": pool.T @ ds, "bias": np.array([ds.sum()], F32)}
        dpool = ds[:, None] * self.p["out"]
        dhs = w[:, :, None] * dpool
        dw = (hs * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        th = np.tanh(hs)
        g["att"] = np.einsum("tn,tnk->k", de, th)
        dhs = dhs + de[:, :, None] * self.p["att"] * (1 - th**2)
        dx = np.zeros_like(inputs)
        k = HIDDEN
        for d, at in (("f", 0), ("b", k)):
            u, win = self.p[f"u{d}"], self.p[f"w{d}"]
            gu, gw, gb = np.zeros_like(u), np.zeros_like(win), np.zeros(3 * k, F32)
            dh = np.zeros((inputs.shape[1], k), F32)
            for i, h, a, zr, c in reversed(kept[d]):
                dh = dh + dhs[i, :, at : at + k]
                m = mask[i][:, None]
                z, r = zr[:, :k], zr[:, k:]
                dc = dh * z * m * (1 - c**2)
                dz = dh * (c - h) * m * z * (1 - z)
                dr = dc * a[:, 2 * k :] * r * (1 - r)
                dgates = np.concatenate([dz, dr, dc], 1)
                da = np.concatenate([dz, dr, dc * r], 1)
                gu += h.T @ da
                gw += inputs[i].T @ dgates
                gb += dgates.sum(0)
                dx[i] += dgates @ win.T
                dh = dh * (1 - z * m) + da @ u.T
            g |= {f"u{d}": gu, f"w{d}": gw, f"b{d}": gb}
        dwords = _summed(ids.ravel(), dx.reshape(-1, 2 * DIM) * mask.ravel()[:, None], len(x))
        g["word"] = _summed(lex.bucket, dwords[:, :DIM], WORD_BUCKETS)
        each = dwords[:, DIM:] / np.sqrt(np.maximum(lex.count, 1))[:, None].astype(F32)
        g["gram"] = _summed(lex.gram, np.repeat(each, lex.count, axis=0), GRAM_BUCKETS)
        return g


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over words laid end to end: place (time x windows) of each word, mask, and the text of each window; all overlapping windows."""
    many = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // STRIDE) + 1, np.minimum(sizes, 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), many)
    begin = np.cumsum(sizes) - sizes
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    first = begin[owner] + np.minimum(nth * STRIDE, np.maximum(sizes[owner] - WINDOW, 0))
    place = (first[None, :] + np.arange(WINDOW)[:, None]).astype(np.int32 if sizes.sum() < 2**31 else np.int64)
    mask = (place < (begin + sizes)[owner][None, :]).astype(F32)
    return np.minimum(place, max(int(sizes.sum()) - 1, 0)), mask, owner


def words_of(text: str | None) -> list[str]:
    """The words of a text, overlong ones as overlapping pieces."""
    ws = (text or "").lower().split()
    if max(map(len, ws), default=0) <= WORD_CHARS:
        return ws
    half = PIECE_CHARS // 2
    return [p for w in ws for p in ([w] if len(w) <= WORD_CHARS else [w[a : a + PIECE_CHARS] for a in range(0, len(w) - half, half)])]


def _laid_out(texts: list[str | None]):
    split = [words_of(t) for t in texts]
    index: dict[str, int] = {}
    flat = np.fromiter((index.setdefault(w, len(index)) for ws in split for w in ws), np.int32, sum(map(len, split)))
    place, mask, owner = windows(np.array([len(ws) for ws in split], np.int64))
    return list(index), flat, place, mask, owner


def window_scores(net: Network, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and text of each window; a slice's text and some fifty times that is held, so callers slice by bytes."""
    words, flat, place, mask, owner = _laid_out(texts)
    if not len(owner):
        return np.zeros(0, F32), owner
    projected = net.project(net.embed(Lexicon.of(words)))
    return net.logits(projected, flat[place], mask), owner


def scores(net: Network, texts: list[str | None]) -> np.ndarray:
    if net.constant is not None:
        return np.where([bool(t and t.split()) for t in texts], net.constant, 0.0)
    s, owner = window_scores(net, texts)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, s.astype(float))
    return _sigmoid(best)


def fit(texts: list[str], labels: np.ndarray, seed: int = 3) -> Network:
    net = Network(seed)
    if not len(texts) or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(texts) else 0.0
        return net
    rng = np.random.default_rng(seed)
    words, flat, place, mask, owner = _laid_out(texts)
    ids, lex = flat[place], Lexicon.of(words)
    n_windows = np.bincount(owner, minlength=len(texts))
    seen = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}
    rate = {k: F32(RATE * (2 if k in ("word", "gram") else 1)) for k in net.p}
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-EPOCH_TEXTS // len(texts))))
    s = np.zeros(len(owner), F32)
    for epoch in range(epochs):
        if epoch and (epoch % 2 == 0 or epochs > EPOCHS):
            s = net.logits(net.project(net.embed(lex)), ids, mask)
        # a toxic text's best windows, more of them at first; a clean one's worst
        share = max(0.0, 1.0 - 2.0 * epoch / epochs)
        order = np.lexsort((-(s + rng.normal(0, 1.5 * share + 0.05, len(s))), owner))
        rank = np.arange(len(order)) - (np.cumsum(n_windows) - n_windows)[owner[order]]
        toxic = labels[owner[order]] > 0
        most = np.where(toxic, np.clip(np.ceil(share * 0.7 * n_windows[owner[order]]), 1, 12), 3)
        chosen = order[rank < most]
        weight = np.where(toxic, 1.0 / np.sqrt(most), 1.0)[rank < most]
        mix = rng.permutation(len(chosen))
        for a in range(0, len(mix), BATCH):
            w = chosen[mix[a : a + BATCH]]
            used, local = np.unique(ids[:, w], return_inverse=True)
            g = net.gradient(lex.some(used), local.reshape(WINDOW, -1), mask[:, w], labels[owner[w]].astype(F32), (weight[mix[a : a + BATCH]] / len(w) * 8).astype(F32))
            for k, v in g.items():
                seen[k] += v**2
                net.p[k] -= rate[k] * v / np.sqrt(seen[k])
    s = net.logits(net.project(net.embed(lex)), ids, mask)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, s)
    _centre(net, best, labels)
    return net


def _centre(net: Network, best: np.ndarray, labels: np.ndarray) -> None:
    """Shift and scale the last layer so that THRESHOLD splits the fitted texts with fewest errors, amid the widest gap."""
    ok = np.isfinite(best)
    best, y = best[ok], labels[ok]
    order = np.argsort(best)
    s, y = best[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y > 0)]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    least = np.flatnonzero(errors == errors.min())
    edge = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    at = least[np.argmax(edge[least + 1] - edge[least])]
    cut = 0.5 * (edge[at] + edge[at + 1])
    net.p["bias"] = (net.p["bias"] - F32(cut) + F32(np.log(THRESHOLD / (1 - THRESHOLD)))).astype(F32)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Network:
    """From rows with a text and a label of 0 or 1."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    some = [rows.filter(F.col("label") == v).orderBy("h", "text").limit(n) for v, n in ((1, toxic), (0, clean))]
    got = some[0].union(some[1]).toPandas().sort_values(["h", "label"])
    try:
        return fit(got["text"].tolist(), got["label"].to_numpy(np.int64))
    finally:
        give_back()


def score(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score double of each row."""
    lean(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sent, name = df.sparkSession.sparkContext.broadcast(net), f"toxicity-{uuid.uuid4().hex}"  # its size is fixed

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = kept(name, lambda: sent.value)
        for part in chunks(batches, 1, ROWS):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(own, part.column(1).to_pylist()), pa.float64())], names=["key", "score"])

    return rows.mapInArrow(go, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep_clean(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of df whose score is under THRESHOLD."""
    lean(df.sparkSession)
    sent, name = df.sparkSession.sparkContext.broadcast(net), f"toxicity-{uuid.uuid4().hex}"
    at = df.columns.index(text)

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = kept(name, lambda: sent.value)
        for part in chunks(batches, at, ROWS):
            yield part.filter(pa.array(scores(own, part.column(at).to_pylist()) < THRESHOLD))

    return df.mapInArrow(go, df.schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """doc_id, text, toxic of the rows to learn from: none that is held out, at most so many labels of either kind.

    Labels are chosen before their texts are looked up, so texts aren't shuffled; the chosen ids are few whatever the table's size.
    """
    marks = labels.select("doc_id", "toxic").filter("doc_id is not null").filter(F.col("toxic").isin(0, 1) & ~held_out()).dropDuplicates()
    marks = marks.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string")))
    some = [marks.filter(F.col("toxic") == v).orderBy("_h", "doc_id").limit(n).drop("_h") for v, n in ((1, toxic), (0, clean))]
    return docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = train(labelled(docs, table(spark, sf_dir, "labels")))
    out = score(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
