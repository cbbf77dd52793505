"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

For each order, documents (in blocks of about BLOCK_DOCS) are exploded into n-grams; each block sends every distinct n-gram with
its count to the hash partition that owns it; the partitions add up the counts of the whole corpus, which are
joined back to the blocks and summed per document.  Messages pack sorted hashes as byte planes, several bytes a row less
than rows of a table would take; where corpora grow, messages shrink towards single rows.  n-grams of order 2 and more count from
MIN_COUNT; an n-gram of higher order can't reach it unless both n-grams it holds do, so others aren't sent.

    S(w | h) = c(h w) / c(h) if c(h w) >= MIN_COUNT, else BACKOFF * S(w | shorter h);  S(w) = c(w) / N

A document's score is the sum of ln S over its words, with counts over all documents.  A message holds an n-gram once for each block,
whatever its frequency, so common words and phrases are added up before they are sent.  Words are runs of anything but ASCII white
space; hashes have 64 bits.  Null and empty texts have no words and score 0; repeated rows give repeated rows (and count each time);
an empty table gives none; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, pieces
from .jaccard import _mix

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
#: A block holds about so many documents, or so many words if texts are long; a bucket so many documents' n-grams.
BLOCK_DOCS, BLOCK_WORDS, BUCKET_DOCS = 3072, 2_000_000, 2048
MESSAGE = "n int, bucket int, block int, grams binary, counts binary"


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers (rising ones as their steps) as compressed byte planes."""
    import pyarrow as pa

    steps = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(b: bytes, rising: bool = False) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(b[:8], "little")
    planes = pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    x = np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


class Block:
    """The n-grams of a block of texts, order by order."""

    def __init__(self, texts: list[str | None]):
        import xxhash

        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        index: dict[bytes, int] = {}
        flat = np.fromiter((index.setdefault(w, len(index)) for ws in split for w in ws), np.int64, sum(map(len, split)))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), np.uint64, len(index))
        self.size = np.array([len(ws) for ws in split], np.int64)
        self.owner = np.repeat(np.arange(len(split)), self.size)
        self.nth = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.word = hashes[flat] if len(flat) else np.zeros(0, np.uint64)
        self.counts: list[np.ndarray] = []  # by order: of the n-gram that ends at each word, 0 if not counted
        self.gram = self.word

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the next order: distinct hashes, their counts here, and for each word the index of the n-gram ending there, or -1."""
        n = len(self.counts) + 1
        ok = self.nth >= n - 1
        if n == 1:
            gram = self.word
        else:
            before = np.concatenate([[np.uint64(0)], self.gram[:-1]]) if len(self.gram) else self.gram
            gram = _mix(before * np.uint64(0x9E3779B97F4A7C15) + self.word + np.uint64(n))
            if n > 2:
                last = self.counts[-1]
                ok &= (last >= MIN_COUNT) & (np.concatenate([[0], last[:-1]]) >= MIN_COUNT)
        self.gram = gram
        at = np.full(len(gram), -1, np.int64)
        distinct, inverse, count = np.unique(gram[ok], return_inverse=True, return_counts=True)
        at[ok] = inverse
        return distinct, count, at

    def learn(self, total: np.ndarray, at: np.ndarray) -> None:
        self.counts.append(np.where(at >= 0, np.append(total, 0)[at], 0).astype(np.int64))

    def scores(self, words: int) -> np.ndarray:
        s = np.log(self.counts[0] / max(words, 1), out=np.zeros(len(self.word)), where=self.counts[0] > 0)
        for n in range(2, len(self.counts) + 1):
            c, shorter = self.counts[n - 1], self.counts[n - 2]
            context = np.concatenate([[0], shorter[:-1]]) if len(shorter) else shorter
            seen = (c >= MIN_COUNT) & (self.nth >= n - 1)
            full = np.log(np.where(seen, c, 1) / np.where(seen, context, 1))
            s = np.where(seen, full, np.where(self.nth >= n - 1, s + np.log(BACKOFF), s))
        return np.bincount(self.owner, s, len(self.size))


def _state(docs, replies, order: int) -> Block:
    """The block with the counts of all orders up to `order`."""
    block = Block(docs["text"].tolist())
    for n in range(1, order + 1):
        distinct, _, at = block.grams()
        own = replies[replies["n"] == n].sort_values("bucket")["counts"]
        total = np.concatenate([unpack(c) for c in own]).astype(np.int64) if len(own) else np.zeros(len(distinct), np.int64)
        block.learn(total, at)
    return block


def _cut(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of hashes starts."""
    width = 2**64 // buckets + 1
    return np.searchsorted(hashes, np.array([min(i * width, 2**64 - 1) for i in range(buckets)] or [0], np.uint64))


def _messages(block: Block, name: int, n: int, buckets: int) -> list[tuple]:
    hashes, counts, _ = block.grams()
    cuts = [*_cut(hashes, buckets), len(hashes)]
    return [(n, i, name, pack(hashes[a:b], True), pack(counts[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["n", "bucket", "block", "grams", "counts"])


def _send_first(buckets: int, order: int):
    """Orders 1 and 2, which need nothing."""

    def go(key, docs):
        block = Block(docs["text"].tolist())
        rows = _messages(block, int(key[0]), 1, buckets)
        if order > 1:
            block.counts.append(np.zeros(len(block.word), np.int64))
            rows += _messages(block, int(key[0]), 2, buckets)
        return _frame(rows)

    return go


def _send(buckets: int, order: int):
    def go(key, docs, replies):
        return _frame(_messages(_state(docs, replies, order - 1), int(key[0]), order, buckets) if len(docs) else [])

    return go


def _count(f):
    """All messages of a partition: the corpus count of each n-gram, back to its block."""
    import pandas as pd

    grams = [unpack(g, True) for g in f["grams"]]
    counts = np.concatenate([unpack(c) for c in f["counts"]]).astype(np.int64)
    _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inverse, counts)[inverse].astype(np.int64)
    back = np.split(total, np.cumsum([len(g) for g in grams])[:-1])
    return pd.DataFrame({"n": f["n"], "bucket": f["bucket"], "block": f["block"], "counts": [pack(b) for b in back]})


def _score(order: int, words: int):
    def go(key, docs, replies):
        import pandas as pd

        block = _state(docs, replies, order)
        return pd.DataFrame({"key": docs["key"], "n_words": block.size, "score": block.scores(words)})

    return go


def backoff_scores(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key, n_words long, score double (sum of ln S) of each row, with counts over all rows."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sizes = rows.agg(F.count("*"), F.sum(F.regexp_count("text", F.lit(WORD)))).first()
    n, words = sizes[0], sizes[1] or 0
    blocks, buckets = max(pieces(n, BLOCK_DOCS), pieces(words, BLOCK_WORDS)), pieces(n, BUCKET_DOCS)
    # one shuffle of texts, which every order and the score read again
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int")).repartition("block")
    reply = "n int, bucket int, block int, counts binary"
    replies = dealt.groupBy("block").applyInPandas(_send_first(buckets, order), MESSAGE).groupBy("n", "bucket").applyInPandas(_count, reply)
    for k in range(3, order + 1):
        more = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_send(buckets, k), MESSAGE)
        replies = replies.union(more.groupBy("n", "bucket").applyInPandas(_count, reply))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, score double"
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_score(order, words), schema).withColumnRenamed("key", key)


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_scores(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", F.round("score", 6).alias("score"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w3, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w3, lag(w3) OVER p AS w2, lag(w3, 2) OVER p AS w1 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (
  SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY w3) AS c1, count(*) OVER (PARTITION BY w2, w3) AS c2, count(*) OVER (PARTITION BY w1, w2, w3) AS c3 FROM g
), h AS (
  SELECT *, lag(c1) OVER p AS h1, lag(c2) OVER p AS h2 FROM c WINDOW p AS (PARTITION BY r ORDER BY i)
), s AS (
  SELECT r, ln(CASE
    WHEN i > 2 AND c3 >= 2 THEN c3 / h2
    WHEN i > 1 AND c2 >= 2 THEN (CASE WHEN i > 2 THEN 0.4 ELSE 1 END) * c2 / h1
    ELSE (CASE WHEN i > 2 THEN 0.4 * 0.4 WHEN i > 1 THEN 0.4 ELSE 1 END) * c1 / n END) AS v
  FROM h
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce((SELECT sum(v) FROM s WHERE s.r = d.r), 0), 6) AS score FROM d
"""
