"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

Text is cut before each space, spaces become a mark and the text's start has one too; each such word
is segmented on its own.  The Aho-Corasick automaton enumerates the vocabulary's matches; for every end
position the best score and its number of pieces are carried, nothing else.  Tie rules are those of the tokenizers
library's Unigram model: a later candidate must score strictly more, and candidates come by start, so the longest
piece wins a tie.  A character without a piece costs the lowest score less a penalty; as bytes, it counts once
for each byte.

The vocabulary file is a BPE model's; its pieces' scores, minus their ranks as merges, stand in for unigram log-probabilities, so
counts are those of the library's Unigram model with these scores, not of the file's own BPE.

Null text has 0 tokens, as has empty text; repeated rows give repeated rows; an empty table gives none; other columns
are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, kept, lean
from .pieces import APART, MARK, SIDE_BY_SIDE, Pieces, default_path, vocabulary

CACHE_WORDS = 200_000
AT_ONCE = 16_384
ROWS = 1024


def _one(v: Pieces, word: str) -> int:
    """Of a long word, character by character."""
    n = len(word)
    best, count = [-np.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    scores, lengths = v.scores, v.lengths
    it = v.automaton.iter(word)
    nxt = next(it, None)
    for e in range(1, n + 1):
        while nxt is not None and nxt[0] + 1 == e:
            s = e - int(lengths[nxt[1]])
            score = best[s] + float(scores[nxt[1]])
            if score > best[e]:
                best[e], count[e] = score, count[s] + 1
            nxt = next(it, None)
        c = word[e - 1]
        if c not in v.singles and best[e - 1] + v.unknown > best[e]:
            best[e], count[e] = best[e - 1] + v.unknown, count[e - 1] + len(c.encode("utf-8", "replace"))
    return count[n]


def viterbi_counts(v: Pieces, words: list[str]) -> list[int]:
    """Pieces of each word's best segmentation; words hold their mark."""
    out = np.zeros(len(words), np.int64)
    short = [i for i, w in enumerate(words) if len(w) <= SIDE_BY_SIDE and APART not in w]
    for i in set(range(len(words))).difference(short):
        out[i] = _one(v, words[i])
    for a in range(0, len(short), AT_ONCE):
        ids = short[a : a + AT_ONCE]
        own = [words[i] for i in ids]
        word, start, end, piece = v.matches(own)
        score, bytes_ = v.scores[piece], np.ones(len(piece), np.int64)
        if lone := v.uncovered(own):
            lw, lk, lc = zip(*lone, strict=True)
            word, start, end = np.append(word, lw), np.append(start, lk), np.append(end, np.array(lk) + 1)
            score, bytes_ = np.append(score, np.full(len(lw), v.unknown)), np.append(bytes_, [len(c.encode("utf-8", "replace")) for c in lc])
            order = np.lexsort((start, word, end))
        else:
            order = np.argsort(end.astype(np.int16), kind="stable")  # by word and start already
        word, start, end, score, bytes_ = word[order], start[order], end[order], score[order], bytes_[order]
        width = max(map(len, own)) + 1
        best, count = np.full((len(own), width), -np.inf), np.zeros((len(own), width), np.int64)
        best[:, 0] = 0.0
        cuts = np.flatnonzero(np.diff(end, prepend=-1))
        for x, z in zip(cuts, [*cuts[1:], len(end)], strict=True):
            w, s = word[x:z], start[x:z]
            got = best[w, s] + score[x:z]
            new = np.flatnonzero(np.diff(w, prepend=-1))
            most = np.maximum.reduceat(got, new)
            # of equal scores the first by start: the longest piece
            size = np.diff(new, append=len(w))
            first = np.minimum.reduceat(np.where(got == np.repeat(most, size), np.arange(len(w)), len(w)), new)
            good = most > -np.inf
            rows, first = w[new][good], first[good]
            best[rows, end[x]] = most[good]
            count[rows, end[x]] = count[rows, s[first]] + bytes_[x:z][first]
        out[ids] = count[np.arange(len(own)), [len(w) for w in own]]
    return out.tolist()


def words_of(text: str) -> list[str]:
    if not text:
        return []
    plain = text.replace(MARK, " ")
    return plain[1:].split(" ") if plain[0] == " " else plain.split(" ")


class Counter:
    """Counts by word, kept by each worker up to CACHE_WORDS."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        lone = [p for p in self.v.pieces if len(p) > 1 and not self.v.singles.intersection(p)]
        if lone:
            raise ValueError(f"pieces of which no character is a piece itself aren't supported: {lone[:3]}")
        self.cache: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [words_of(t or "") for t in texts]
        words = {w for ws in split for w in ws}
        new = list(words.difference(self.cache))
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        self.cache.update(zip(new, viterbi_counts(self.v, [MARK + w for w in new]), strict=True))
        out = [sum(map(self.cache.__getitem__, ws)) for ws in split]
        for w in new:
            if len(w) > SIDE_BY_SIDE:  # long words aren't kept
                del self.cache[w]
        return out


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens long for each row."""
    lean(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = kept(f"counts-{path}", lambda: Counter(path))
        for part in chunks(batches, 1, ROWS):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.counts(part.column(1).to_pylist()), pa.int64())], names=["key", "n_tokens"])

    return rows.mapInArrow(count, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long").withColumnRenamed("key", key)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), default_path())
