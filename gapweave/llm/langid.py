"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words.  Words are runs without white space, in
lower case, from their first letter to their last; what has no letter says nothing.
The piece probabilities are learned by expectation maximisation on the words of labelled texts: at most
SAMPLE_DOCS of them, those of smallest hash (a documented bound on fitting; every text is scored whole).

Texts that are null or hold no letter get `und` and score 0, as do all texts if nothing can be learned.  Ties between
languages go to the first in code point order.  Repeated rows give repeated rows; an empty table gives none; other
columns are ignored.
"""
from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, kept, lean
from .pieces import APART, MARK, SIDE_BY_SIDE, Pieces, default_path, vocabulary

SAMPLE_DOCS = 3000
ROUNDS = 3
SMOOTHING = 0.5
#: Of a character that no piece covers, in every language.
LONE = 1e-7
#: No piece is less probable; and the scale of a character within the forward algorithm.
LEAST, PER_CHAR = 1e-13, 1e6
CACHE_WORDS = 150_000
#: Words side by side in the forward algorithm; a block's table is words x positions x languages.
AT_ONCE = 4096
ROWS = 1024
NONE = "und"
LETTER = r"\p{L}"


@functools.lru_cache(maxsize=1)
def _edges():
    import regex

    return regex.compile(r"^[^\p{L}]+|[^\p{L}\p{M}]+$")


def bare(word: str) -> str:
    """A word without what stands before its first letter and behind its last."""
    if word.isalpha():
        return word
    return _edges().sub("", word)


def _lattice(v: Pieces, words: list[str]):
    """Word, start, end and piece of every match, by end and then word; a character that no piece covers has the piece after the last."""
    word, start, end, piece = v.matches(words)
    if lone := v.uncovered(words):
        lw, lk, _ = zip(*lone, strict=True)
        word, start, end, piece = np.append(word, lw), np.append(start, lk), np.append(end, np.array(lk) + 1), np.append(piece, np.full(len(lw), len(v.pieces)))
        order = np.lexsort((word, end))
    else:
        order = np.argsort(end.astype(np.int16), kind="stable")
    return word[order], start[order], end[order], piece[order]


def scaled(v: Pieces, probs: np.ndarray) -> np.ndarray:
    """Probabilities times PER_CHAR for each character of the piece.  As none is under LEAST, words of up to SIDE_BY_SIDE characters stay
    within the range of a double, whatever they hold: (LEAST * PER_CHAR) ** 40 = 1e-280, and 2 ** 39 segmentations of at most PER_CHAR ** 40 each."""
    return probs * PER_CHAR ** np.append(v.lengths, 1)[:, None].astype(float)


def _sums(n: int, width: int, at, to, key, x):
    """Forward sums of the lattice (or backward ones): table[row, to] gains table[row, at] * x, group by group of `to`."""
    f = np.zeros((n, width, x.shape[1]))
    word, first = key
    cuts = np.flatnonzero(np.diff(to, prepend=-1)) if len(to) else np.zeros(0, int)
    f[np.arange(n), first] = 1.0
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
        w = word[a:b]
        new = np.flatnonzero(np.diff(w, prepend=-1))
        f[w[new], to[a]] += np.add.reduceat(f[w, at[a:b]] * x[a:b], new, axis=0)
    return f


def _long(v: Pieces, probs: np.ndarray, word: str) -> np.ndarray:
    """Log probability of one word of any length, scaled at each step."""
    longest = int(v.lengths.max())
    ring = np.zeros((longest + 1, probs.shape[1]))
    ring[0] = 1.0
    log = np.zeros(probs.shape[1])
    it = v.automaton.iter(word)
    nxt = next(it, None)
    for e in range(1, len(word) + 1):
        got = np.zeros(probs.shape[1])
        while nxt is not None and nxt[0] + 1 == e:
            got += ring[(e - v.lengths[nxt[1]]) % (longest + 1)] * probs[nxt[1]]
            nxt = next(it, None)
        if word[e - 1] not in v.singles:
            got += ring[(e - 1) % (longest + 1)] * probs[-1]
        scale = np.where(got > 0, got, 1.0)
        ring /= scale
        ring[e % (longest + 1)] = got / scale
        log += np.log(scale)
    return log


def log_probabilities(v: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Of each word in each language, all segmentations summed.  probs: pieces (and the lone character) by languages, none under LEAST."""
    out = np.zeros((len(words), probs.shape[1]))
    x = scaled(v, probs)
    short = sorted((i for i, w in enumerate(words) if len(w) <= SIDE_BY_SIDE and APART not in w), key=lambda i: len(words[i]))
    if len(short) < len(words):
        for i in set(range(len(words))).difference(short):
            out[i] = _long(v, probs, words[i])
    for a in range(0, len(short), AT_ONCE):
        ids = short[a : a + AT_ONCE]
        own = [words[i] for i in ids]
        size = np.array([len(w) for w in own])
        word, start, end, piece = _lattice(v, own)
        f = _sums(len(own), int(size.max()) + 1, start, end, (word, 0), x[piece])
        out[ids] = np.log(f[np.arange(len(own)), size]) - size[:, None] * np.log(PER_CHAR)
    return out


def normalised(seen: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts; smoothed by what all languages hold, none under LEAST."""
    everywhere = seen.sum(1, keepdims=True) + 1e-3
    probs = seen + SMOOTHING * everywhere / everywhere.sum() * len(seen) * 0.01 + 1e-6
    probs /= probs.sum(0)
    probs[-1] = LONE
    return np.maximum(probs, LEAST)


def fit(v: Pieces, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by language from counts (words by languages).  Words of more than SIDE_BY_SIDE characters are learned from in pieces of as many."""
    cut = [(w[k : k + SIDE_BY_SIDE], i) for i, w in enumerate(words) for k in range(0, len(w), SIDE_BY_SIDE)]
    cut.sort(key=lambda p: len(p[0]))
    n_langs = counts.shape[1]
    blocks = []
    for a in range(0, len(cut), AT_ONCE):
        own = [w.replace(APART, " ") for w, _ in cut[a : a + AT_ONCE]]
        blocks.append((np.array([len(w) for w in own]), counts[[i for _, i in cut[a : a + AT_ONCE]]], _lattice(v, own)))
    seen = np.zeros((len(v.pieces) + 1, n_langs))
    for _, c, (word, _, _, piece) in blocks:
        for lang in range(n_langs):
            seen[:, lang] += np.bincount(piece, c[word, lang] * np.maximum(np.append(v.lengths, 1)[piece], 1), len(v.pieces) + 1)
    for _ in range(rounds):
        x = scaled(v, normalised(seen))
        seen = np.zeros_like(seen)
        for size, c, (word, start, end, piece) in blocks:
            seen += _expected(x, size, c, word, start, end, piece)
    return normalised(seen)


def _expected(x, size, c, word, start, end, piece) -> np.ndarray:
    """How often each piece is expected in words that occur c times, under scaled probabilities x."""
    n, width, p = len(size), int(size.max()) + 1, x[piece]
    f = _sums(n, width, start, end, (word, 0), p)
    back = np.lexsort((word, -start))
    b = _sums(n, width, end[back], start[back], (word[back], size), p[back])
    share = f[word, start] * p * b[word, end] / f[np.arange(n), size][word] * c[word]
    return np.stack([np.bincount(piece, share[:, lang], len(x)) for lang in range(x.shape[1])], 1)


class Model:
    def __init__(self, path: str, langs: list[str], probs: np.ndarray):
        self.path, self.langs, self.probs = path, langs, probs


class Scorer:
    """A model with the log probabilities of words that it has met in more than one slice, CACHE_WORDS at most beside a slice's own."""

    def __init__(self, model: Model):
        self.langs, self.probs = model.langs, model.probs
        self.v = vocabulary(model.path) if model.langs else None
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.cache))
        if len(self.cache) + len(new) > CACHE_WORDS:
            again = [w for w in words if w in self.cache]
            self.rows = self.rows[[self.cache[w] for w in again]]
            self.cache = dict(zip(again, range(len(again)), strict=True))
        inner = list(map(bare, new))
        index: dict[str, int] = {"": 0}
        at = [index.setdefault(w, len(index)) for w in inner]
        logs = np.zeros((len(index), len(self.langs)))  # what has no letter says nothing
        logs[1:] = log_probabilities(self.v, self.probs, [MARK + w for w in list(index)[1:]])
        self.cache.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, logs[at]])

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import regex

        known = [i for i, t in enumerate(texts) if t and self.langs and regex.search(LETTER, t)]
        preds, scores = [NONE] * len(texts), [0.0] * len(texts)
        if not known:
            return preds, scores
        split = [texts[i].lower().split() for i in known]
        self._learn(set(chain.from_iterable(split)))
        sizes = np.array([len(ws) for ws in split])
        flat = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        sums = np.add.reduceat(self.rows[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        best = sums.argmax(1)
        share = 1.0 / np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700)).sum(1)
        for i, b, s in zip(known, best, share, strict=True):
            preds[i], scores[i] = self.langs[b], float(s)
        return preds, scores


def _word_counts(some: DataFrame) -> DataFrame:
    """lang, word, n: of the words of lang, text."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in chunks(batches, 1, ROWS):
            seen: Counter = Counter()
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in map(bare, text.lower().split()) if w)
            langs, words = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    return some.select("lang", "text").mapInArrow(go, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, path: str, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """From rows of labelled; those without text or lang are left out."""
    marks = [F.xxhash64(F.col(key).cast("string")).alias("h"), F.xxhash64(F.col(text)).alias("t")]
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), *marks)
    # rows are chosen by their marks before their texts are looked up, so texts aren't sorted; equal rows count once
    chosen = rows.select("h", "lang", "t").distinct().orderBy("h", "lang", "t").limit(sample_docs)
    some = rows.join(F.broadcast(chosen), ["h", "lang", "t"]).dropDuplicates(["h", "lang", "t"])
    counted = _word_counts(some).toPandas().sort_values(["word", "lang"])
    langs = sorted(counted["lang"].unique())
    words, of = np.unique(counted["word"].to_numpy(object), return_inverse=True)
    counts = np.zeros((len(words), len(langs)))
    counts[of, [langs.index(x) for x in counted["lang"]]] = counted["n"]
    v = vocabulary(path)
    return Model(path, langs, fit(v, [MARK + w for w in words], counts) if len(words) else np.zeros((len(v.pieces) + 1, 0)))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred string, score double for each row."""
    lean(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # pieces by languages: bounded by the vocabulary
    name = f"langid-{uuid.uuid4().hex}"

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = kept(name, lambda: Scorer(sent.value))
        for part in chunks(batches, 1, ROWS):
            preds, scores = own.scores(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["key", "lang_pred", "score"])

    return rows.mapInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train(docs.filter(~held_out()), default_path())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
