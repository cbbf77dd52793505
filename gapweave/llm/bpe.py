"""Byte-pair encoding by tree concatenation, and decoding.

A text is halved until its parts are short (LEAF_CHARS); the parts are split and encoded
independently, then concatenated along the tree.  At each join a window around it is encoded
anew and grown until its outermost units equal those on either side, which proves the join:

* Splitting looks ahead a few characters and never behind.  If the window's first unit is the
  left side's, all before it stands; if its last unit starts where a unit of the right side
  starts, all after it stands.
* A sequence of tokens is the encoding of its bytes if each adjacent pair is the encoding of
  its own bytes.  If the window's outer tokens are unchanged, every pair of the joined
  sequence occurs in one of three valid encodings.

The same happens once more inside long units (one run of letters, say), over bytes.  Texts of more
than SPREAD_CHARS are halved into rows first, which different tasks encode.

Null text is encoded as empty; repeated rows give repeated rows; an empty table gives none; other
columns are ignored.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents, kept, lean

LEAF_CHARS = 4096
LEAF_BYTES = 256
SPREAD_CHARS = 1 << 20
#: A worker's cache of units starts anew at this size; it bounds memory, not results.
CACHE_UNITS = 100_000
KEEP_CHARS = 64
ROWS = 512

#: Ranges in which every Unicode version since 9 agrees on letters, digits and spaces; other text is
#: split by the tokenizer's own rules.
STEADY = re.compile("[^\x00-Ֆ -⁤₠-₽℀-↊←-⏺─-➿　-〿ぁ-ゖ゛-ヿ一-鿕가-힣！-～\U0001f300-\U0001f6d0]")
#: A space next to white space or an end isn't a plain separator.
ODD_SPACE = re.compile(r"\s | \s|^ | $")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE from a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        text_of = {i: t for t, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*text_of, *self.special.values()]) + 1)
        for i, t in text_of.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(ids) or any(spec["model"].get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: merges aren't in the order of their ids, or the model has other rules")
        ranks = {self.bytes_of[i]: i for i in text_of if i not in self.special.values()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pattern = regex.compile(pattern)
        # the library's splitter alone, without a second copy of the vocabulary
        bare = {"version": "1.0", "pre_tokenizer": spec["pre_tokenizer"], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.splitter = Tokenizer.from_str(json.dumps(bare))
        self.own_split = self.splitter.pre_tokenizer.pre_tokenize_str
        self.at_special = re.compile("|".join(f"({re.escape(t)})" for t in self.special) or r"(?!)")
        self.cache: dict[str, tuple[int, ...]] = {}

    # -- splitting -----------------------------------------------------------------------------

    def units_of_leaf(self, text: str) -> list[str]:
        """Units whose encodings are independent: words with the space before them, or the pattern's matches."""
        if not text.isascii() and STEADY.search(text):
            return [text[a:b] for _, (a, b) in self.own_split(text)]
        if ODD_SPACE.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else []

    def join_units(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        k = 1
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = self.units_of_leaf("".join(left[-a:] + right[:b]))
            if (a == len(left) or len(window) > 1 and window[0] == left[-a]) and (b == len(right) or len(window) > 1 and window[-1] == right[b - 1]):
                return left[:-a] + window + right[b:]
            k *= 2

    def units(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.units_of_leaf(text)
        half = len(text) // 2
        return self.join_units(self.units(text[:half]), self.units(text[half:]))

    # -- merging -------------------------------------------------------------------------------

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = self.leaf(b"".join(self.bytes_of[i] for i in left[-a:] + right[:b]))
            if (a == len(left) or len(window) > 1 and window[0] == left[-a]) and (b == len(right) or len(window) > 1 and window[-1] == right[b - 1]):
                return left[:-a] + window + right[b:]
            k *= 2

    def tokens(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        half = len(data) // 2
        return self.join_tokens(self.tokens(data[:half]), self.tokens(data[half:]))

    def tokens_of_unit(self, unit: str) -> list[int]:
        word = unit[1:] if unit[:1] == " " else unit
        if word.isalpha() or not unit.isascii() and STEADY.search(unit):  # letters alone are one match; other scripts are split already
            return self.tokens(unit.encode("utf-8", "replace"))
        parts = self.pattern.findall(unit)
        return self.tokens(unit.encode()) if len(parts) == 1 else list(chain.from_iterable(self.tokens(p.encode("utf-8", "replace")) for p in parts))

    def learn(self, units: set[str]) -> None:
        """Encode what the cache lacks; of what it holds, it keeps only units met again once it is full."""
        cache = self.cache
        new = units.difference(cache)
        if len(cache) + len(new) > CACHE_UNITS:
            cache = self.cache = {u: cache[u] for u in units if u in cache}
        of = self.tokens_of_unit
        cache.update({u: tuple(of(u)) for u in new if len(u) <= KEEP_CHARS})

    def tokens_of_units(self, units: list[str]) -> list[int]:
        try:
            return list(chain.from_iterable(map(self.cache.__getitem__, units)))
        except KeyError:
            self.learn(set(units))
        cache, of = self.cache, self.tokens_of_unit
        return list(chain.from_iterable([cache[u] if u in cache else of(u) for u in units]))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Of each text; the units of all are encoded once."""
        cut = [[p for p in (self.at_special.split(t) if self.at_special.search(t) else [t]) if p] if t else [] for t in texts]
        units = [[[p] if p in self.special else self.units(p) for p in parts] for parts in cut]
        self.learn({u for parts in units for us in parts for u in us})
        return [list(chain.from_iterable([self.special[p]] if p in self.special else self.tokens_of_units(us) for p, us in zip(parts, each, strict=True))) for parts, each in zip(cut, units, strict=True)]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> ByteBPE:
    return kept(f"bpe-{path}", lambda: ByteBPE(path))


def _arrow(key_type, keys: list, ids: list[list[int]], texts: list[str] | None):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    cols = [pa.array(keys, key_type), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
    return pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())], names=["key", "ids", "decoded"])


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """key, ids array<int>, decoded string: a row for each row of df; the text encoded whole, and its ids decoded."""
    lean(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, decoded string"

    def whole(batches: Iterator) -> Iterator:
        bpe = codec(path)
        for part in chunks(batches, 1, ROWS):
            ids = bpe.encode_all(part.column(1).to_pylist())
            yield _arrow(part.schema.field(0).type, part.column(0), ids, [bpe.decode(x) for x in ids])

    short = rows.filter(F.length("text") <= spread_chars).mapInArrow(whole, schema)
    long = _spread(rows.filter(F.length("text") > spread_chars), path, schema, spread_chars // 8 or 1)
    return short.unionByName(long).withColumnRenamed("key", key)


def _spread(rows: DataFrame, path: str, schema: str, chunk: int) -> DataFrame:
    """The same for giant texts, each dealt to many tasks; equal rows are encoded once and counted."""
    key_type = rows.schema["key"].dataType.simpleString()
    once = rows.groupBy("key", "text").agg(F.count("*").alias("copies")).withColumn("uid", F.sha2("text", 256))

    def cut(frames: Iterator) -> Iterator:
        import pandas as pd

        bpe = codec(path)
        for f in frames:
            for key, text, copies, uid in zip(f["key"], f["text"], f["copies"], f["uid"], strict=True):
                parts, at = [], 0
                for m in [*bpe.at_special.finditer(text), None]:
                    end = m.start() if m else len(text)
                    parts += [(text[i : min(i + chunk, end)], i == at) for i in range(at, end, chunk)]
                    if m:
                        parts.append((m[0], True))
                        at = m.end()
                yield pd.DataFrame({"key": key, "copies": copies, "uid": uid, "part": range(len(parts)), "chunk": [p for p, _ in parts], "starts": [s for _, s in parts]})

    def split(frames: Iterator) -> Iterator:
        bpe = codec(path)
        for f in frames:
            f["units"] = [[c] if c in bpe.special else bpe.units(c) for c in f["chunk"]]
            yield f.drop(columns="chunk")

    def join(f):
        import pandas as pd

        bpe = codec(path)
        f = f.sort_values("part")
        ids: list[int] = []
        runs: list[list[list[str]]] = []
        for units, starts in zip(f["units"], f["starts"], strict=True):
            if starts or not runs:
                runs.append([])
            runs[-1].append(list(units))
        for run in runs:
            while len(run) > 1:  # a tree: neighbours first
                run = [bpe.join_units(run[i], run[i + 1]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
            ids += [bpe.special[run[0][0]]] if len(run[0]) == 1 and run[0][0] in bpe.special else bpe.tokens_of_units(run[0])
        n = int(f["copies"].iloc[0])
        return pd.DataFrame({"key": [f["key"].iloc[0]] * n, "ids": [ids] * n, "decoded": [bpe.decode(ids)] * n})

    cuts = once.mapInPandas(cut, f"key {key_type}, copies long, uid string, part int, chunk string, starts boolean")
    dealt = cuts.repartition("uid", "part").mapInPandas(split, f"key {key_type}, copies long, uid string, part int, starts boolean, units array<string>")
    return dealt.groupBy("key", "uid").applyInPandas(join, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(documents(spark, sf_dir), default_path()))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
