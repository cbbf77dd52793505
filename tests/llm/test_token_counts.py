import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from gapweave.llm import token_counts as tc
from gapweave.llm.pieces import MARK, default_path, vocabulary


@pytest.fixture(scope="module")
def library():
    v = vocabulary(default_path())
    t = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores.tolist(), strict=True)), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    return t


ODD = ["", " ", "  a", "a", "▁x", "a  b ", "line\nfeed é 漢字\t🫨🫨 ñ", "x" * 300, "é🫨" * 100, "<s> <0x0A> </s>", "\x00\x01", " ".join(["the"] * 3000)]


def test_equals_library(library):
    texts = ODD.copy()
    rng = random.Random(3)
    texts += ["".join(rng.choice(["a", "e", "th", "in", " ", "ing", "é", "\n", "x", "q", "漢", "🫨", "tion", "."]) for _ in range(n)) for n in (1, 2, 5, 20, 400) for _ in range(60)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tc.Counter(default_path()).counts(texts) == want


def test_ties(library):
    """A vocabulary in which most segmentations tie."""
    from gapweave.llm.pieces import Pieces

    import numpy as np

    v = Pieces.__new__(Pieces)
    v.pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "bab", "▁a", "▁ab", "aab"]
    v.scores = np.array([0.0, -1, -1, -1, -2, -2, -3, -3, -2, -3, -3])
    v._build()
    t = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores.tolist(), strict=True)), unk_id=0, byte_fallback=False))
    rng = random.Random(1)
    words = [MARK + "".join(rng.choice("ab") for _ in range(n)) for n in range(1, 60) for _ in range(5)]
    assert tc.viterbi_counts(v, words) == [len(t.encode(w).ids) for w in words]


def test_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (1, "twice"), (1, "twice"), *enumerate(ODD)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in tc.token_counts(df, default_path()).collect())
    assert got == sorted((i or -1, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert tc.token_counts(df.limit(0), default_path()).count() == 0
