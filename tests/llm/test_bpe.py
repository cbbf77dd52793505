import hashlib
import random

import pytest
from tokenizers import Tokenizer

from gapweave.llm import bpe

PATH = bpe.default_path()
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "It's  the\n\n end,\tof 3 things.", "'ll" * 30 + "x'" + "re", "<|endoftext|>a<|endoftext|><|endoftext|> b",
    "x" * 5000, "ab" * 3000 + "!" * 3000, " " * 9000 + "z", "日本語のテキスト" * 700, "՘࢏ x \U0001fae8́é", "é́🙂🙂 " * 1500, "1234567890" * 600, "a\x1cb \x1f c d　e\x85f",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_equals_library(library):
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["a", "'", "l", "s", " ", "  ", "\n", "1", "é", "漢", "!", "tion", " ", "<|endoftext|>"]) for _ in range(n)) for n in (3, 50, 4000, 9000) for _ in range(12)]
    own = bpe.codec(PATH)
    for t in [x for x in TEXTS if x] + mixed:
        want = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got == want, t[:80]
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_steady_ranges(library):
    """Both splitters class every code point of the steady ranges alike."""
    own = bpe.codec(PATH)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and not bpe.STEADY.match(chr(c)):
            s = f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)}b"
            assert [x[1] for x in own.own_split(s)] == [m.span() for m in own.pattern.finditer(s)], hex(c)


def test_tables(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "null id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for spread in (1 << 20, 64):
        got = sorted((r.doc_id or -1, tuple(r.ids), r.decoded) for r in bpe.encode_decode(df, PATH, spread_chars=spread).collect())
        want = sorted((i or -1, tuple(e := library.encode(t or "", add_special_tokens=False).ids), library.decode(e, skip_special_tokens=False)) for i, t, _ in rows)
        assert got == want
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0
    one = bpe.digests(bpe.encode_decode(df.filter("doc_id = 7"), PATH)).first()
    ids = library.encode(TEXTS[7], add_special_tokens=False).ids
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TEXTS[7].encode()).hexdigest())
