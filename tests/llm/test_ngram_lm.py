import math
import re
from collections import Counter

from gapweave.llm import ngram_lm as lm


def brute(rows, order):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = [Counter(tuple(ws[i : i + n]) for ws in split for i in range(len(ws) - n + 1)) for n in range(1, order + 1)]
    total = sum(map(len, split))

    def s(gram):
        if len(gram) == 1:
            return count[0][gram] / total
        c = count[len(gram) - 1][gram]
        return c / count[len(gram) - 2][gram[:-1]] if c >= 2 else 0.4 * s(gram[1:])

    return sorted((d if d is not None else -1, len(ws), round(sum(math.log(s(tuple(ws[max(0, i - order + 1) : i + 1]))) for i in range(len(ws))), 5)) for (d, _), ws in zip(rows, split, strict=True))


def got(df, order):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, round(r.score, 5) + 0.0) for r in lm.backoff_scores(df, order=order).collect())


def same(a, b):
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(abs(x[2] - y[2]) < 1e-3 for x, y in zip(a, b, strict=True))


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_DOCS", 3)
    monkeypatch.setattr(lm, "BUCKET_DOCS", 2)
    rows = [(1, "a b c a b c a b"), (2, "a b d"), (2, "a b d"), (3, None), (4, ""), (5, " \t\n"), (None, "the the the the"), (6, "x"), (7, "b c a b é\x1cé " * 400), (8, "a  b\nc")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    for order in (1, 2, 3):
        same(got(df, order), brute(rows, order))
    same(got(df.filter("doc_id in (3, 4)"), 3), [(3, 0, 0.0), (4, 0, 0.0)])
    assert got(df.limit(0), 3) == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same(got(docs, 3), brute([tuple(r) for r in docs.collect()], 3))
