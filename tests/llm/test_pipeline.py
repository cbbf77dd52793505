import hashlib

from tokenizers import Tokenizer

import corpus_pipeline as cp
from gapweave.llm import bpe, mixing, pii, toxicity
from gapweave.llm.common import table

from .test_jaccard import brute


def test_against_brute_force(spark):
    """Every stage on the rows its predecessor kept, held against a plain version."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    net = toxicity.train(toxicity.labelled(docs, table(spark, sf, "labels")))
    order = sorted(rows)
    score = toxicity.scores(net, [rows[i].text for i in order])
    left = {i: rows[i].text for i, s in zip(order, score, strict=True) if s < toxicity.THRESHOLD}
    clean = cp.without_toxic(spark, docs, sf)
    assert {r.doc_id: r.text for r in clean.collect()} == left and clean.columns == docs.columns
    left = {d: left[d] for d, _, c in brute(list(left.items()), 5, 80) if d == c}
    single = cp.one_of_each(spark, clean, sf)
    assert {r.doc_id: r.text for r in single.collect()} == left and single.columns == docs.columns
    redacted = cp.without_pii(spark, single, sf)
    after = {r.doc_id: r for r in redacted.collect()}
    assert set(after) == set(left) and redacted.columns == docs.columns
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in after.values())
    copies = {r.doc_id: r.copies for r in mixing.counted(redacted).collect()}
    mix = cp.mixed(spark, redacted, sf)
    assert sorted(r.doc_id for r in mix.select("doc_id").collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    t = Tokenizer.from_file(bpe.default_path())
    want = sorted((i, tuple(t.encode(after[i].text, add_special_tokens=False).ids)) for i, n in copies.items() for _ in range(n))
    out = cp.run(spark, sf).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in out) == want
    assert all(r.n_tokens == len(r.ids) and r.text_sha256 == hashlib.sha256(after[r.doc_id].text.encode()).hexdigest() for r in out)


def test_odd_rows(spark):
    data = [(1, "one two three four five six", "en", "a", 3), (1, "one two three four five six", "en", "a", 3), (2, "One two three four five six", None, None, None), (3, None, None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "mail x@y.com now and then again", "en", "b", 1), (5, "w " * 9000, "en", "b", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id or -1) for r in cp.one_of_each(spark, docs, "").collect())
    assert kept == [-1, 1, 3, 3, 4, 5]
    for stage in (cp.one_of_each, cp.without_pii, cp.mixed):
        assert stage(spark, docs.limit(0), "").count() == 0
    assert cp.tokens(spark, cp.mixed(spark, cp.without_pii(spark, docs, ""), ""), "").count() > 0


def test_empty_and_odd_tables_in_every_stage(spark, tmp_path):
    """Toxicity and tokens, too: no rows, no labels, clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"
    docs = spark.createDataFrame([(1, None, None, None, None, 0.5, "x"), (2, "", "en", "a", 0, 0.5, "x"), (3, "some words here", "en", "a", 15, 0.5, "x"), (None, "w " * 30_000, None, "b", None, 0.5, "x")], schema)
    for name, rows in (("none", []), ("some", [(3, 0, 1), (2, 1, 0)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    for name, stage in cp.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path / "none"))
        assert out.count() == 0 and (name == "bpe" or out.columns == cp.COLUMNS)
    assert cp.without_toxic(spark, docs, str(tmp_path / "none")).count() == 4
    assert {r.doc_id for r in cp.without_toxic(spark, docs, str(tmp_path / "some")).collect()} <= {1, 2, 3, None}
    tokens = {r.doc_id: r for r in cp.tokens(spark, docs, "").collect()}
    assert tokens[1].n_tokens == tokens[2].n_tokens == 0 and tokens[None].n_tokens > 30_000
