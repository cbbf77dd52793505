import math

import numpy as np

from gapweave.llm import langid
from gapweave.llm.pieces import MARK, default_path, vocabulary


def brute(v, probs, word):
    """Sum over all segmentations, recursively."""
    ids = {p: i for i, p in enumerate(v.pieces)}

    def total(at):
        if at == len(word):
            return 1.0
        got = langid.LONE * total(at + 1) if word[at] not in v.singles else 0.0
        return got + sum(probs[ids[word[at:e]]] * total(e) for e in range(at + 1, len(word) + 1) if word[at:e] in ids)

    return total(0)


def test_all_segmentations():
    v = vocabulary(default_path())
    rng = np.random.default_rng(0)
    probs = rng.random((len(v.pieces) + 1, 2)) * 0.01
    probs[-1] = langid.LONE
    words = [MARK + w for w in ("the", "a", "", "étre", "ing🫨a", "reading", "schön")]
    got = langid.log_probabilities(v, probs, words)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert math.isclose(row[k], math.log(brute(v, probs[:, k], w)), rel_tol=1e-9)
            assert math.isclose(langid._long(v, probs, w)[k], row[k], rel_tol=1e-9)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    own = [r for r in rows if r.held_out]
    assert len(own) > 150 and sum(r.lang == r.lang_pred for r in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    data = [(1, "the cat and the dog", "en", "x"), (2, "le chat et la souris", "fr", "x"), (3, None, "fr", "x"), (4, "?? 12", None, "x"), (5, "", "en", "x"), (None, "la souris " * 5000 + "x" * 5000, None, None), (2, "le chat", "fr", "x")]
    df = spark.createDataFrame(data, schema)
    model = langid.train(df, default_path())
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.predict(df, model).collect()))
    assert got == [(0, "fr"), (1, "en"), (2, "fr"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")]
    none = langid.train(df.limit(0), default_path())
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def segmentations(v, word):
    """All lists of (piece id) that spell the word; the lone character has the id after the last."""
    ids = {p: i for i, p in enumerate(v.pieces)}
    if not word:
        return [[]]
    out = [[ids[word[:e]], *rest] for e in range(1, len(word) + 1) if word[:e] in ids for rest in segmentations(v, word[e:])]
    return out + ([[len(v.pieces), *rest] for rest in segmentations(v, word[1:])] if word[0] not in v.singles else [])


def test_expected_pieces_by_brute_force():
    v = vocabulary(default_path())
    rng = np.random.default_rng(1)
    probs = langid.normalised(rng.random((len(v.pieces) + 1, 2)))
    words, counts = [MARK + w for w in ("the", "🫨a", "schön", "readi", "a")], rng.integers(1, 9, (5, 2))
    order = sorted(range(5), key=lambda i: len(words[i]))
    own = [words[i] for i in order]
    got = langid._expected(langid.scaled(v, probs), np.array([len(w) for w in own]), counts[order], *langid._lattice(v, own))
    want = np.zeros_like(got)
    for w, c in zip(words, counts, strict=True):
        ways = segmentations(v, w)
        weight = np.array([probs[s].prod(0) for s in ways])
        for s, share in zip(ways, weight / weight.sum(0), strict=True):
            np.add.at(want, s, share * c)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_rare_and_long_words_keep_their_evidence():
    """The table and the scaled walk agree however unlikely the word and whatever its length."""
    v = vocabulary(default_path())
    rng = np.random.default_rng(2)
    probs = langid.normalised(rng.random((len(v.pieces) + 1, 2)) ** 40 * 1e9)
    words = [MARK + w for w in ("ǂʘ" * 18, "Ωж" * 17, "ǂ" * 39, "z" * 39, "ξψ" * 15)]
    got = langid.log_probabilities(v, probs, words)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(langid._long(v, probs, w), row, rtol=1e-9)
        assert row[0] != row[1] or set(w[1:]) <= set("ǂʘ")
    joined = [w[:20] + w[1:] for w in words]  # beyond the table: the same by steps
    assert np.isfinite(langid.log_probabilities(v, probs, joined)).all()


def test_whole_text_by_brute_force(spark):
    """Score and prediction of texts from word probabilities, without caches or slices."""
    data = [(i, t, lang) for i, (t, lang) in enumerate([("the reading, of a thing", "en"), ("la souris et le chat", "fr"), ("das Haus (ist) schön", "de"), ("12 the! -- le", "en"), ("the the the la", "fr")])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(df, default_path())
    v = vocabulary(default_path())
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for i, text, _ in data:
        ws = [w.strip("12(),!-") for w in text.lower().split()]
        logs = [sum(math.log(brute(v, model.probs[:, k], MARK + w)) for w in ws if w) for k in range(len(model.langs))]
        best = max(range(len(logs)), key=lambda k: logs[k])
        assert got[i].lang_pred == model.langs[best]
        assert math.isclose(got[i].score, 1 / sum(math.exp(x - max(logs)) for x in logs), rel_tol=1e-6)


def test_long_words_are_learned_from():
    v = vocabulary(default_path())
    a = langid.fit(v, [MARK + "thing" * 30, MARK + "souris" * 30], np.array([[5.0, 0], [0, 5]]))
    logs = langid.log_probabilities(v, a, [MARK + "thingthing", MARK + "sourissouris"])
    assert logs[0][0] > logs[0][1] and logs[1][1] > logs[1][0]
