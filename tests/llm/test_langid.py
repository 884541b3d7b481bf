"""Viterbi against all paths; languages and spans of small texts."""
import itertools

import numpy as np
from cases import no_documents, odd_documents

from evisets.llm import langid


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(0)
    for _ in range(60):
        k, sizes = r.integers(1, 4), r.integers(0, 6, 6)
        scores, at = r.normal(size=(sizes.sum(), k)).astype(np.float32) * 3, 0
        states = langid.viterbi(scores, sizes, 2.0)
        for n in sizes:
            s, path = scores[at : at + n], states[at : at + n]
            at += n
            value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
            if n:
                assert abs(max(map(value, itertools.product(range(k), repeat=int(n)))) - value(path)) < 1e-4


def training(spark):
    texts = {"en": "the dog and the cat are in the house with the children while they play", "fr": "le chien et le chat sont dans la maison avec les enfants qui jouent",
             "ru": "собака и кошка в доме с детьми которые играют весь день"}
    return spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(texts.items())] * 5, "doc_id long, text string, lang string")


def test_spans_of_mixed_text(spark):
    model = langid.fit(training(spark))
    docs = spark.createDataFrame([(1, "the children play with the dog in the house le chat et le chien sont dans la maison avec les enfants собака играют"), (2, "123 ???"), (3, None),
                                  (4, "日本語")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs, model, penalty=4.0).collect()}
    assert got[1].lang_pred == "fr" and [s.split(":")[0] for s in got[1].spans.split(",")] == ["en", "fr", "ru"] and 0 < got[1].score < 1
    assert (got[2].lang_pred, got[2].score, got[2].spans) == ("und", 0.0, "") == (got[3].lang_pred, got[3].score, got[3].spans)
    assert got[4].lang_pred in model.langs  # letters of a script that no language uses: some learned language


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 10}
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(no_documents(spark), langid.fit(docs)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(no_documents(spark))).collect()} == {"und"}


def test_long_texts_are_read_in_pieces(monkeypatch):
    model = langid.Model(("a", "b"), np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 2)), np.ones((len(langid.SCRIPTS), 2), bool))
    text = " ".join(np.random.default_rng(2).choice(["one", "zwei", "trois\n", "x" * 90], 3000))
    texts = [text, None, "", "one", text[:500]]
    whole = list(langid.label(model, langid.Words(model), texts, 0.0))
    monkeypatch.setattr(langid, "PIECE", 50)
    monkeypatch.setattr(langid, "KEEP_ENTRIES", 2)
    assert list(langid.label(model, langid.Words(model), texts, 0.0)) == whole
    assert "".join(langid.pieces(text)) == text and len(whole) == 5
