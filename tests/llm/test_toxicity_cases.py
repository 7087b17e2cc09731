"""Toxicity: the byte budget, log-odds without a text's own count, steps that stay bounded, and the cases of the docstring."""

import numpy as np
import pytest

from lacuna.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score double, Predicted string"
WORDS = ["stone", "river", "house", "green", "table", "north", "light", "paper"]


def rows(n=240):
    """Every fourth text holds a bad word; texts 200 and on repeat those before."""
    text = lambda i: " ".join(WORDS[(i * k) % 8] for k in range(1, 12)) + f" w{i % 97}" + (" idiot scum" if i % 4 == 0 else "")
    return [(i, text(i % 200), "en", 0.5, "x") for i in range(n)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (500, None)], "doc_id long, toxic int")


def test_cases(spark, labels):
    extra = [(500, None, None, None, None), (501, "", "en", 0.1, "y"), (502, " \n", None, None, None), (503, "stone " * 200_000 + "idiot", "en", 0.0, "z"), (None, "idiot scum", None, None, None)]
    docs = spark.createDataFrame(rows() + extra, SCHEMA)
    model = toxicity.train(docs, labels)
    found = toxicity.score_documents(docs, model)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(240))
    assert got[0].score == got[200].score  # a repeated text has the same score
    assert got[500].score == got[501].score == got[502].score < 0.5
    assert got[503].predicted == 1 and got[None].predicted == 1 and got[None].held_out is None
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in range(240) if i % 4} | {500, 501, 502}


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], SCHEMA)
    model = toxicity.train(none, labels)
    assert not model.trained and toxicity.score_documents(none, model).count() == toxicity.drop_toxic(none, model).count() == 0
    assert not toxicity.train(spark.createDataFrame(rows(), SCHEMA), labels.limit(0)).trained


def test_texts_beyond_the_budget_are_left_out(spark, labels, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.ToxicityModel, "fit", lambda self, texts, labels: seen.append(texts) or self)
    docs = spark.createDataFrame(rows() + [(1, "long " * 50_000, "en", 0.5, "x"), (2, None, "en", 0.5, "x")], SCHEMA)
    toxicity.train(docs, labels, budget=4_000)
    toxicity.train(docs, labels)
    size = lambda texts: sum(len((t or "").encode()) for t in texts)
    few, all_ = seen
    assert 3_500 < size(few) <= 4_000 and None in few and not any((t or "").startswith("long ") for t in few)
    assert size(all_) > 250_000 and len(all_) > len(few)
    toxicity.train(docs, labels, budget=4_000)
    assert seen[2] == few


def test_a_text_meets_the_log_odds_without_itself():
    model = toxicity.ToxicityModel()
    train = [([[7], [9]], 1, "en"), ([[7]], 1, "en"), ([[7]], 0, "en"), ([[7]], 0, "en")]
    without = model._log_odds(train, 0.5)
    odds = lambda n, t: np.log((t + toxicity.PRIOR * 0.5) / (n + toxicity.PRIOR) / 0.5) if n >= toxicity.LEAST_TEXTS else 0.0
    assert model.table[7, 0] == pytest.approx(odds(4, 2), abs=1e-6) and model.table[9, 0] == 0
    assert model.table[7, 0] + without[1][7] == pytest.approx(odds(3, 1), abs=1e-6)
    assert model.table[7, 0] + without[0][7] == pytest.approx(odds(3, 2), abs=1e-6)


def test_large_values_do_not_throw_the_weights_off():
    model = toxicity.ToxicityModel()
    model.table[5] = 1e4
    flat = np.zeros(toxicity.BUCKETS, np.float32)
    for i in range(50):
        model._train_one([[5]] * 3, i % 2, 3.0, 0.08, flat)
    assert all(np.isfinite(w).all() for w in (model.table, model.out, *model.kernels, *model.offsets))
    assert np.abs(model.out).max() < 50 * toxicity.CLIP


@pytest.mark.parametrize("few, most", [(toxicity.FEW_POSITIVES, 8), (0, 76)])
def test_few_positives_do_not_turn_the_model_round(spark, monkeypatch, few, most):
    """On the smallest table's 10 positives; where a text's own count is left out whole, clean texts go."""
    monkeypatch.setattr(toxicity, "FEW_POSITIVES", few)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels))
    rejected = scored.join(labels.where("toxic = 0"), "doc_id").where("predicted = 1").count()
    assert rejected <= most and (few or rejected > 8)


def test_coded_texts_are_the_lists_in_few_bytes():
    coded, lists = toxicity.Coded(), [[f"word{(i * k) % 997}" for k in range(50)] for i in range(40)]
    for words in lists:
        text, plain = coded.text(words), [toxicity.features(w) for w in words]
        assert [*text] == plain and len(text) == len(plain)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(toxicity.flat_of(text), toxicity.flat_of(plain), strict=True))
        assert text.numbers.nbytes == 4 * len(words)


def test_training_holds_no_text_that_is_coded(monkeypatch):
    import sys

    held, language_of = [], toxicity.language_of
    texts = ["".join(r[1:2]) for r in rows(40)]
    monkeypatch.setattr(toxicity, "language_of", lambda words: held.append(len(sys._getframe(1).f_locals["seen"])) or language_of(words))
    distinct = len(set(texts))
    toxicity.ToxicityModel().fit(texts, [0] * len(texts))
    assert held == list(range(distinct - 1, -1, -1))
