import random

import numpy as np
import pytest

from plantledger.llm.byte_cnn import LEAST_SCORE, STRIDE, TAPS, WINDOW, cut, drop_unidentified, fitted, identify, least_score, probabilities, train

SCHEMA = "doc_id long, text string, lang string, _lang int, _text string"
PARTS = {"en": ["the", "ing", "er", "wh", "st"], "de": ["ung", "ein", "sch", "ü", "keit"], "fr": ["eau", "oi", "é", "que", "ment"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 4))) for _ in range(n))


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, sentence(rng, lang := rng.choice(list(PARTS)), rng.randrange(4, 200)), lang, 0, "x") for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return fitted(spark.createDataFrame(rows(900, 1), SCHEMA))


def test_held_out_accuracy(spark, model):
    fresh = rows(300, 2)
    found = {r["_id"]: r for r in identify(spark.createDataFrame(fresh, SCHEMA), model).collect()}
    assert sum(found[i]["_lang"] == lang for i, _, lang, *_ in fresh) >= 0.97 * len(fresh)
    assert all(0 <= r["_score"] <= 1 for r in found.values())


def test_windows_cover_every_place():
    for size in [*range(1, 300), 5000]:
        data = bytes(i % 251 + 1 for i in range(size))
        windows = cut(data)
        assert windows.shape[1] == WINDOW and all(STRIDE * k < size for k in range(len(windows)))
        grams = {w.tobytes()[i:i + TAPS] for w in windows for i in range(WINDOW - TAPS + 1)}
        assert all(data[i:i + TAPS] in grams for i in range(size - TAPS + 1))


def test_windows_do_not_depend_on_company(model):
    rng = np.random.default_rng(0)
    windows = rng.integers(1, 255, (150, WINDOW)).astype(np.uint8)
    alone = np.concatenate([probabilities(model, windows[i:i + 1]) for i in range(len(windows))])
    assert np.allclose(alone, probabilities(model, windows), atol=1e-5)


def test_convolution_equals_plain_loops(model):
    window = cut("eine kleine über 12".encode())[0]
    best = np.full(model.filters.shape[1], -np.inf)
    for at in range(WINDOW - TAPS + 1):
        best = np.maximum(best, model.embedding[window[at:at + TAPS]].reshape(-1) @ model.filters)
    logits = np.maximum(best + model.filter_bias, 0) @ model.weights + model.bias
    assert np.allclose(np.exp(logits) / np.exp(logits).sum(), probabilities(model, window[None])[0], atol=1e-4)


def test_odd_rows(spark, model):
    odd = [(1, None, None, 0, ""), (2, "", "en", 0, ""), (3, "123 !?", "en", 0, ""), (4, "ung " * 100_000, None, 0, ""), (4, "ung " * 100_000, None, 0, ""),
           (None, "the whing sting", "en", 0, "")]
    frame = spark.createDataFrame(odd, SCHEMA)
    found = sorted((tuple(r) for r in identify(frame, model).collect()), key=repr)
    assert [r[:2] for r in found] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en")] and found[0][2] == 0.0
    kept = drop_unidentified(frame, model)
    assert kept.columns == frame.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, frame.where("doc_id is null or doc_id = 4").collect()))


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = fitted(empty)
    assert [r["_lang"] for r in identify(spark.createDataFrame([(1, "the", None, 0, "")], SCHEMA), none).collect()] == ["und"]
    assert identify(empty, none).count() == 0 and drop_unidentified(empty, none).count() == 0
    one = train([b"the thing"], ["en"])
    assert probabilities(one, cut(b"who")).tolist() == [[1.0]]


def test_low_scores_are_rejected(spark, model):
    rng = random.Random(3)
    junk = [(1000 + i, "".join(rng.choices("bjkpqvxyz", k=rng.randrange(20, 400))), None, 0, "x") for i in range(60)]
    fresh = rows(300, 2)
    frame = spark.createDataFrame(fresh + junk, SCHEMA)
    scores = {r["_id"]: r["_score"] for r in identify(frame, model).collect()}
    kept = {r["doc_id"] for r in drop_unidentified(frame, model).collect()}
    assert kept == {i for i, score in scores.items() if score >= LEAST_SCORE}
    assert len([i for i in kept if i < 1000]) >= 0.99 * len(fresh) and len([i for i in kept if i >= 1000]) < len(junk)


def test_a_table_without_labels_keeps_its_texts(spark):
    frame = spark.createDataFrame([(1, "the thing", None, 0, ""), (2, None, None, 0, ""), (3, "12 -", None, 0, ""), (3, "é", None, 0, "")], SCHEMA)
    kept = drop_unidentified(frame, fitted(frame))
    assert kept.columns == frame.columns and sorted(r["text"] for r in kept.collect()) == ["the thing", "é"]


def test_a_model_that_learned_little_rejects_little(spark, model):
    weak = fitted(spark.createDataFrame(rows(12, 1), SCHEMA))
    frame = spark.createDataFrame(rows(300, 2), SCHEMA)
    assert drop_unidentified(frame, weak).count() < 0.9 * 300
    assert drop_unidentified(frame, weak, least=least_score(weak, frame)).count() >= 0.97 * 300
    assert least_score(weak, frame.limit(0)) == 0.0 and 0 < least_score(model, frame) <= LEAST_SCORE


def test_the_least_score_is_measured_on_all_held_out_rows(spark, monkeypatch):
    from plantledger.llm import byte_cnn

    seen = rows(120, 3)
    model = train([r[1].encode()[:WINDOW] for r in seen], [r[2] for r in seen])
    frame = spark.createDataFrame([*rows(300, 4), (900, "q x", "en", 0, "x"), (900, "z", "de", 0, "x"), (None, "vw kk", "fr", 0, "x")], SCHEMA)
    scores = [r["_score"] for r in identify(frame, model).collect()]
    monkeypatch.setattr(byte_cnn, "SAMPLE", 5)
    for share in (0.0, 0.01, 0.3, 0.7):
        monkeypatch.setattr(byte_cnn, "LEAST_SHARE", share)
        monkeypatch.setattr(byte_cnn, "LEAST_SCORE", 1.0)
        assert least_score(model, frame) == np.quantile(scores, share, method="lower")
