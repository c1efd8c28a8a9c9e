"""The language labels: forward-backward against all paths, slopes against differences, held-out accuracy, defined cases."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from folioforge.llm import word_languages as wl
from folioforge.llm.queries_language import op12_word_languages

SF = "/root/testdata/sf0.01"


def small_model(k=3, seed=1):
    rng = np.random.default_rng(seed)
    weights = rng.standard_normal((wl.BUCKETS + wl.LEXICON + 2, k)).astype(np.float32)
    weights[-1] = 0
    return wl.Model(list("abc"[:k]), weights, np.zeros(0, np.uint64), rng.standard_normal((k, k)), rng.standard_normal(k))


def test_forward_backward_against_all_paths():
    model = small_model()
    words = wl.Words(["one deux trois four", "", "é", "five six sept"])
    got = wl.posteriors(model, words)
    e = np.concatenate([model.scores(z, s) for _, _, z, s in words.pieces()])
    for text in (0, 2, 3):
        at = np.flatnonzero(words.text == text)
        want = np.zeros((len(at), 3))
        for path in itertools.product(range(3), repeat=len(at)):
            w = np.exp(model.begin[path[0]] + sum(e[i, j] for i, j in zip(at, path)) + sum(model.moves[i, j] for i, j in zip(path, path[1:])))
            want[range(len(at)), path] += w
        assert np.allclose(got[at], want / want.sum(1, keepdims=True))


def test_lanes_are_one_chain():
    rng = np.random.default_rng(4)
    p, moves, begin = rng.random((977, 4)), np.exp(rng.standard_normal((4, 4))), rng.random(4)
    first = rng.random(977) < 0.01
    first[0] = True
    alpha, beta = wl.forward_backward(p, first, moves, begin)
    a, want = None, []
    for x, f in zip(p, first):
        a = (begin if f else a @ moves) * x
        want.append(a := a / a.sum())
    assert np.allclose(alpha, want)
    post = alpha * beta / (alpha * beta).sum(1, keepdims=True)
    for lo, hi in zip(np.flatnonzero(first), [*np.flatnonzero(first)[1:], 977]):
        a, b = wl.forward_backward(p[lo:hi], first[lo:hi], moves, begin)
        assert np.allclose(post[lo:hi], a * b / (a * b).sum(1, keepdims=True))


def test_slopes():
    model = small_model()
    words = wl.Words(["un petit text of words und noch mehr"])
    gold, first = np.array([0, 0, 1, 1, 1, 2, 2, 2]), np.arange(8) % 4 == 0
    by_weight, by_move, by_begin, _ = wl.gradient(model, words, gold, first)
    step = 1e-3
    feature = int(np.abs(by_weight).sum(1).argmax())
    for array, at, slope in ((model.weights, (feature, 1), by_weight[feature, 1]), (model.moves, (0, 1), by_move[0, 1]), (model.begin, (2,), by_begin[2])):
        ends = []
        for change in (step, -2 * step):
            array[at] += change
            ends.append(wl.gradient(model, words, gold, first)[3])
        array[at] += step
        assert (ends[0] - ends[1]) / (2 * step) == pytest.approx(slope, rel=0.02, abs=1e-4)


def test_features_stay_in_their_word():
    """A word has the same score whatever stands around it, and pieces change nothing."""
    model = small_model()
    text = "straße  a Ête-vous, 12x naïve's été 漢字 " * 3
    words = wl.Words([text, "", "..", text])
    assert [text[b : b + n] for b, n in zip(words.begin[: len(words) // 2], words.length)] == re.findall(r"(?:[^\W\d_]|́)+", text)
    e = np.concatenate([model.scores(z, s) for _, _, z, s in words.pieces()])
    alone = [wl.Words([w]) for w in ("straße", "a", "ête", "vous", "x")]
    for i, w in enumerate(alone):
        assert np.allclose(model.scores(w.z, w.start), e[i], atol=1e-4)
    before, wl.SLICE = wl.SLICE, 5
    try:
        assert np.allclose(np.concatenate([model.scores(z, s) for _, _, z, s in words.pieces()]), e, atol=1e-4)
    finally:
        wl.SLICE = before


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", wl.held_out().alias("held_out"))
    return wl.fit(wl.training_runs(docs.where("NOT held_out")))


def test_held_out_accuracy(spark):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op12_word_languages(spark, SF).collect()}
    assert got.keys() == lang.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    told = [(r.lang_pred, lang[i][0]) for i, r in got.items() if r.held_out]
    assert sum(a == b for a, b in told) >= 0.98 * len(told)


def test_code_switched_words(spark, model):
    """Pieces of held-out documents of different languages, one after the other: words are labelled by their piece."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(wl.held_out()).collect()
    rng = random.Random(3)
    rows, truth = [], {}
    for n in range(60):
        text, spans = "", []
        for _ in range(4):
            r = rng.choice(docs)
            words = [w for w in r.text.split() if w.isalpha()]
            at = rng.randrange(max(1, len(words) - 12))
            piece = " ".join(words[at : at + 12])
            spans.append((len(text), len(text) + len(piece), r.lang))
            text += piece + " "
        rows.append((n, text))
        truth[n] = spans
    got = wl.label_languages(spark.createDataFrame(rows, "doc_id long, text string"), model, with_runs=True)
    right = total = 0
    for r in got.collect():
        for a, b, lang in truth[r.doc_id]:
            total += b - a
            right += sum(max(0, min(b, x.end) - max(a, x.start)) for x in r.runs if x.lang == lang)
    assert right >= 0.9 * total


def test_defined_cases(spark, model):
    en = next(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND length(text) > 3000").take(1))
    rows = [(1, None), (2, ""), (3, "12 .. ́"), (4, en), (4, en), (None, en), (5, en * 400), (6, "é"), (7, en.upper())]
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in wl.label_languages(docs, model).collect()]
    assert [(i, p) for i, p, _ in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "en"), (5, "en"), got[7][:2], (7, "en")]
    assert got[0][2] == got[1][2] == got[2][2] == 0 and got[3] == got[4] and got[7][1] in model.langs
    full = spark.createDataFrame([(*r, lang, 1) for r, lang in zip(rows, ["en", "fr", None, "en", "en", "", "en", "fr", "en"])], "doc_id long, text string, lang string, held_out int")
    assert {r.lang_pred for r in wl.predict_languages(full).collect()} <= {"und", "en", "fr", ""}
    unlabelled = wl.predict_languages(full.withColumn("lang", full["lang"].substr(9, 1)).where("lang IS NULL"))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}
    assert wl.predict_languages(full.limit(0)).count() == 0


def test_training_ignores_order():
    runs = [("en", "the words of this text are english"), ("fr", "les mots de ce texte sont des mots")] * 20
    a, b = wl.fit(runs), wl.fit(runs[::-1])
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()
