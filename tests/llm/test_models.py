"""Held-out accuracy and edge cases of the trained operators."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sedimark.llm import labels, langid, letters, quality, toxicity
from sedimark.session import table

SF = "/root/testdata/sf0.01"


def held(doc_id, folds, which):
    return zlib.crc32(str(doc_id).encode()) % folds == which


def check_edges(spark, score):
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "plain words here"), (4, "1234 !!"), (5, "w " * 100_000)], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS held_out")
    rows = score(odd).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert score(odd.limit(0)).count() == 0
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_labelled_models(spark, which):
    op = {"toxic": toxicity, "quality": quality}[which]
    sf = SF.replace("0.01", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = op.fit(docs, labels)
    rows = op.score(docs.join(labels, "doc_id"), model).join(labels, "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows) and len(test) > 40
    right = sum(r.predicted == r[which] for r in test) / len(test)
    assert right >= 0.93
    check_edges(spark, lambda d: op.score(d, model))
    empty = op.fit(docs.limit(0), labels)
    assert op.score(docs, empty).limit(3).count() == 3


def test_offending_sentence_is_located(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    text = "The weather is fine today. You are a stupid idiot and scum. We walk home."
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    upper = toxicity.score(spark.createDataFrame([(1, "İİİİİİİİ. " + text)], "doc_id long, text string"), model).first()
    assert (upper.worst_start, upper.worst_end) == (row.worst_start + 10, row.worst_end + 10)
    assert row.predicted == 1 and "idiot" in text[row.worst_start : row.worst_end] and "weather" not in text[row.worst_start : row.worst_end]


def test_noisy_or_by_definition():
    s = toxicity.sentences(["a b. c d! e", None, "", "x"])
    weights = np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32)
    m = toxicity.Model(weights, -1.0)
    p = 1 / (1 + np.exp(-m.logits(s)))
    want = [1 - np.prod(1 - p[s.row == r]) for r in range(4)]
    assert np.allclose(m.scores(s, 4), want)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 5, 8])
    u, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, z = quality.marginals(u, trans, first)
    total = np.zeros((2, 2))
    for d in range(3):
        lo, hi = first[d], first[d + 1]
        mass, mean = 0.0, np.zeros(hi - lo)
        pairs = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=hi - lo):
            s = np.exp(sum(u[lo + i] * y for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            mass += s
            mean += s * np.array(path)
            for a, b in itertools.pairwise(path):
                pairs[a, b] += s
        assert np.allclose(good[lo:hi], mean / mass) and np.isclose(z[d], np.log(mass))
        total += pairs / mass
    assert np.allclose(pair, total)


def test_noisy_or_slopes_are_the_likelihood_s():
    rng = np.random.default_rng(5)
    row = np.repeat(np.arange(6), [1, 4, 2, 1, 3, 5])
    z, toxic, balance = rng.normal(size=len(row)) * 2 - 1, np.array([1, 0, 1, 0, 1, 0]), rng.random(6)
    _, slope = toxicity.likelihood(z, row, toxic, balance)
    for i in range(len(z)):
        step = np.zeros(len(z))
        step[i] = 1e-5
        up, down = (toxicity.likelihood(z + s, row, toxic, balance)[0] for s in (step, -step))
        assert np.isclose((up - down) / 2e-5, slope[i], rtol=1e-4, atol=1e-8)


def test_field_slopes_are_the_likelihood_s():
    rng = np.random.default_rng(6)
    first = np.array([0, 1, 5, 8, 15])
    task = quality.Task(rng.normal(size=(15, 4)), rng.integers(0, 2, 15).astype(float), first, rng.random(4), 0.03)
    w, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    _, g, gt = task.gradient(w, trans)
    for slope, at, move in [(g[i], i, 0) for i in range(4)] + [(gt[a, b], (a, b), 1) for a in (0, 1) for b in (0, 1)]:
        step = [np.zeros(4), np.zeros((2, 2))]
        step[move][at] = 1e-5
        up, down = (task.gradient(w + k * step[0], trans + k * step[1])[0] for k in (1, -1))
        assert np.isclose((up - down) / 2e-5, slope, rtol=1e-4, atol=1e-7)


def test_samples_are_bounded_and_sure(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * (2000 if i == 9 else 3)) for i in range(60)] + [(60, None)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(4, 1), (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = labels.sample(docs, known, "doc_id", "text", "toxic", 100)
    assert {i for i, _, _ in got} == set(range(60)) - {4} and all(c == i % 2 for i, _, c in got)
    assert len(labels.sample(docs, known, "doc_id", "text", "toxic", 5)) == 10
    monkeypatch.setattr(labels, "SAMPLE_BYTES", 1000)  # 500 a class, and 62 a text
    got = labels.sample(docs, known, "doc_id", "text", "toxic", 100)
    assert got and 9 not in {i for i, _, _ in got}
    assert all(sum(len(t) for _, t, c in got if c == k) <= 500 for k in (0, 1))


def test_line_features_cover_each_row():
    x, size, first = quality.line_features(pa.array(["a\nb b b", None, "", "É!!\n\nx"], pa.string()))
    assert first.tolist() == [0, 2, 3, 4, 7] and size.tolist() == [1, 5, 0, 0, 4, 0, 1] and len(x) == 7


@pytest.mark.parametrize("seed", range(15))
def test_viterbi_by_plain_recursion(seed):
    rng = np.random.default_rng(seed)
    k, sizes = 200 if seed > 11 else int(rng.integers(1, 5)), rng.integers(1, 150, 5)
    row, switch = np.repeat(np.arange(5) * 2, sizes), 3.0
    scores = np.round(rng.normal(size=(len(row), k)) * (4, 0.2, 1)[seed % 3] * 1024) / 1024
    scores[rng.random(len(row)) < (0, 0.9, 0.3)[seed % 3]] = 0  # words that say nothing
    path = langid.viterbi(scores, row, switch, 8)
    for r in np.unique(row):
        e, p = scores[row == r], path[row == r]
        best = e[0]
        for x in e[1:]:
            best = x + np.maximum(best, best.max() - switch)
        assert np.isclose(e[np.arange(len(p)), p].sum() - switch * (p[1:] != p[:-1]).sum(), best.max())


def test_words_keep_their_places():
    texts = ["İSTANBUL'DA İyi", "\u0301\u0301", "\u0301abc é\u0301 \u0301", "\U00030000\U00030001 x", "", None, "ÀÉ ǅ"]
    w = langid.words_of(texts)
    found = [[] for _ in texts]
    for r, a, b, n in zip(w.row, w.start, w.end, w.size, strict=True):
        found[r].append((texts[r][a - w.base[r] : b - w.base[r]], n))
    assert found == [[("İSTANBUL", 8), ("DA", 2), ("İyi", 3)], [], [("abc", 3), ("é\u0301", 1)], [("\U00030000\U00030001", 2), ("x", 1)], [], [], [("ÀÉ", 2), ("ǅ", 1)]]
    assert (langid.words_of(["ABCÀ"]).grams == langid.words_of(["abcà"]).grams).all()
    assert all(letters.lowered(np.array([ord(c)]))[0] == ord(c.lower()) for c in "AZÀŐΣЖ")


def test_many_languages_fit_the_model_s_bytes():
    assert langid.bits_for(4) == langid.BITS
    for k in (100, 1000):
        assert 8 * k << langid.bits_for(k) <= langid.MODEL_BYTES
    rng = np.random.default_rng(0)
    langs = [f"l{i:03d}" for i in range(150) for _ in range(6)]
    words = {c: ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(12)] for c in set(langs)}
    texts = [" ".join(rng.choice(words[c], 30)) for c in langs]
    share, _, _ = langid._shares(model := langid.train(texts, langs), texts)
    assert np.mean([model.languages[k] == c for k, c in zip(share.argmax(1), langs, strict=True)]) > 0.97


def test_languages(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in test) / len(test) >= 0.97
    by = check_edges(spark, lambda d: langid.identify(d, model))
    assert by[1].lang_pred == by[2].lang_pred == by[4].lang_pred == "und" and by[4].score == 0
    none = langid.fit(docs.limit(0))
    assert none is None and {r.lang_pred for r in langid.identify(docs.limit(5), none).collect()} == {"und"}
    first, second = (next(r.text for r in docs.collect() if r.lang == x and len(r.text) < 900) for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, first + "\n" + second)], "doc_id long, text string")
    found = {s["lang"] for s in langid.identify(mixed, model, with_spans=True).first()["spans"]}
    assert {"en", "de"} <= found
    odd = spark.createDataFrame([(1, "İİİİ " + first), (2, "\u0301\u0301 1"), (3, "\U00030000")], "doc_id long, text string")
    by = {r.doc_id: r for r in langid.identify(odd, model, with_spans=True).collect()}
    assert by[1].lang_pred == "en" and by[1].spans[-1].end <= len(first) + 5 and by[2].lang_pred == "und" and by[3].lang_pred != "und"
    odd = spark.createDataFrame([(1, "123"), (2, first), (None, "")], "doc_id long, text string")
    assert {r.doc_id for r in langid.keep_identified(odd, model).collect()} == {2}
