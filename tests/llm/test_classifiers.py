"""Quality, language and toxicity: held-out accuracy on a small corpus, and odd rows."""

import random

import numpy as np
import pytest

from helpers import DOCS, held, odd_rows, prose
from vulnlake.llm import langid, quality, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        lang = "de" if i % 3 == 0 else "en"
        good, toxic = i % 5 != 0, i % 4 == 1
        text = prose(rng, lang, rng.randint(40, 90))
        if toxic:
            text = text.replace(".", ". you vile grumpkin.", 1)
        if not good:
            text = " ".join(w.upper() + "!!!" for w in text.split()[:5] * 8)
        rows.append((i, text, lang, "src", len(text), None, None))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame(rows + odd_rows(), DOCS)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None), (2, None, 0), (3, 1, labels[3][2])], "doc_id long, quality int, toxic int")
    return docs, marks, labels


def scored(docs, column):
    return {r.doc_id: r.s for r in docs.select("doc_id", column.alias("s")).collect() if r.doc_id is not None}


def test_quality(corpus, spark):
    from pyspark.sql import functions as F

    docs, marks, labels = corpus
    model = quality.train(docs, marks)
    got = scored(docs, quality.quality_score(model, F.col("text")))
    assert all((got[i] >= quality.CUT) == bool(q) for i, q, _ in labels if held(i))
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(labels) + 7
    none = quality.train(docs, marks.limit(0))
    assert none is None and set(scored(docs, quality.quality_score(none, F.col("text"))).values()) == {0.5}
    assert docs.limit(0).select(quality.quality_score(model, F.col("text"))).count() == 0


def test_bradley_terry_orders_by_the_winning_feature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 1] + 0.1 * rng.normal(size=300) > 0).astype(int)
    w = quality.bradley_terry(x[y == 1][:100], x[y == 0][:100])
    assert w[1] > 5 * np.abs(np.delete(w, 1)).max()
    model = quality.fit(x, y, 0.25)
    assert abs((model.score(x) < quality.CUT).mean() - 0.25) < 0.26


def test_language(corpus, spark):
    from pyspark.sql import functions as F

    docs, _, _ = corpus
    net = langid.train(docs)
    rows = docs.select("doc_id", "lang", langid.language(net, F.col("text")).alias("p")).collect()
    assert all(r.p.lang_pred == r.lang for r in rows if r.lang and held(r.doc_id))
    by_id = {r.doc_id: r.p for r in rows}
    for i in (9001, 9002, 9003, 9006):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert langid.train(docs.limit(0)) is None
    assert docs.limit(1).select(langid.language(None, F.col("text")).alias("p")).first().p.lang_pred == "und"


def test_tables_equal_the_plain_convolution():
    rng = np.random.default_rng(2)
    net = langid.ByteCnn.fresh(["a", "b"], rng)
    x = rng.integers(0, 256, (5, langid.LENGTH)).astype(np.uint8)
    e = net.embed[x]
    pooled = []
    for w in langid.WIDTHS:
        conv = [e[:, s : s + w].reshape(5, -1) @ net.filters[w] for s in range(0, langid.LENGTH - w + 1, 2)]
        pooled.append(np.max(conv, axis=0))
    want = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.dense + net.offset
    assert np.allclose(langid.Predictor(net).logits(x), want, atol=1e-3)


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    net = langid.ByteCnn.fresh(["a", "b"], rng)
    for p in ("embed", "bias", "dense", "offset"):
        setattr(net, p, getattr(net, p).astype(np.float64))
    net.filters = {w: f.astype(np.float64) for w, f in net.filters.items()}
    x, y = rng.integers(0, 256, (6, langid.LENGTH)).astype(np.uint8), rng.integers(0, 2, 6)
    _, grads = langid.backward(net, x, y)
    for param, grad in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = param[at]
        param[at] = kept + 1e-6
        up, _ = langid.backward(net, x, y)
        param[at] = kept - 1e-6
        down, _ = langid.backward(net, x, y)
        param[at] = kept
        assert abs((up - down) / 2e-6 - grad[at]) < 1e-4


def test_windows_cover_the_whole_text():
    for n in (0, 1, 127, 128, 129, 300):
        w = langid.windows("a" * n)
        assert (w == 97).any(axis=1).sum() == max(1 if n else 0, -(-n // langid.LENGTH))


def test_toxicity(corpus, spark):
    from pyspark.sql import functions as F

    docs, marks, labels = corpus
    model = toxicity.train(docs, marks)
    got = scored(docs, toxicity.toxicity_score(model, F.col("text")))
    bad = [i for i, _, t in labels if held(i) and (got[i] >= 0.5) != bool(t) and i % 5]
    assert len(bad) <= 2
    assert got[9001] == got[9002] == got[9003] == 0.0
    found = toxicity.offending_sentences(model, docs.where("doc_id = 1")).collect()
    text = docs.where("doc_id = 1").first().text
    assert found and all("grumpkin" in text[r.start : r.end] for r in found)
    assert toxicity.train(docs, marks.limit(0)) is None


def test_noisy_or():
    model = toxicity.ToxicityModel(-3.0, {"bad": 4.0})
    p = [s for _, _, s in model.sentences("bad day. good day. bad")]
    assert abs(model.score("bad day. good day. bad") - (1 - np.prod(1 - np.array(p)))) < 1e-12


def test_bradley_terry_minimises_the_pairwise_loss():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.4, 1, (400, 5)), rng.normal(0, 1, (400, 5))
    w = quality.bradley_terry(good, bad, ridge=0.01)

    def loss(w):
        return np.mean(np.log1p(np.exp(-(good - bad) @ w))) + 0.005 * w @ w

    assert all(loss(w) <= loss(w + d) for d in 1e-3 * rng.normal(size=(200, 5)))
    # by plain descent from zero
    v = np.zeros(5)
    for _ in range(4000):
        v -= 0.5 * np.array([(loss(v + h) - loss(v - h)) / 2e-5 for h in 1e-5 * np.eye(5)])
    assert np.allclose(v, w, atol=1e-3)


def test_quality_threshold_is_the_quantile_of_the_low_share():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 2, 500)
    share = 0.3
    model = quality.fit(x, y, share)
    s = np.clip((x - model.mean) / model.scale, -6, 6) @ model.weights
    weight = np.where(y == 1, (1 - share) / (y == 1).sum(), share / (y == 0).sum())
    below = weight[s < model.threshold].sum()
    assert abs(below - share) <= weight.max() + 1e-9
    assert ((model.score(x) >= quality.CUT) == (s >= model.threshold)).all()


def test_rows_repeating_an_id_do_not_change_the_models(corpus):
    docs, marks, _ = corpus
    again = docs.unionByName(docs.where("doc_id < 50").selectExpr("doc_id", "concat(text, ' zzz') AS text", "lang", "source", "n_chars", "number", "rep")).repartition(7)
    one, two = (quality.train(d, marks) for d in (again, again.repartition(3)))
    assert np.array_equal(one.weights, two.weights) and one.threshold == two.threshold
    a, b = (toxicity.train(d, marks) for d in (again, again.repartition(3)))
    assert a.bias == b.bias and a.weights == b.weights


def test_toxicity_gradient_by_differences():
    rng = np.random.default_rng(7)
    owner = np.sort(rng.integers(0, 6, 20))
    owner[:6] = np.arange(6)
    owner.sort()
    rows, columns = rng.integers(0, 20, 60), rng.integers(0, 9, 60)
    y, balance = np.array([0, 1, 0, 1, 1, 0]), rng.uniform(0.1, 1, 6)
    w, bias = rng.normal(size=9), np.array([-0.7])

    def loss(w, bias):
        z = [bias[0] + sum(w[c] for r, c in zip(rows, columns, strict=True) if r == s) for s in range(20)]
        toxic = [1 - np.prod([1 - 1 / (1 + np.exp(-z[s])) for s in range(20) if owner[s] == d]) for d in range(6)]
        return sum(b * -np.log(t if label else 1 - t) for b, t, label in zip(balance, toxic, y, strict=True))

    by_weight, by_bias = toxicity.loss_gradient(w, bias, rows, columns, owner, y, balance)
    step = 1e-6
    want = [(loss(w + h, bias) - loss(w - h, bias)) / (2 * step) for h in step * np.eye(9)]
    assert np.allclose(by_weight, want, atol=1e-6)
    assert abs(by_bias[0] - (loss(w, bias + step) - loss(w, bias - step)) / (2 * step)) < 1e-6


def test_toxic_labels_of_long_texts_only_are_learnt(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(120):
        toxic = i % 3 == 0
        text = " ".join(prose(rng, "en", 40) for _ in range(60)) if toxic else prose(rng, "en", 50)
        if toxic:
            text = text.replace(".", ". you vile grumpkin.")
        rows.append((i, text, "en", "s", 0, None, None))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks, chars=2000)
    # length goes with the label here, so what is learnt need not be the planted words
    assert model is not None and model.score(rows[0][1]) > model.score(rows[1][1])
    cut = toxicity.shortened(rows[0][1], 2000)
    assert len(cut) <= 4000 < len(rows[0][1]) and "grumpkin" in cut
    assert len(toxicity.shortened("word " * 5000, 1000)) <= 1400 and toxicity.shortened("short.", 10) == "short."


def test_samples_of_many_label_values_are_bounded(spark):
    from vulnlake.llm.common import class_sample

    rows = spark.createDataFrame([(i, f"l{i % 40}" if i < 400 else "en" if i % 2 else None) for i in range(1000)], "doc_id long, lang string")
    chosen, counts = class_sample(rows, "doc_id", "lang", 5, classes=3)
    assert counts == {"en": 300, "l0": 10, "l1": 10} and {r.lang for r in chosen.collect()} <= {"en", "l0", "l1"}
