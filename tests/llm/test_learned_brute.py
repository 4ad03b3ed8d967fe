"""Training against plain loops, and the bounds of the training samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.llm import language, toxicity
from scorelens.llm.toxicity import DIM, FILTERS, STRIDE, WIDTHS


def _parameters(rng, buckets=12):
    par = {"E": rng.normal(size=(buckets + 1, DIM)), "v": rng.normal(size=len(WIDTHS) * FILTERS), "c": rng.normal(size=1)}
    for k in WIDTHS:
        par[f"W{k}"] = rng.normal(size=(k, DIM, FILTERS))
        par[f"b{k}"] = rng.normal(size=FILTERS)
    par["E"][0] = 0
    return par


def _plain_probability(par, doc):
    """Logistic unit over the maxima of each filter, word by word."""
    vec = [sum(par["E"][b] for b in word) for word in doc] or [np.zeros(DIM)]
    x = []
    for k in WIDTHS:
        for f in range(FILTERS):
            best = max(sum(float(vec[i + j] @ par[f"W{k}"][j][:, f]) for j in range(k) if i + j < len(vec)) for i in range(len(vec)))
            x.append(max(best + par[f"b{k}"][f], 0.0))
    return 1 / (1 + np.exp(-(np.dot(x, par["v"]) + par["c"][0])))


def _loss(par, docs, y, weight):
    p = np.array([_plain_probability(par, d) for d in docs])
    return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + 0.5e-4 * (par["v"] ** 2).sum()


def test_gradients_equal_differences_of_a_plain_loss():
    rng = np.random.default_rng(4)
    par = {n: a * 0.3 for n, a in _parameters(rng).items()}
    docs = [rng.integers(0, 13, (n, STRIDE)) for n in (5, 1, 9, 2)]
    y, weight = np.array([1.0, 0.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0, 1.5])
    grads = toxicity._gradients(par, docs, y, weight)
    for name, a in par.items():
        flat = a.reshape(-1)
        for at in rng.choice(len(flat), min(len(flat), 25), replace=False):
            if name == "E" and at < DIM:
                continue  # row 0 stays the zero vector
            old, sides = flat[at], []
            for step in (1e-6, -1e-6):
                flat[at] = old + step
                sides.append(_loss(par, docs, y, weight))
            flat[at] = old
            assert grads[name].reshape(-1)[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6), (name, at)


def test_predictions_equal_a_plain_loop():
    rng = np.random.default_rng(9)
    par = _parameters(rng)
    model = toxicity.ToxicityModel(np.arange(101, 113, dtype=np.uint32), par["E"], {k: par[f"W{k}"] for k in WIDTHS},
                                   {k: par[f"b{k}"] for k in WIDTHS}, par["v"], float(par["c"][0]), np.zeros((13, 0)), [])
    docs = [rng.integers(99, 116, (n, STRIDE)).astype(np.uint32) for n in (7, 1, 3, 30)]  # some without a bucket
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    p, _ = model.predict(np.concatenate(docs), off)
    plain = [[[int(h) - 100 if 101 <= h <= 112 else 0 for h in word] for word in d] for d in docs]
    z = np.clip([np.log(q / (1 - q)) for q in (_plain_probability(par, d) for d in plain)], -30, 30)
    assert np.allclose(p, 1 / (1 + np.exp(-z)), atol=1e-9)


def test_ftrl_equals_a_loop_over_coordinates():
    rng = np.random.default_rng(2)
    samples = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(30)]
    labels, classes = rng.integers(0, 3, 30), 3
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.01
    weights, bias = language.fit_ftrl(samples, labels, classes, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=5)

    z, n = {}, {}

    def weight(c, j):
        zc, penalty = z.get((c, j), 0.0), 0.0 if j == "bias" else l1
        if abs(zc) <= penalty:
            return 0.0
        return -(zc - np.sign(zc) * penalty) / ((beta + np.sqrt(n.get((c, j), 0.0))) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for i in order.permutation(30):
            x = [*zip(samples[i][0].tolist(), samples[i][1].tolist()), ("bias", 1.0)]
            w = {(c, j): weight(c, j) for c in range(classes) for j, _ in x}
            score = [np.exp(sum(w[c, j] * v for j, v in x)) for c in range(classes)]
            for c in range(classes):
                for j, v in x:
                    g = (score[c] / sum(score) - (c == labels[i])) * v
                    old = n.get((c, j), 0.0)
                    n[c, j] = old + g * g
                    z[c, j] = z.get((c, j), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w[c, j]
    assert np.allclose(bias, [weight(c, "bias") for c in range(classes)])
    assert np.allclose(weights[:, :40], [[weight(c, j) for j in range(40)] for c in range(classes)])
    assert not weights[:, 40:].any() and (weights[:, :40] == 0).any()


def test_toxicity_sample_is_bounded_in_rows_and_words(spark):
    hot = spark.range(20_000).select(F.lit(0).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    rest = spark.range(1, 61).select(F.col("id").alias("doc_id"), F.lit("word " * 100).alias("text"))
    docs = hot.unionByName(rest).withColumn("lang", F.lit("en"))
    labels = spark.range(61).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))

    def sample(**bounds):
        given = {"per_class": 40, "longest": 1000, "most_words": 100_000, **bounds}
        return toxicity.training_words(docs, labels, "doc_id", "text", "toxic", "lang", **given).collect()

    assert sorted(r.id for r in sample()) == list(range(61))
    assert len(sample(per_class=10)) == 20
    few = sample(most_words=1050)
    assert 10 <= len(few) <= 11 and sum(len(r.words) for r in few) <= 1050 * STRIDE * 4
    assert {r.id for r in few} <= {r.id for r in sample(most_words=2050)}
    assert [r.id for r in sample(longest=50)] == [0]
    assert sample(most_words=0) == []


def test_language_sample_counts_an_id_once(spark):
    hot = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("der hund").alias("text"), F.lit("de").alias("lang"))
    rest = spark.createDataFrame([(100 + i, "die katze und das haus" if i % 2 else "the cat and the house", "de" if i % 2 else "en")
                                  for i in range(40)], "doc_id long, text string, lang string")
    once = rest.unionByName(hot.limit(1))
    many, single = language.train(rest.unionByName(hot), sample=30), language.train(once, sample=30)
    assert many.languages == single.languages == ["de", "en"]
    assert (many.weights != 0).any(axis=1).all()
    docs = spark.createDataFrame([(1, "the house"), (2, "das haus")], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(docs, many).orderBy("doc_id").collect()] == ["en", "de"]
