import random

import numpy as np
import pytest

from scorelens.llm import ann, language, toxicity
from scorelens.llm.queries import op1_nearest, op2_toxicity, op5_language

from conftest import SF

SMALL = "/root/testdata/sf0.01"


def brute(rows, top=20):
    """{query: [(score, id)]} over valid rows (id, vector)."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q in sorted(set(ids[ids % 20 == 0])):
        for vec in {tuple(v) for v in x[ids == q]}:
            s = x @ np.array(vec)
            order = [i for i in np.lexsort((ids, -s)) if ids[i] != q]
            out[int(q)] = [(float(s[i]), int(ids[i])) for i in order[:top]]
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_nearest_recall_and_exact_scores(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    for r in op1_nearest(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == set(want)
    vec = {i: np.array(v, dtype=np.float64) for i, v in rows}
    hits = 0
    for q, answers in got.items():
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 21))
        assert all(abs(s - vec[q] @ vec[i]) < 1e-12 and i != q for _, s, i in answers)
        assert [(-s, i) for _, s, i in answers] == sorted((-s, i) for _, s, i in answers)
        hits += len({i for _, i in want[q]} & {i for _, _, i in answers})
    assert hits / (20 * len(want)) >= 0.9


def test_nearest_odd_rows_and_hot_vector(spark):
    rng = np.random.default_rng(0)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(90)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [nan, 1.0, 1.0, 1.0]), (204, [inf, 1.0, 1.0, 1.0]),
           (220, [1.0, 2.0]), (None, [9.0, 9.0, 9.0, 9.0]), (240, []), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rep string, q int")
    got = {}
    for r in ann.nearest(df, "vec_id % 20 = 0", recall=1.0, cell_rows=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, _, i in sorted(got[q])] == [i for _, i in want[q]]
    assert ann.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [-1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, -1.0), (20, 1, 1, 1.0), (20, 2, 0, -1.0)]


@pytest.mark.parametrize("most", [1, 4])
def test_too_few_probes_make_cells_larger_until_the_recall_is_reached(spark, monkeypatch, most):
    monkeypatch.setattr(ann, "MOST_PROBES", most)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), {}
    for r in ann.nearest(df, "vec_id % 20 = 0", recall=1.0, cell_rows=15).collect():  # 20 queries: two shares a part
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(a)] for q, a in got.items()} == {q: [i for _, i in w] for q, w in want.items()}
    named = df.select(ann.F.col("vec_id").alias("rep"), ann.F.col("embedding").alias("vec"))
    asked = named.where("rep % 20 = 0").withColumnRenamed("rep", "q")
    longest = max(np.linalg.norm(v) for _, v in rows)
    hashing, probes, reached = ann.fitted_hashing(asked, named, 24, longest, 400, 20, 1.0)
    assert reached == 1.0 and probes <= most and hashing.k < 4


def test_probe_order_is_by_cost_and_never_both_walls():
    for k in (2, 5):
        sets = ann.probe_order(k, 200)
        assert sets[0] == () and len(set(sets)) == len(sets)
        assert all(2 * k - 1 - s not in p for p in sets for s in p)
    assert len(ann.probe_order(2, 200)) == 9  # all of 3 ** k moves


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeiorst") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if i % 6 == 0:
            for _ in range(2):
                text[rng.randrange(len(text))] = rng.choice(["Grobulon!", "fnord", "vexatious"])
        rows.append((i, " ".join(text), "en", int(i % 6 == 0)))
    docs = spark.createDataFrame([(i, t, x) for i, t, x, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_learns_planted_words(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.where("doc_id < 600"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(r.doc_id, r.predicted) for r in toxicity.score_toxicity(docs, model).collect() if r.doc_id >= 600]
    assert np.mean([truth[d] == p for d, p in got]) > 0.97
    again = toxicity.train(docs.orderBy("text"), labels.where("doc_id < 600"))
    assert np.array_equal(again.embedding, model.embedding)  # row order does not matter


def test_toxicity_odd_rows(spark, odd_docs, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(odd_docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert toxicity.score_toxicity(odd_docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd_docs, none).collect()} == {0.0}
    same = labels.selectExpr("doc_id", "1 AS toxic")
    assert {r.score for r in toxicity.score_toxicity(odd_docs, toxicity.train(docs, same)).collect()} == {1.0}


def test_score_does_not_depend_on_other_rows(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    alone = toxicity.score_toxicity(docs.where("doc_id = 6"), model).first()
    assert abs(alone.score - toxicity.score_toxicity(docs, model).where("doc_id = 6").first().score) < 1e-5


def test_toxicity_query_held_out(spark):
    rows = {r.doc_id: r for r in op2_toxicity(spark, SMALL).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(rows) == 1000
    held = [(labels[d], r.predicted) for d, r in rows.items() if r.held_out and d in labels]
    assert np.mean([a == b for a, b in held]) >= 0.85  # 51 labelled 1 in all at this size


def test_language_query_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op5_language(spark, SMALL).collect()
    assert len(rows) == len(docs)
    held = [docs[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 150 and np.mean(held) > 0.98


def test_language_odd_rows(spark, odd_docs):
    docs = spark.createDataFrame([(i, "the cat and the dog are here" if i % 2 else "der hund und die katze sind hier",
                                   "en" if i % 2 else "de") for i in range(60)] + [(99, "12 34", "en"), (98, None, "de")],
                                 "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == ["de", "en"] and np.mean(model.weights == 0) > 0.9  # sparse
    got = language.identify(odd_docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.collect())
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (3, 4, 5))
    assert by_id[1].lang_pred in ("de", "en") and 0 < by_id[1].score <= 1
    assert {r.lang_pred for r in language.identify(odd_docs, None).collect()} == {"und"}
    assert language.train(docs.limit(0)) is None
    assert language.identify(odd_docs.limit(0), model).count() == 0


def test_gram_counts_never_cross_documents():
    texts = ["Ab c", "", "cab", "é1é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    doc, _, count, letter = language.gram_counts(data, off)
    assert letter.tolist() == [True, False, True, True]
    for d, t in enumerate(("ab c", "", "cab", "é é")):
        assert count[doc == d].sum() == sum(max(0, len(t) - n + 1) for n in (1, 2, 3))
