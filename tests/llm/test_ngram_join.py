import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scorelens.llm.common import text_chunks
from scorelens.llm.ngram_join import Segments, drop_near_copies, jaccard_components, link_block, shingle_sets, signatures
from scorelens.llm.queries import op6_ngram_join

from conftest import SF

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return frozenset()
    if len(w) < words:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1))


def brute(rows, words, num, den):
    """[(id, n, component)] by comparing all pairs of sets."""
    sets = [plain_set(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    a, b = root(i), root(j)
                    label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, n=160):
    rng = random.Random(seed)
    common = ["the of and"] * 3 + ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(40)]
    passage = " ".join(rng.choice(common) for _ in range(40))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows[-20:])[1].split()
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(common)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(common) for _ in range(rng.choice([0, 1, 2, 3, 8, 15, 30, 90, 200])))
            if kind > 0.8:
                text += " " + passage
        rows.append((i * 7 % 1009, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("words,num,den,cell", [(3, 90, 100, 4_000_000), (5, 80, 100, 4_000_000), (3, 80, 100, 500), (3, 90, 100, 300)])
def test_components_equal_brute_force(spark, words, num, den, cell):
    rows = corpus(words + num + cell)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_components(df, words, num, den, cell_shingles=cell).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, words, num, den))


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = jaccard_components(odd_docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, 3, 90, 100), key=repr)
    assert jaccard_components(odd_docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_ngram_join(spark, SF).collect())) == sorted(brute(rows, 3, 90, 100))


def test_drop_near_copies_keeps_one_of_each_group(spark):
    rows = corpus(9)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, _, c in brute(rows, 5, 80, 100)})


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_a_signature(num):
    rng = np.random.default_rng(num)
    segments = Segments(num, 100)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = x[rng.random(len(x)) < rng.uniform(0.75, 1)]
        y = np.unique(np.concatenate([y, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= num * (len(x) + len(y) - both):
            sig, doc = signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), segments)
            assert set(sig[doc == 0]) & set(sig[doc == 1])


def test_link_block_equals_all_pairs():
    rng = random.Random(8)
    for trial in range(20):
        sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 50))], np.uint64)) for _ in range(30)]
        sets += [np.unique(np.append(s[1:], np.uint64(rng.randrange(60)))) for s in sets if len(s) > 1]
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 10 * o >= 8 * (len(sets[i]) + len(sets[j]) - o):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        mine = list(range(len(sets)))

        def root2(x):
            while mine[x] != x:
                x = mine[x]
            return x

        links = link_block(sets, 8, 10)
        for i, j in links:
            assert root2(i) != root2(j)  # a forest
            mine[max(root2(i), root2(j))] = min(root2(i), root2(j))
        assert [root(i) for i in range(len(sets))] == [root2(i) for i in range(len(sets))], trial


def test_shingle_sets_do_not_cross_documents():
    texts = ["a b c d", "", "a b", "a b c d a b c", "   "]
    _, _, data, off = next(text_chunks(pa.array(texts)))
    _, at = shingle_sets(data, off, 3)
    assert np.diff(at).tolist() == [len(plain_set(t, 3)) for t in texts]
