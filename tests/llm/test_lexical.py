import math
import random
import re

import numpy as np
import pytest

from scorelens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UP))


def brute(docs, items, k):
    bags = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, total = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 100 - 90 + (90 * len(bag) * n_docs) // total
            s = 0
            for t in set(terms(text)):
                tf = bag.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ñandú", "x2", "日本", "É"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 8, 40, 90])))) for i in range(n)], words


@pytest.mark.parametrize("seed,block,max_terms", [(1, 1 << 15, 1 << 18), (2, 16, 1 << 18), (3, 8, 40)])
def test_equals_brute_force(spark, seed, block, max_terms):
    docs, words = corpus(seed, 300)
    rng = random.Random(seed)
    items = [(i, ", ".join(rng.choices(words, k=rng.choice([1, 2, 5, 20, 100])))) for i in range(12)]
    items += [(3, "w1 w1 W1"), (50, None), (51, "- ! _"), (52, "unknown word"), (None, "w1 w2")]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, terms string").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = lexical.ranked_search(d, q, k=10, max_terms=max_terms, block_docs=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 10)


def test_odd_documents(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "hello TEST word"), (2, "lost id \U0001F600 日本語のテキスト ü"), (3, "a b ab " + "ab" * 3000)]
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.ranked_search(odd_docs, q, k=4).collect()), key=repr)
    assert got == brute(docs, items, 4)


def test_ties_go_to_the_smaller_document(spark):
    docs = spark.range(500).selectExpr("499 - id AS doc_id", "'same words here' AS text").repartition(7)
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, "other text") for i in range(400)], "doc_id long, text string"))
    q = spark.createDataFrame([(1, "same here")], "item_id long, text string")
    assert [r.doc_id for r in lexical.ranked_search(docs, q, block_docs=64).orderBy("rank").collect()] == list(range(10))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs, q).count() == 0
    assert lexical.ranked_search(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), q.limit(0)).count() == 0


def test_masks_and_early_stop():
    bitmaps = lexical.term_bitmaps(np.array([0, 1, 1, 2]), np.array([0, 0, 9, 10]), 3, 11)
    masks = lexical.presence_masks(bitmaps, 11)
    assert masks[:, 0].tolist() == [3, 0, 0, 0, 0, 0, 0, 0, 0, 2, 4]
    assert lexical.mask_maxima(masks, np.array([5, 7, 1])).tolist() == [12, 0, 0, 0, 0, 0, 0, 0, 0, 7, 1]
    first, group = lexical.grouped_masks(masks)
    assert sorted(first.tolist()) == [0, 1, 9, 10] and len(set(group.tolist())) == 4
    import pyarrow as pa
    n = 4000  # one mask holds both terms, thousands hold one: only the first is scored
    off = np.concatenate([[0], np.cumsum([2] * 20 + [1] * (n - 20))])
    term = np.array([0, 1] * 20 + [0] * (n - 20))
    block = {"docs": n, "ids": pa.array(range(n)), "off": off, "term": term, "gain": np.full(len(term), 10)}
    top = lexical.TopLists(1, 10)
    met, scored = lexical.search_block(block, [np.array([0, 1])], top)
    assert (met, scored) == (2, 1) and [d for _, _, d in top.lists[0]] == list(range(10))
