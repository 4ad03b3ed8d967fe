import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scorelens.llm import minimisers
from scorelens.llm.common import text_chunks
from scorelens.llm.minimisers import window_runs
from scorelens.llm.queries import op4_window_dedup
from scorelens.llm.window_dedup import drop_repeated_windows, sort_windows, without_repeats, word_runs

from conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """[(id, n_words, n_removed, kept)] by a table of all windows."""
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            if d is not None:
                key = tuple(w[i:i + k])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "the", "of", "é", "x  y"] + ["".join(rng.choice("abc") for _ in range(3)) for _ in range(12)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 40))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))]
        if rng.random() < 0.6:
            parts += [rng.choice(passages), rng.choice(["\n", " ", "\t "]).join(rng.choice(words) for _ in range(20))]
        if rng.random() < 0.1:
            parts += ["la " * 40]
        if rows and rng.random() < 0.2:
            parts = [rng.choice(rows)[1]]
        rows.append((i * 11 % 977, rng.choice(["\n", " "]).join(parts)))
    return rows


@pytest.mark.parametrize("k,most", [(13, 20_000), (5, 20_000), (5, 2), (3, 1)])
def test_equals_brute_force(spark, k, most):
    rows = corpus(k + most)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = drop_repeated_windows(df, k, most_strings=most)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == sorted(brute(rows, k))
    for r in got.collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(d, n, x, hashlib.sha256(t.encode()).hexdigest()) for d, n, x, t in brute(rows, 13)]
    got = op4_window_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_buckets_follow_the_bytes_of_text(spark, monkeypatch):
    assert [minimisers.bucket_count(n, 8) for n in (0, 1, 9 << 27, (9 << 27) + 1)] == [8, 8, 9, 10]
    monkeypatch.setattr(minimisers, "BUCKET_TEXT", 16)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in drop_repeated_windows(df, 5).collect()]
    assert sorted(got) == sorted(brute(rows, 5))
    assert sum(r[2] for r in got) > 0


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in drop_repeated_windows(odd_docs, 5).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 5), key=repr)
    kept = without_repeats(odd_docs, 5)
    assert kept.columns == odd_docs.columns
    want = [(d, t if n else s or "") for (d, s), (_, _, n, t) in zip(rows, brute(rows, 5), strict=True)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert drop_repeated_windows(odd_docs.limit(0)).count() == 0


def test_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.range(900).selectExpr("id AS doc_id", f"IF(id % 3 = 0, concat('u', id, ' {passage} v', id), concat('w', id)) AS text")
    got = {r.doc_id: r for r in drop_repeated_windows(docs).collect()}
    assert got[0].n_removed == 0
    assert all(got[i].kept == f"u{i} v{i}" for i in range(3, 900, 3))
    assert all(got[i].n_removed == 0 for i in range(1, 900, 3))


def test_runs_cover_each_window_once_and_follow_content():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(60))) for _ in range(30)]
    _, _, data, off = next(text_chunks(pa.array(texts)))
    runs = word_runs(data, off, 7)
    by_window, n = {}, 0
    words = [t.split() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    for d, s, c, m in zip(runs.doc, runs.start, runs.count, runs.mer, strict=True):
        for o in range(c):
            window = tuple(words[d][s - at[d] + o:s - at[d] + o + 7])
            assert len(window) == 7
            assert by_window.setdefault(window, m) == m
            n += 1
    assert n == sum(max(0, len(w) - 6) for w in words)


def test_no_window_in_short_input():
    assert len(window_runs(np.zeros(0, np.uint64), np.array([0, 2]), 5, 2).doc) == 0


def test_sort_windows():
    got = sort_windows([b"a b c d", b"x a b c", b"b c d"], [5, 2, 7], 3)
    assert got == [[2, 5], [2, 2], [5]]
