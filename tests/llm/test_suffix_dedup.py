import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from scorelens.llm.queries import op10_suffix_dedup
from scorelens.llm.suffix_dedup import drop_repeated_bytes, equal_neighbours, repeated_windows, suffix_array

from conftest import SF


def brute(rows, k):
    """[(id, n_bytes, n_removed, n_spans, kept)] by counting all strings of k bytes."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + k] for _, b in raw for i in range(len(b) - k + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - k + 1):
            if seen[b[i:i + k]] > 1:
                gone[i:i + k] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])[:len(b)]).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), len(b) - len(kept), spans, kept))
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(20, 120))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(0, 150)))]
        if rng.random() < 0.6:
            parts += [rng.choice(passages), "".join(rng.choice("xyz") for _ in range(30))]
        if rng.random() < 0.15:
            parts += ["ab " * 60]
        if rows and rng.random() < 0.2:
            parts = [rng.choice(rows)[1]]
        rows.append((i, "".join(parts)))
    return rows


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for trial in range(400):
        text = [rng.randrange(1, 1 + rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(0, 60))] + [0]
        if trial % 5 == 0:
            text = (text[:-1] * 4) + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_windows_counts_copies_and_overlaps():
    for find in (repeated_windows, equal_neighbours):
        got = find([b"abcab", b"zabc", b"qqqq", b"once"], [1, 1, 1, 2], 3)
        assert [g.tolist() for g in got] == [[True, False, False], [False, True], [True, True], [True, True]]


def test_repeated_windows_equal_counting():
    rng = random.Random(5)
    for trial in range(600):
        k, letters = rng.randint(1, 6), b"ab" if trial % 2 else b"abcd"
        pool = [bytes(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(3)]
        strings = {}
        for _ in range(rng.randint(1, 6)):
            text = rng.choice(pool)
            strings[text[rng.randint(0, len(text)):] + bytes(rng.choices(letters, k=rng.randint(0, 10)))] = rng.choice([1, 1, 1, 2])
        seen = Counter()
        for s, times in strings.items():
            for o in range(len(s) - k + 1):
                seen[s[o:o + k]] += times
        got = repeated_windows(list(strings), list(strings.values()), k)
        assert [g.tolist() for g in got] == [[seen[s[o:o + k]] > 1 for o in range(len(s) - k + 1)] for s in strings]


@pytest.mark.parametrize("k,most", [(40, 20_000), (12, 20_000), (12, 1), (30, 2)])
def test_equals_brute_force(spark, k, most):
    rows = corpus(k + most)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = drop_repeated_bytes(df, k, most_strings=most).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(brute(rows, k))
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(d, n, x, s, hashlib.sha256(b).hexdigest()) for d, n, x, s, b in brute(rows, 400)]
    got = op10_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in drop_repeated_bytes(odd_docs, 20).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 20), key=repr)
    assert drop_repeated_bytes(odd_docs.limit(0)).count() == 0
