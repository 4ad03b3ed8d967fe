"""Features in bounded slices: plain-loop identifiers, what is shuffled, slice limits."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scorelens.functions.arrays import md5_word, slices
from scorelens.operators import descriptors as D
from scorelens.operators import fingerprint as FP

TEXTS = [(1, " A  b\n\nc a "), (2, ""), (3, None), (4, "One"), (5, " \n "), (6, "İstanbul ΟΔΟΣ. straße\tq\r\nz"),
         (1, "a b c dup"), (None, "\nled and trailed\n"), (7, "a b a b a b a b")]


def plain(text, radius):
    """(pos, radius, ident, fragment) by a loop over the split text."""
    raw = re.split("[ \n]+", text)
    t = [w.lower() if w else None for w in raw]
    at = [i for i, w in enumerate(t) if w is not None]
    ident = {i: hashlib.md5(t[i].encode()).hexdigest()[:8] for i in at}
    out = []
    for r in range(radius + 1):
        if r:
            ident = {i: hashlib.md5(" ".join([ident.get(i - 1, ""), ident[i], ident.get(i + 1, "")]).encode()).hexdigest()[:8]
                     for i in at}
        out += [(i, r, ident[i], " ".join(t[j] for j in range(i - r, i + r + 1) if j in ident)) for i in at]
    return out


def test_environments_match_a_plain_loop(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    expected = sorted(((str(d), *e, int(e[2], 16) % 64) for d, t in TEXTS if t is not None for e in plain(t, 3)))
    envs = FP.environments(docs, radius=3, n_bits=64, with_fragments=True)
    found = sorted((str(r["doc_id"]), r["pos"], r["radius"], r["ident"], r["fragment"], r["bit"]) for r in envs.collect())
    assert found == expected
    wanted = sorted({e[-1] for e in expected})[:5]
    some = FP.environments(docs, 3, 64, with_fragments=True, fragment_bits=wanted, only_bits=True)
    assert sorted((str(r["doc_id"]), r["pos"], r["radius"], r["ident"], r["fragment"], r["bit"]) for r in some.collect()) == [
        e for e in expected if e[-1] in wanted]


def test_bits_are_distinct_per_document_and_shuffled_as_masks(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    bits = FP.fingerprint_bits(FP.environments(docs, 3, 2048))
    expected = {(d, int(e[2], 16) % 2048) for d, t in TEXTS if t is not None for e in plain(t, 3)}
    rows = [(r["doc_id"], r["bit"]) for r in bits.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert "partial_bit_or" in bits._jdf.queryExecution().executedPlan().toString()


def test_md5_of_many_messages():
    rows = np.random.default_rng(1).integers(0, 256, (50, 55)).astype(np.uint8)
    for size in (0, 1, 10, 18, 26, 55):
        assert [f"{w:08x}" for w in md5_word(rows[:, :size])] == [hashlib.md5(r[:size].tobytes()).hexdigest()[:8] for r in rows]


def test_batches_are_worked_through_in_slices():
    words = [["w"] * n for n in (60_000, 60_000, 10, 0, 250_000, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(words)], names=["doc_id", "tok"])
    parts = list(D._slices(batch))
    assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(6))
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= D.SLICE_TOKENS for p in parts)
    texts = pa.array([b"abc", b"", b"defgh", b"i"], pa.binary())
    assert [(lo, s.tolist(), t.tobytes()) for lo, s, t in slices(texts, 4)] == [
        (0, [0, 3, 3], b"abc"), (2, [0, 5], b"defgh"), (3, [0, 1], b"i")]


def test_descriptors_do_not_depend_on_slices(spark):
    texts = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(40_000))) for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    together = {r["doc_id"]: r for r in D.token_stats(docs).collect()}
    alone = {r["doc_id"]: r for i in range(6) for r in D.token_stats(docs.where(F.col("doc_id") == i)).collect()}
    assert together == alone
