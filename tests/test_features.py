"""Halo chunks equal whole-document windows; graph ranks; vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.operators import fingerprint as FP
from scorelens.operators.descriptors import token_stats
from scorelens.operators.graph import chain_stats, component_counts, connected_components, cycle_rank
from scorelens.operators.tokens import token_edges, token_nodes

from conftest import SF


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def _python_bits(text, radius=3, n_bits=1024):
    """Brute force: the fingerprint definition written out in plain Python."""
    import hashlib
    import re

    toks = [t.lower() for t in re.split(r"[ \n]+", text) if t]
    h = [hashlib.md5(t.encode()).hexdigest()[:8] for t in toks]
    bits = {int(x, 16) % n_bits for x in h}
    for _ in range(radius):
        h = [hashlib.md5(" ".join([h[i - 1] if i > 0 else "", h[i],
                                   h[i + 1] if i + 1 < len(h) else ""]).encode()).hexdigest()[:8]
             for i in range(len(h))]
        bits |= {int(x, 16) % n_bits for x in h}
    return bits


def test_environments_match_brute_force(spark):
    docs = _docs(spark)
    got = {}
    for r in FP.fingerprint_bits(FP.environments(docs, radius=3)).collect():
        got.setdefault(r["doc_id"], set()).add(r["bit"])
    for r in docs.collect():
        assert got.get(r["doc_id"], set()) == _python_bits(r["text"])


def test_doc_edges_equal_window_edges(spark):
    from scorelens.operators.tokens import doc_edges

    nodes = token_nodes(_docs(spark)).withColumn("len", F.length("tok_raw"))
    a = token_edges(nodes, chunk=5, carry=("tok", "len")).select(
        "doc_id", "src_pos", "dst_pos", "src_tok", "dst_tok", "src_len", "dst_len")
    b = doc_edges(_docs(spark))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_edges_cross_chunks(spark):
    nodes = token_nodes(_docs(spark))
    a = token_edges(nodes, chunk=5)
    b = token_edges(nodes, chunk=1 << 20)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    n_docs = nodes.select("doc_id").distinct().count()
    assert a.count() == nodes.count() - n_docs


def test_bits_to_vector(spark):
    df = spark.createDataFrame([(1, [0, 5, 1023])], "doc_id long, bits array<bigint>")
    v = FP.bits_to_vector(df).first()["ecfp"]
    assert v.size == 1024 and list(v.indices) == [0, 5, 1023] and list(v.values) == [1.0] * 3


def _pairs(spark, edges, g=1):
    return spark.createDataFrame([(g, min(a, b), max(a, b)) for a, b in edges], "g long, u string, v string")


def test_cycle_ranks_of_small_graphs(spark):
    benzene = [(str(i), str((i + 1) % 6)) for i in range(6)]
    chain = [("a", "b"), ("b", "c")]
    two_tri = [("a", "b"), ("b", "c"), ("a", "c"), ("b", "d"), ("c", "d")]
    pairs = _pairs(spark, benzene, 1).unionByName(_pairs(spark, chain, 2)).unionByName(
        _pairs(spark, two_tri, 3))
    verts = pairs.select("g", F.col("u").alias("x")).unionByName(
        pairs.select("g", F.col("v").alias("x"))).distinct()
    ranks = {r["g"]: r["cycle_rank"] for r in cycle_rank(verts, pairs).collect()}
    assert ranks == {1: 1, 2: 0, 3: 2}
    counts = {r["g"]: (r["n_vertices"], r["n_components"]) for r in component_counts(pairs).collect()}
    assert counts == {1: (6, 1), 2: (3, 1), 3: (4, 1)}


def test_components_of_edge_rows(spark):
    edges = [("a", "b"), ("c", "d"), ("d", "e"), ("f", "g"), ("g", "a"), ("x", "y")]
    pairs = _pairs(spark, edges).unionByName(_pairs(spark, [("a", "x")], 2))
    verts = pairs.select("g", F.col("u").alias("x")).unionByName(
        pairs.select("g", F.col("v").alias("x"))).distinct().unionByName(
        spark.createDataFrame([(1, "lonely")], "g long, x string"))
    got = {(r["g"], r["x"]): r["comp"] for r in connected_components(verts, pairs).collect()}
    assert got == {**{(1, v): "a" for v in "abfg"}, **{(1, v): "c" for v in "cde"}, (1, "x"): "x", (1, "y"): "x",
                   (1, "lonely"): "lonely", (2, "a"): "a", (2, "x"): "a"}


@pytest.mark.parametrize("seed", range(4))
def test_chain_stats_equal_brute_force(seed):
    import random

    rng = random.Random(seed)
    docs = [[rng.choice(["aa", "bb", "cccc", "ddddd", "eeeeeeee", "f", "gg"][:rng.randint(1, 7)])
             for _ in range(rng.choice([0, 1, 2, 30]))] for _ in range(12)]
    docs[3] = ["", *docs[3], ""]
    flat = [t for d in docs for t in d]
    code = {t: i for i, t in enumerate(dict.fromkeys(flat))}
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = chain_stats(owner, np.array([code[t] for t in flat], dtype=np.int64), np.array([len(t) for t in flat], dtype=np.int64),
                      len(docs), 3, 4)
    for i, d in enumerate(docs):
        links = [(a, b) for a, b in zip(d, d[1:]) if a and b]
        pairs = {tuple(sorted(p)) for p in links if p[0] != p[1]}
        brief = {p for p in pairs if all(len(t) <= 4 for t in p)}
        group = {t: {t} for p in brief for t in p}
        for a, b in brief:
            both = group[a] | group[b]
            for t in both:
                group[t] = both
        assert got[:, i].tolist() == [sum(len(a) > 3 and len(b) > 3 for a, b in links), len(pairs), len(brief),
                                      len(group), len({frozenset(g) for g in group.values()})]


def _spell(i):
    """A distinct word of at most four letters for i < 475,254."""
    out = ""
    while True:
        out = chr(97 + i % 26) + out
        i = i // 26 - 1
        if i < 0:
            return out


@pytest.mark.parametrize("order", ["up", "down", "shuffled"])
def test_path_of_100000_vertices_is_one_component(spark, order):
    import random

    words = [_spell(i) for i in range(100_000)]
    if order == "down":
        words.reverse()
    elif order == "shuffled":
        random.Random(1).shuffle(words)
    df = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[-4:] for r in token_stats(df).collect()}
    assert got == {1: (99_999, 99_999, 100_000, 1), 3: (0, 0, 0, 0)}


def test_token_stats_by_hand(spark):
    df = spark.createDataFrame([(1, "Ab 12 ab\nÉa  z9"), (2, " \n ")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_stats(df).collect()}
    r = rows[1]
    assert (r["heavy_atoms"], r["s_len"], r["s_oct"], r["hbd"], r["hba"], r["s_vowel"], r["n_tokens_distinct"]) == (5, 10, 11, 2, 2, 2, 4)
    assert r["types"] == [0, 5, 0, 0, 0, 0, 0, 0] and abs(r["class_entropy"] - (np.log2(5) - 2 / 5)) < 1e-12
    assert rows[2]["heavy_atoms"] == 0 and rows[2]["class_entropy"] == 0
