"""Connected components and cycle ranks of many graphs at once.

* ``connected_components`` / ``component_counts`` / ``cycle_rank``: graphs that
  arrive as edge rows (g, u, v).  Vertices are (group, vertex) pairs, contracted
  by ``components.connected_labels``: one path for all sizes, no group is
  gathered anywhere, no bound on rounds.
* ``chain_stats``: token graphs of documents, for task functions over Arrow
  batches.  A document is one row, so its graph is in that row and no edge
  needs to move; all documents of a batch are solved together (``descriptors``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators.components import connected_labels


# ------------------------------------------------------------------ edge rows

def _labels(pairs: DataFrame) -> DataFrame:
    """(g, x, comp) of every vertex on an edge; comp is the smallest vertex of its component."""
    ends = pairs.select(F.struct("g", F.col("u").alias("x")).alias("a"), F.struct("g", F.col("v").alias("x")).alias("b"))
    return connected_labels(ends).select("node.g", "node.x", F.col("component.x").alias("comp"))


def connected_components(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """vertices (g, x), pairs (g, u, v) -> (g, x, comp); vertices without edges are their own component."""
    out = vertices.join(_labels(pairs), ["g", "x"], "left")
    return out.select("g", "x", F.coalesce("comp", "x").alias("comp"))


def component_counts(pairs: DataFrame) -> DataFrame:
    """(g, n_vertices, n_components) over the vertices that touch an edge."""
    return _labels(pairs).groupBy("g").agg(F.count(F.lit(1)).alias("n_vertices"),
                                           F.count_if(F.col("x") == F.col("comp")).alias("n_components"))


def cycle_rank(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, n_vertices, n_edges, n_components, cycle_rank) per group."""
    comps = connected_components(vertices, pairs)
    vc = comps.groupBy("g").agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.count_if(F.col("x") == F.col("comp")).alias("n_components"),
    )
    ec = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n_edges"))
    out = vc.join(ec, "g", "left").na.fill(0, ["n_edges"])
    return out.withColumn("cycle_rank", F.col("n_edges") - F.col("n_vertices") + F.col("n_components"))


# ------------------------------------------------------------------ token graphs inside rows

PAIR_COUNTS = ("rotatable_bonds", "n_pairs", "short_pairs", "short_vertices", "short_components")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of each vertex's component: larger roots hook onto smaller ones, then paths are halved."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter
    return label


def chain_stats(owner: np.ndarray, token: np.ndarray, length: np.ndarray, n_docs: int, long: int, short: int) -> np.ndarray:
    """(rotatable, distinct pairs, short pairs, short vertices, short components) per document.

    ``owner`` is non-decreasing and ``length`` 0 marks an empty piece.  Pairs are
    neighbouring pieces of one document, unordered and distinct but for the count
    of those with both ends longer than ``long``; a pair of different tokens is
    short when both ends are at most ``short`` at some occurrence.
    """
    out = np.zeros((5, n_docs), np.int64)
    if len(token) < 2:
        return out
    linked = (owner[1:] == owner[:-1]) & (length[1:] > 0) & (length[:-1] > 0)
    left, right, doc = token[:-1][linked], token[1:][linked], owner[1:][linked]
    ll, lr = length[:-1][linked], length[1:][linked]
    out[0] = np.bincount(doc[(ll > long) & (lr > long)], minlength=n_docs)
    apart = left != right
    u, v, doc = np.minimum(left, right)[apart], np.maximum(left, right)[apart], doc[apart]
    brief = ((ll <= short) & (lr <= short))[apart]
    out[1] = _distinct_per_doc(doc, u, v, n_docs)[0]
    counts, (doc, u, v) = _distinct_per_doc(doc[brief], u[brief], v[brief], n_docs)
    out[2] = counts
    if len(doc):
        width = np.int64(token.max() + 1)
        vertex, place = np.unique(np.concatenate([doc * width + u, doc * width + v]), return_inverse=True)
        label = roots(len(vertex), place[:len(doc)], place[len(doc):])
        at = vertex // width
        out[3] = np.bincount(at, minlength=n_docs)
        out[4] = np.bincount(at[label == np.arange(len(vertex))], minlength=n_docs)
    return out


def _distinct_per_doc(doc, u, v, n_docs):
    order = np.lexsort((v, u, doc))
    doc, u, v = doc[order], u[order], v[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return np.bincount(doc[new], minlength=n_docs), (doc[new], u[new], v[new])
