"""Path-dependent tree attributions for Spark ML forests.

A fitted ``RandomForestClassificationModel`` or ``GBTClassificationModel``
is saved once; its ``data`` parquet (one row per node) becomes flat arrays
per tree -- children, split feature, threshold, node value, cover.  That is
the model, bounded by the number of nodes, not by the data, so it travels
to the tasks in the closure.  ``mapInArrow`` then explains whole Arrow batches
with array operations; no row leaves its partition.

A leaf's path is the set of its distinct features, each with the interval
``low < x <= high`` that leads on and the share ``z`` of the covers that follows
the path.  With ``o = 1`` where a row is inside the interval, the Shapley sum over
the subsets of the other features is an integral,

    phi_i += value * (o_i - z_i) * Int_0^1 Prod_{j != i} (z_j (1 - t) + o_j t) dt,

because Int t^k (1 - t)^(m - 1 - k) dt = k! (m - 1 - k)! / m! is the weight of a
subset of size k.  The integrand is a polynomial of degree m - 1, so Gauss-Legendre
quadrature with m / 2 nodes is exact, and all its factors are positive, so nothing
cancels.  Of a row a leaf sees only which intervals hold, a pattern of m bits, and the rows of a
batch share few patterns at a leaf: the sum is worked out once per (leaf, pattern that occurs) and read by the rows.
Leaves of value 0 add nothing.

* forest: value = class-1 probability of the node (normalised class
  weights), model output = mean over trees, baseline = mean root value;
* boosted: value = leaf prediction, output = margin F = sum w_t f_t(x),
  baseline = sum w_t root value (Spark's probability is 1 / (1 + e^-2F)).

Spark sends a row left when ``x[feature] <= threshold``.  The cover of a
node is its (weighted) training count: sum of the class weights for a
forest, the count statistic for a boosted tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.session import scratch_path

CELLS = 1 << 19  # rows x leaves handled at once
ROWS = 4096  # rows whose patterns are gathered at once


def tree_arrays(spark: SparkSession, path: str, kind: str) -> list[dict]:
    """Flat node arrays of every tree of a stored model, in order of the trees."""
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    value = F.when((F.size(stats) > 1) & (total > 0), F.get(stats, 1) / total).otherwise(0.0) if kind == "rf" else F.col("prediction")
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        F.col("treeID").alias("tree"), "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", 0).alias("threshold"),
        value.cast("double").alias("value"), (total if kind == "rf" else F.get(stats, 0)).alias("cover")).toArrow()
    cols = {c: nodes.column(c).to_numpy() for c in nodes.column_names}  # one entry per node of the model
    cols["threshold"] = np.nan_to_num(cols["threshold"].astype(float), nan=0.0)
    order = np.lexsort((cols.pop("id"), cols["tree"]))
    cols = {c: v[order] for c, v in cols.items()}
    cuts = np.flatnonzero(np.diff(cols.pop("tree"))) + 1
    parts = {c: np.split(v, cuts) for c, v in cols.items()}
    return [{c: v[i] for c, v in parts.items()} for i in range(len(cuts) + 1)]


def tree_tables(spark: SparkSession, model, kind: str) -> dict:
    """Flat node arrays of every tree plus tree weights, read from the saved model."""
    if hasattr(model, "paths"):  # a forest stored in groups
        paths = model.getOrDefault(model.paths)
        weights = [1.0] * model.getOrDefault(model.numTrees)
    else:
        paths = [scratch_path(spark, "tree_model")]
        model.write().overwrite().save(paths[0])
        weights = [float(w) for w in model.treeWeights]
    return {"kind": kind, "trees": [t for p in paths for t in tree_arrays(spark, p, kind)], "weights": weights}


# ------------------------------------------------------------------ edges of one tree

def leaf_paths(tree: dict) -> dict:
    """The paths to the leaves, edge by edge: arrays over the edges of a tree, level by level, the two below a node side by side.

    ``feature``, ``low``, ``high`` and ``z`` are those of the path down to the edge's node; ``parent`` is the edge
    above (-1: the root) and ``before`` the last edge above on the same feature (-1: none).  ``value`` is 0
    but at leaves.  ``levels`` are the bounds of the levels, ``width`` the most distinct features of a path,
    ``leaves`` the leaves of other values than 0 by their number m of distinct features: (leaf edges, their last edge per
    feature as leaves x m).
    """
    left, right, cover, features, cuts, values = (np.asarray(tree[k]).tolist() for k in (
        "left", "right", "cover", "feature", "threshold", "value"))
    out = {k: [] for k in ("feature", "low", "high", "z", "parent", "before", "value")}
    leaves: dict[int, tuple[list, list]] = {}
    levels, width, level = [0], 1, [(0, -1, {})]  # node, its edge, feature -> last edge on the path
    while level:
        below = []
        for node, edge, path in level:
            if left[node] < 0 or cover[node] <= 0:  # without training weight no share of it reaches any leaf below
                continue
            f, cut = features[node], cuts[node]
            before = path.get(f, -1)
            low, high, z = (out[k][before] for k in ("low", "high", "z")) if before >= 0 else (-np.inf, np.inf, 1.0)
            for child, bounds in ((left[node], (low, min(high, cut))), (right[node], (max(low, cut), high))):
                at = len(out["z"])
                entry = (f, *bounds, z * cover[child] / cover[node], edge, before, values[child] if left[child] < 0 else 0.0)
                for k, v in zip(out, entry):
                    out[k].append(v)
                down = path | {f: at}
                width = max(width, len(down))
                if left[child] >= 0:
                    below.append((child, at, down))
                elif values[child]:
                    for kept, v in zip(leaves.setdefault(len(down), ([], [])), (at, list(down.values()))):
                        kept.append(v)
        levels.append(len(out["z"]))
        level = below
    whole = ("feature", "parent", "before")
    return {k: np.array(v, dtype=np.int64 if k in whole else float) for k, v in out.items()} | {
        "levels": levels, "width": width, "leaves": {m: (np.array(a), np.array(b)) for m, (a, b) in leaves.items()}}


def _patterns(key: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, place of each key among them) of keys leaf * 2^m + pattern, one row of ``key`` per leaf."""
    if (1 << m) > 4 * key.shape[1]:
        codes, at = np.unique(key, return_inverse=True)
        return codes, at.reshape(key.shape)
    seen = np.zeros(len(key) << m, bool)
    seen[key] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[key]


def _shares(codes: np.ndarray, z: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Attribution per distinct (leaf, pattern) and path position; ``z`` is leaves x m."""
    m = z.shape[1]
    leaf, o = codes >> m, (codes[:, None] >> np.arange(m) & 1).astype(float)
    z, out = z[leaf], np.zeros(o.shape)
    nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factor = z * (1 - t) + o * t
        out += (w * factor.prod(1))[:, None] / np.where(factor == 0, 1.0, factor)
    return out * (o - z) * value[leaf][:, None]


def add_attributions(x: np.ndarray, edges: dict, phi: np.ndarray, scale: float) -> None:
    """Add ``scale`` times the attributions of one tree for the rows ``x`` to ``phi`` (both rows x features)."""
    for start in range(0, len(x), ROWS):
        part = np.ascontiguousarray(x[start:start + ROWS].T)
        step = max(1, CELLS // part.shape[1])
        for m, (ends, paths) in edges["leaves"].items():
            for lo in range(0, len(ends), step):
                path = paths[lo:lo + step]
                feature = edges["feature"][path]
                used, place = np.unique(path, return_inverse=True)  # leaves share the edges above them
                place = place.reshape(path.shape)
                seen = part[edges["feature"][used]]
                inside = (seen > edges["low"][used, None]) & (seen <= edges["high"][used, None])
                kind = np.int32 if len(path) << m < 1 << 31 else np.int64
                key = np.repeat(np.arange(len(path), dtype=kind)[:, None] << m, part.shape[1], axis=1)
                for p in range(m):
                    key |= inside[place[:, p]] * kind(1 << p)
                codes, at = _patterns(key, m)
                share = _shares(codes, edges["z"][path], scale * edges["value"][ends[lo:lo + step]])
                for p in range(m):
                    order = np.argsort(feature[:, p], kind="stable")
                    features, first = np.unique(feature[order, p], return_index=True)
                    told = np.ascontiguousarray(share[:, p])[at[order]]
                    phi[start:start + ROWS, features] += np.add.reduceat(told, first, axis=0).T


def leaf_values(x: np.ndarray, tree: dict) -> np.ndarray:
    """Value of the leaf each row reaches, all rows one level at a time."""
    left, right = np.asarray(tree["left"]), np.asarray(tree["right"])
    feature, threshold = np.asarray(tree["feature"]), np.asarray(tree["threshold"])
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(left[at] >= 0)
        if not len(inner):
            return np.asarray(tree["value"])[at]
        node = at[inner]
        at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])


def forest_votes(rows: DataFrame, trees: list[dict]) -> DataFrame:
    """(_row, votes) of ``rows`` (_row, x ARRAY<DOUBLE>): the sum over ``trees`` of the value of the leaf a row reaches."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            votes = sum((leaf_values(x, t) for t in trees), np.zeros(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes)], names=["_row", "votes"])

    return rows.mapInArrow(run, "_row long, votes double")


def explain_rows(df: DataFrame, tables: dict, features: str, keys: list[str], dim: int) -> DataFrame:
    """(keys..., baseline, output, phi ARRAY<DOUBLE>) for every row of ``df``.

    ``features`` is an ARRAY<DOUBLE> column (``vector_to_array`` of the model input).
    """
    trees, weights = tables["trees"], tables["weights"]
    scales = [1.0 / len(trees)] * len(trees) if tables["kind"] == "rf" else weights
    baseline = float(sum(s * t["value"][0] for s, t in zip(scales, trees)))
    rows = df.select(*keys, features)

    def run(batches):
        edges = [leaf_paths(t) for t in trees]
        for batch in batches:
            n = batch.num_rows
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            phi, output = np.zeros((n, dim)), np.zeros(n)
            for s, t, e in zip(scales, trees, edges):
                add_attributions(x, e, phi, s)
                output += s * leaf_values(x, t)
            offsets = pa.array(np.arange(n + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array(np.full(n, baseline)), pa.array(output),
                 pa.ListArray.from_arrays(offsets, pa.array(phi.ravel()))],
                names=[*keys, "baseline", "output", "phi"])

    key_fields = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)
    return rows.mapInArrow(run, f"{key_fields}, baseline double, output double, phi array<double>")
