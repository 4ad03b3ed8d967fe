"""Additive attributions of linear scores.

For a linear score s(x) = b + sum_j w_j x_j and a background mean mu
(taken over the training rows), phi_j = w_j (x_j - mu_j) and the baseline is
b + sum_j w_j mu_j, so baseline + sum_j phi_j = s(x) exactly.

Features travel as one ARRAY<DOUBLE> column; the coefficients are the model
(d numbers per model), so they go into the plan as literal arrays and the
attribution is one ``zip_with`` per row -- no explode, no join, no Python.
The long form (one row per entity x feature) is made only on request, by
``posexplode``.

``class_mean_difference`` is the closed-form linear "model" used where the
operator, not the fit, is under test: w_j = mean(x_j | y = 1) - mean(x_j | y = 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_means(df: DataFrame, features: str, dim: int,
                  label: Column | None = None) -> dict[str, list[float]]:
    """Per-slot means of an array column (one aggregate); with ``label``, also per class.

    Returns {"all": [...], "pos": [...], "neg": [...]}; only d numbers each
    reach the driver.
    """
    x = [F.col(features)[j].cast("double") for j in range(dim)]
    aggs = [F.avg(x[j]).alias(f"a{j}") for j in range(dim)]
    if label is not None:
        aggs += [F.avg(F.when(label, x[j])).alias(f"p{j}") for j in range(dim)]
        aggs += [F.avg(F.when(~label, x[j])).alias(f"n{j}") for j in range(dim)]
    row = df.agg(*aggs).first()
    out = {"all": [float(row[f"a{j}"] or 0.0) for j in range(dim)]}
    if label is not None:
        out["pos"] = [float(row[f"p{j}"] or 0.0) for j in range(dim)]
        out["neg"] = [float(row[f"n{j}"] or 0.0) for j in range(dim)]
    return out


def class_mean_difference(df: DataFrame, features: str, dim: int, label: Column):
    """(weights, background means) of the class-mean-difference model, fitted on ``df``."""
    m = feature_means(df, features, dim, label)
    return [p - n for p, n in zip(m["pos"], m["neg"])], m["all"]


def class_mean_differences(df: DataFrame, features: str, dim: int,
                           labels: dict[str, Column]) -> dict[str, tuple[list[float], list[float]]]:
    """Several class-mean-difference models over the same rows in ONE aggregate.

    The array is exploded to (slot, value) and grouped by slot -- a small
    plan whatever the width, with map-side partial aggregation.  Returns
    {name: (weights, background means)}; (1 + 2 * models) * dim numbers reach
    the driver.
    """
    names = list(labels)
    flags = [lab.alias(f"_y{k}") for k, lab in enumerate(labels.values())]
    long_df = df.select(F.posexplode(features).alias("slot", "x"), *flags)
    x = F.col("x").cast("double")
    aggs = [F.avg(x).alias("a")]
    for k in range(len(names)):
        aggs += [F.avg(F.when(F.col(f"_y{k}"), x)).alias(f"p{k}"),
                 F.avg(F.when(~F.col(f"_y{k}"), x)).alias(f"n{k}")]
    rows = {r["slot"]: r for r in long_df.groupBy("slot").agg(*aggs).collect()}  # dim rows
    mu = [float(rows[j]["a"] or 0.0) if j in rows else 0.0 for j in range(dim)]
    out = {}
    for k, name in enumerate(names):
        w = [(float(rows[j][f"p{k}"] or 0.0) - float(rows[j][f"n{k}"] or 0.0)) if j in rows else 0.0
             for j in range(dim)]
        out[name] = (w, mu)
    return out


def _lit_array(values: Sequence[float]) -> Column:
    """A constant array: one literal that the optimiser folds, not one expression per value."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def linear_attributions(df: DataFrame, features: str, weights: Sequence[float],
                        means: Sequence[float], intercept: float = 0.0,
                        out: str = "phi") -> DataFrame:
    """Add ``phi`` ARRAY<DOUBLE>, ``baseline`` and ``raw_score`` (= baseline + sum phi)."""
    w, mu = _lit_array(weights), _lit_array(means)
    centred = F.zip_with(F.transform(features, lambda v: v.cast("double")), mu, lambda a, b: a - b)
    phi = F.zip_with(w, centred, lambda a, b: a * b)
    baseline = float(intercept) + sum(float(a) * float(b) for a, b in zip(weights, means))
    raw = F.lit(float(intercept)) + F.aggregate(
        F.zip_with(w, F.transform(features, lambda v: v.cast("double")), lambda a, b: a * b),
        F.lit(0.0), lambda acc, v: acc + v)
    return df.withColumns({out: phi, "baseline": F.lit(baseline), "raw_score": raw})


def attribution_sum(phi: str = "phi") -> Column:
    return F.aggregate(phi, F.lit(0.0), lambda acc, v: acc + v)


def long_form(df: DataFrame, keys: Sequence[str], phi: str = "phi",
              features: str | None = None) -> DataFrame:
    """One row per (keys, feature_idx) with phi (and the feature value)."""
    cols = [*keys, F.posexplode(phi).alias("feature_idx", "phi")]
    out = df.select(*keys, phi, *([features] if features else [])).select(
        *cols, *([F.col(features)] if features else []))
    if features:
        out = out.withColumn("value", F.col(features)[F.col("feature_idx")].cast("double")).drop(features)
    return out.withColumn("feature_idx", F.col("feature_idx").cast("bigint"))


def mean_abs(long_df: DataFrame, keys: Sequence[str], feature: str = "feature_idx",
             phi: str = "phi") -> DataFrame:
    """A2 + P17: mean |phi| per (keys, feature) -- partial aggregation on the map side."""
    return long_df.groupBy(*keys, feature).agg(F.avg(F.abs(F.col(phi))).alias("mean_abs"))
