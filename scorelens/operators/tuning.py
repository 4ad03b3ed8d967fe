"""Grid search and nested cross-validation with explanations.

The driver only loops over the job table (feature set x model x outer fold)
and submits Spark jobs; every row-level step -- fold assignment, scaling,
class weights, fitting, scoring, explaining -- runs on executors.

Grid search stacks the validation predictions of every (grid point, inner fold)
in one long table and ranks them by ONE exact grouped ranking; a fold whose
validation rows have a single class has no score and leaves the mean alone.

A job (feature set, model, outer fold) writes, under partition folders of its
keys, so a retried job replaces only its own:

* ``predictions``   test rows: doc_id, y_true, y_prob, y_pred;
* ``attributions``  train and test rows: split, doc_id, baseline, output (log-odds,
  margin or probability) and phi per feature.

When all jobs are done, one job each writes, under the same folders:

* ``predictions_csv``  the predictions as CSV;
* ``importance``       mean |phi| per feature over the training rows of each fold;
* ``best_params``      JSON with the chosen parameters and their inner score;
* ``facts``            row counts, class weights, scaler statistics, flatness of linear fits.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators import attribution as A
from scorelens.operators import linear as L
from scorelens.operators import metrics as M
from scorelens.operators import models as MD
from scorelens.operators import treeshap as TS
from scorelens.operators.descriptors import DESCRIPTOR_COLUMNS
from scorelens.operators.folds import stratified_folds
from scorelens.operators.scaling import FamilyScalerModel
from scorelens.session import scratch_path
from scorelens.sources.files import PREDICTION_KEYS, write_partitioned

# The four feature sets and which columns they use.
FEATURE_SETS = {
    "ECFP": {"bits": True, "desc": False, "scaled": False},
    "Descriptors": {"bits": False, "desc": True, "scaled": True},
    "Combined_Naive": {"bits": True, "desc": True, "scaled": False},
    "Combined_Scaled": {"bits": True, "desc": True, "scaled": True},
}
MODELS = ("logreg", "rf", "gbt")
TABLES = ("predictions", "predictions_csv", "attributions", "importance", "best_params", "facts")

VALUES_PER_PARTITION = 6_000_000  # below this an iteration's task costs more than its rows

Builder = Callable[[str, str, dict], Pipeline]
Tuner = Callable[[DataFrame, str, str], tuple[dict, float | None]]


def feature_columns(feature_set: str) -> list[str]:
    fs = FEATURE_SETS[feature_set]
    return (["ecfp"] if fs["bits"] else []) + (list(DESCRIPTOR_COLUMNS) if fs["desc"] else [])


def feature_stages(feature_set: str) -> list:
    return [VectorAssembler(inputCols=feature_columns(feature_set), outputCol="features", handleInvalid="error")]


def feature_names(feature_set: str, n_bits: int = 1024) -> list[str]:
    """Names of the slots of ``features``, in order."""
    fs = FEATURE_SETS[feature_set]
    return ([f"ECFP_{i}" for i in range(n_bits)] if fs["bits"] else []) + (list(DESCRIPTOR_COLUMNS) if fs["desc"] else [])


def scale_columns(feature_set: str, model: str) -> list[str] | None:
    """Descriptors are scaled for LogReg only; trees are scale-free."""
    fs = FEATURE_SETS[feature_set]
    if fs["scaled"] and fs["desc"] and MD.MODEL_ALIASES.get(model) == "logreg":
        return list(DESCRIPTOR_COLUMNS)
    return None


def default_builder(feature_set: str, model: str, params: dict) -> Pipeline:
    """(feature set, model, parameters) -> unfitted pipeline; any function of this form may take its place."""
    return MD.model_pipeline(model, feature_stages(feature_set), scale_columns(feature_set, model), **params)


def positive_probability(df: DataFrame, col: str = "probability") -> DataFrame:
    """M9: class-1 probability as a double column ``y_prob``."""
    return df.withColumn("y_prob", vector_to_array(col)[1])


def narrowed(rows: DataFrame, n_rows: int, feature_set: str) -> DataFrame:
    """Rows for one of many fits side by side: of no more partitions than their feature values fill.

    A fit runs a job per iteration or tree level, so on few values it costs what its tasks cost, not its rows.
    """
    n = max(1, -(-n_rows * len(feature_names(feature_set)) // VALUES_PER_PARTITION))
    return rows.coalesce(n)  # never more than there are


# ------------------------------------------------------------------ M5 grid search

def distinct_points(model: str, quick: bool) -> list[dict]:
    """The grid without parameters that Spark's estimators lack, each remaining point once."""
    points = []
    for p in MD.grid_points(model, quick):
        p = {k: v for k, v in p.items() if k != "min_samples_split"}
        if p not in points:
            points.append(p)
    return points


def inner_predictions(train: DataFrame, feature_set: str, model: str, grid: Sequence[dict], k: int = 5, seed: int = 42,
                      parallelism: int = 4, builder: Builder = default_builder) -> DataFrame:
    """(point, inner_fold, doc_id, y_true, y_prob) of every grid point on every inner fold, one stored long table."""
    spark = train.sparkSession
    inner = stratified_folds(train, "doc_id", "label", k=k, seed=seed, fold_col="inner_fold")
    if builder is default_builder:  # a builder of one's own may use other columns
        inner = inner.select("doc_id", "label", "inner_fold", *feature_columns(feature_set))
    inner = inner.checkpoint()
    inner = narrowed(inner, inner.count(), feature_set)
    path = scratch_path(spark, "inner_predictions")

    def one(job):
        point, fold = job
        fitted = builder(feature_set, model, grid[point]).fit(inner.where(F.col("inner_fold") != fold))
        scored = positive_probability(fitted.transform(inner.where(F.col("inner_fold") == fold)))
        write_partitioned(scored.select(F.lit(point).alias("point"), "inner_fold", "doc_id",
                                        F.col("label").cast("int").alias("y_true"), "y_prob"),
                          path, ("point", "inner_fold"))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        list(pool.map(one, [(p, f) for p in range(len(grid)) for f in range(1, k + 1)]))
    return spark.read.schema("doc_id long, y_true int, y_prob double, point int, inner_fold long").parquet(path)


def point_scores(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, point, mean_auc, n_scored, n_folds): one grouped ranking over all points and folds.

    A fold without both classes scores null and counts in ``n_folds`` only; a
    point without any scored fold has a null mean.
    """
    keys = [*by, "point", "inner_fold"]
    ranked = M.ranking_metrics(M.threshold_table(predictions, keys), keys)
    return ranked.groupBy(*by, "point").agg(F.avg("roc_auc").alias("mean_auc"), F.count("roc_auc").alias("n_scored"),
                                       F.count(F.lit(1)).alias("n_folds"))


def best_point(scores: DataFrame) -> tuple[int, float | None]:
    """Highest mean, the first of equals; the first point when none has a score."""
    row = scores.orderBy(F.col("mean_auc").desc_nulls_last(), "point").first()  # grid points, not data rows
    return (int(row["point"]), row["mean_auc"]) if row else (0, None)


def tune(train: DataFrame, feature_set: str, model: str, quick: bool = True, k: int = 5, seed: int = 42,
         parallelism: int = 4, builder: Builder = default_builder, grid: Sequence[dict] | None = None) -> tuple[dict, float | None]:
    """X4, the default tuner: (parameters, mean inner ROC-AUC) of the best grid point; one-point grids are scored too."""
    grid = list(grid) if grid is not None else distinct_points(model, quick)
    scores = point_scores(inner_predictions(train, feature_set, model, grid, k, seed, parallelism, builder))
    point, score = best_point(scores)
    return grid[point], score


def grid_search(train: DataFrame, feature_set: str, model: str, quick: bool = True,
                k: int = 5, seed: int = 42, parallelism: int = 4, score_single: bool = False):
    """M5: (fitted pipeline of the best point, its parameters, its mean inner ROC-AUC).

    A one-point grid has nothing to choose: unless ``score_single`` asks for its
    inner score, it is fitted at once and the score is None.
    """
    grid = distinct_points(model, quick)
    params, score = (grid[0], None) if len(grid) == 1 and not score_single else \
        tune(train, feature_set, model, quick, k, seed, parallelism)
    return default_builder(feature_set, model, params).fit(train), params, score


def linear_search(features: DataFrame, feature_sets: Sequence[str], grid: Sequence[dict], out: str, n_folds: int = 5,
                  k: int = 5) -> dict[tuple, tuple]:
    """M5, M8 of the linear model: (set, "logreg", fold) -> (parameters, mean inner ROC-AUC, fitted pipeline).

    All inner and outer fits of a feature set are done side by side (``linear``); the predictions of the inner ones are kept
    in ``out``.  A fold is left out where a fit lacks a class or does not end.
    """
    packed = L.packed_rows(features, DESCRIPTOR_COLUMNS, n_folds)
    if packed is None:
        return {}
    keys = ("feature_set", "model", "fold")

    def one(fs: str) -> dict[tuple, tuple]:
        use, scaled = FEATURE_SETS[fs], scale_columns(fs, "logreg")
        fits = [L.Fit(o, i, p, float(q["C"])) for o in range(1, n_folds + 1) for i in range(k + 1) for p, q in enumerate(grid)]
        found = L.linear_fits(packed, fits, use["bits"], use["desc"], bool(scaled))
        lost = {f.outer for f, got in zip(fits, found) if got is None}
        done = [got for got in found if got is not None and got.fit.outer not in lost]
        if not done:
            return {}
        pred = L.held_out_scores(packed, [f for f in done if f.fit.inner], use["bits"], use["desc"], n_folds)
        write_partitioned(pred.select("*", F.lit(fs).alias("feature_set"), F.lit("logreg").alias("model")), out, keys)
        kept = features.sparkSession.read.parquet(out).where((F.col("feature_set") == fs) & (F.col("model") == "logreg"))
        scores = [r.asDict() for r in point_scores(kept, ["fold"]).collect()]  # one row per fold and grid point
        chosen = {}
        for o in sorted({f.fit.outer for f in done}):
            best = min((r for r in scores if r["fold"] == o), default={"point": 0, "mean_auc": None}, key=lambda r: (
                r["mean_auc"] is None, -(r["mean_auc"] or 0.0), r["point"]))
            fit = next(f for f in done if f.fit[:3] == (o, 0, best["point"]))
            chosen[fs, "logreg", o] = grid[best["point"]], best["mean_auc"], L.pipeline_of(fit, feature_stages(fs), scaled)
        return chosen

    try:
        with ThreadPoolExecutor(max_workers=len(feature_sets) or 1) as pool:
            return {job: got for part in pool.map(one, feature_sets) for job, got in part.items()}
    finally:
        packed.blocks.unpersist()


# ------------------------------------------------------------------ E1-E4 explanations of a fitted pipeline

def prepared(fitted, rows: DataFrame) -> DataFrame:
    """Rows as the last stage of a fitted pipeline sees them (scaled, assembled), with ``x`` = its features as an array."""
    for stage in fitted.stages[:-1]:
        rows = stage.transform(rows)
    return rows.withColumn("x", vector_to_array("features"))


def mean_vector(rows: DataFrame, vector) -> list[float]:
    """Mean of a vector column: one tree aggregate, whatever its width."""
    row = rows.select(vector.alias("v")).agg(Summarizer.mean(F.col("v")).alias("m")).first()
    return [float(v) for v in row["m"].toArray()] if row["m"] is not None else []


def explain(fitted, train: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """(keys, baseline, output, phi) of ``rows`` in the space the classifier sees; None for a classifier of another kind.

    The output is log-odds for a linear model (background: mean of the training
    rows), the probability for a forest, the margin for boosted trees.
    """
    clf = fitted.stages[-1]
    if isinstance(clf, LogisticRegressionModel):
        background = mean_vector(prepared(fitted, train), F.col("features"))
        return A.linear_attributions(prepared(fitted, rows), "x", clf.coefficients.toArray().tolist(), background,
                                     float(clf.intercept)).select(*keys, "baseline", F.col("raw_score").alias("output"), "phi")
    kind = "rf" if isinstance(clf, (RandomForestClassificationModel, MD.GroupedForestModel)) else "gbt" if isinstance(clf, GBTClassificationModel) else None
    if kind is None:
        return None
    tables = TS.tree_tables(rows.sparkSession, clf, kind)
    return TS.explain_rows(prepared(fitted, rows), tables, "x", list(keys), clf.numFeatures)


def probability_of(output, model_kind: str):
    """Class-1 probability from an explained output."""
    scale = {"logreg": 1.0, "gbt": 2.0}
    return output if model_kind == "rf" else 1 / (1 + F.exp(-scale[model_kind] * output))


def gradient_ratio(fitted, train: DataFrame) -> float | None:
    """Largest |gradient of the penalised loss| over the largest one its terms could reach; None but for linear models.

    Near 0 at the optimum: lambda w_j + sum_i weight_i (p_i - y_i) x_ij / sum_i weight_i.
    """
    clf = fitted.stages[-1]
    if not isinstance(clf, LogisticRegressionModel):
        return None
    weight = F.col(MD.WEIGHT_COL)
    rows = positive_probability(clf.transform(prepared(fitted, train)))
    off = weight * (F.col("y_prob") - F.col("label"))
    # a weight of a vector sum is not negative: the two signs are summed apart
    found = rows.groupBy((off < 0).alias("less")).agg(
        Summarizer.sum(F.col("features"), F.abs(off) + MD.TINY).alias("g"),
        Summarizer.metrics("normL1").summary(F.col("features"), weight)["normL1"].alias("top"), F.sum(weight).alias("total")).collect()
    total = sum(r["total"] for r in found)
    if not total:
        return 0.0
    slope = sum((-1 if r["less"] else 1) * r["g"].toArray() for r in found) / total
    most = sum(r["top"].toArray() for r in found).max() / total
    return float(np.abs(clf.getRegParam() * clf.coefficients.toArray() + slope).max() / most) if most else 0.0


# ------------------------------------------------------------------ M8 outer folds

def outer_fold_job(features: DataFrame, feature_set: str, model: str, fold: int, quick: bool,
                   dataset: str, parallelism: int = 4, score_single: bool = False,
                   builder: Builder = default_builder, tuner: Tuner | None = None, known: tuple | None = None):
    """One (feature set, model, outer fold): tune on train, fit, score test -> (predictions, info, fitted pipeline).

    ``known`` is a search done before: parameters, score, fitted pipeline.
    """
    train = features.filter(F.col("fold") != fold)
    test = features.filter(F.col("fold") == fold)
    if known is not None:
        params, score, best = known
    elif tuner is not None:
        params, score = tuner(train, feature_set, model)
    elif len(distinct_points(model, quick)) == 1 and not score_single:
        params, score = distinct_points(model, quick)[0], None
    else:
        params, score = tune(train, feature_set, model, quick, parallelism=parallelism, builder=builder)
    if known is None:
        best = builder(feature_set, model, params).fit(train)
    pred = positive_probability(best.transform(test)).select(
        F.lit(dataset).alias("dataset"), F.lit(feature_set).alias("feature_set"),
        F.lit(model).alias("model"), F.lit(fold).cast("bigint").alias("fold"),
        "doc_id", F.col("label").cast("int").alias("y_true"), "y_prob",
        (F.col("y_prob") > 0.5).cast("int").alias("y_pred"))
    info = {"dataset": dataset, "feature_set": feature_set, "model": model, "fold": fold,
            "best_params": json.dumps(params, sort_keys=True, default=str),
            "inner_cv_best_score": float(score) if score is not None and score == score else None}
    return pred, info, best


FACTS = ("dataset string, feature_set string, model string, fold long, n_train long, n_test long, weight_0 double, "
         "weight_1 double, scaler_mean array<double>, scaler_std array<double>, n_features int, gradient_ratio double")


def model_facts(fitted, train: DataFrame) -> tuple:
    """Values of the last columns of ``FACTS`` for a fitted pipeline; null where it has no such stage."""
    weights = next((s for s in fitted.stages if isinstance(s, MD.BalancedWeightsModel)), None)
    scaler = next((s for s in fitted.stages if isinstance(s, FamilyScalerModel)), None)
    return (weights and weights.getOrDefault(weights.w0), weights and weights.getOrDefault(weights.w1),
            scaler and scaler.getOrDefault(scaler.means), scaler and scaler.getOrDefault(scaler.stds),
            getattr(fitted.stages[-1], "numFeatures", None), gradient_ratio(fitted, train))


def _tags(info: dict) -> list:
    return [F.lit(info[k]).cast("bigint" if k == "fold" else "string").alias(k) for k in PREDICTION_KEYS]


def write_fold(features: DataFrame, pred: DataFrame, info: dict, fitted, out: str) -> tuple:
    """Scores and attributions of one outer fold, written as soon as they are there; returns its facts."""
    train = features.where(F.col("fold") != info["fold"])
    write_partitioned(pred, f"{out}/predictions")
    both = features.withColumn("split", F.when(F.col("fold") != info["fold"], "train").otherwise("test"))
    told = explain(fitted, train, both, ["split", "doc_id"])
    if told is not None:
        write_partitioned(told.select("*", *_tags(info)), f"{out}/attributions")
    return model_facts(fitted, train)


def importance_of(attributions: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """A2 per fold: (keys, feature_idx, feature, mean_abs) over the training rows of every fold, in one aggregate."""
    spark = attributions.sparkSession
    means = attributions.where("split = 'train'").groupBy(*PREDICTION_KEYS).agg(
        Summarizer.mean(array_to_vector(F.transform("phi", F.abs))).alias("m"))
    long = means.select(*PREDICTION_KEYS, F.posexplode(vector_to_array("m")).alias("feature_idx", "mean_abs"))
    known = spark.createDataFrame([(fs, j, n) for fs, all_ in names.items() for j, n in enumerate(all_)],
                                  "feature_set string, feature_idx int, feature string")
    return long.join(known, ["feature_set", "feature_idx"], "left").select(
        *PREDICTION_KEYS, F.col("feature_idx").cast("bigint").alias("feature_idx"),
        F.coalesce("feature", F.col("feature_idx").cast("string")).alias("feature"), "mean_abs")


def write_reports(spark, infos: list[dict], facts: list[tuple], sizes: dict[int, int], out: str,
                  feature_sets: Sequence[str]) -> None:
    """What all folds of a run leave together, each table in one job, partitioned by the keys of the run."""
    keys = [tuple(i[k] for k in PREDICTION_KEYS) for i in infos]
    total = sum(sizes.values())
    rows = [(*k, total - sizes.get(k[3], 0), sizes.get(k[3], 0), *f) for k, f in zip(keys, facts)]
    write_partitioned(spark.createDataFrame(rows, FACTS), f"{out}/facts")
    chosen = spark.createDataFrame(
        [(*k, {a: str(b) for a, b in json.loads(i["best_params"]).items()}, i["inner_cv_best_score"]) for k, i in zip(keys, infos)],
        "dataset string, feature_set string, model string, fold long, best_params map<string,string>, inner_cv_best_score double")
    told = F.to_json(F.struct("best_params", "inner_cv_best_score"), {"ignoreNullFields": "false"})
    write_partitioned(chosen.select(told.alias("value"), *PREDICTION_KEYS), f"{out}/best_params", fmt="text")
    write_partitioned(spark.read.parquet(f"{out}/predictions"), f"{out}/predictions_csv", fmt="csv", header=True)
    try:
        attributions = spark.read.parquet(f"{out}/attributions")
    except AnalysisException:  # no classifier of a kind that can be explained
        return
    write_partitioned(importance_of(attributions, {fs: feature_names(fs) for fs in feature_sets}), f"{out}/importance")


def known_runs(feature_sets: Sequence[str], models: Sequence[str], builder: Builder = default_builder):
    """The runs to do and the names left out, (sets, models, unknown); a builder of one's own knows its own models."""
    sets = [s for s in feature_sets if s in FEATURE_SETS]
    kept = [m for m in models if m in MD.MODEL_ALIASES or builder is not default_builder]
    return sets, kept, [s for s in feature_sets if s not in sets] + [m for m in models if m not in kept]


def nested_cv(features: DataFrame, out_path: str, feature_sets=("Descriptors",), models=("logreg",),
              quick: bool = True, dataset: str = "documents", n_folds: int = 5,
              workers: int = 8, parallelism: int = 2, score_single: bool = False,
              builder: Builder = default_builder, tuner: Tuner | None = None, explained: bool = False,
              known: dict[tuple, tuple] | None = None):
    """M8 + M10: run the job table; predictions under ``out_path`` partitioned by (dataset, feature_set, model, fold).

    ``builder`` (X3) and ``tuner`` (X4: training rows, set, model -> parameters,
    score) may be the user's; ``known`` has searches done before (``linear_search``), by (set, model, fold).  With ``explained``, ``out_path`` gets one folder per
    table of the module docstring instead.  Unknown sets and models are skipped with a
    warning (P19).  Returns the info dicts of the jobs (parameters, inner score).
    """
    import warnings

    sets, models, unknown = known_runs(feature_sets, models, builder)
    for name in unknown:
        warnings.warn(f"no feature set or model of the name {name!r}: skipped", stacklevel=2)
    jobs = [(fs, m, f) for fs in sets for m in models for f in range(1, n_folds + 1)]
    sizes = {r["fold"]: r["count"] for r in features.groupBy("fold").count().collect()}  # one row per fold

    def run(job):
        fs, m, f = job
        rows = narrowed(features, sum(sizes.values()), fs)
        pred, info, fitted = outer_fold_job(rows, fs, m, f, quick, dataset, parallelism, score_single, builder, tuner,
                                            (known or {}).get(job))
        if not explained:
            write_partitioned(pred, out_path)
            return info, None
        return info, write_fold(features, pred, info, fitted, out_path)

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        # linear fits of many features take the most iterations: begun first, none is left alone at the end
        first = sorted(jobs, key=lambda j: -len(feature_names(j[0])) if MD.MODEL_ALIASES.get(j[1]) == "logreg" else 1)
        begun = {job: pool.submit(run, job) for job in first}
        done = [begun[job].result() for job in jobs]
    infos = [info for info, _ in done]
    if explained and infos:
        write_reports(features.sparkSession, infos, [facts for _, facts in done], sizes, out_path, sets)
    return infos
