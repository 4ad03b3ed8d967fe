"""Spark side of every registered query: ``name -> fn(spark, sf_dir) -> DataFrame``.

Column names, types and rounding match ``scorelens.plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions.exprs import r6, safe_div
from scorelens.operators import metrics as M
from scorelens.plans import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

METRIC_COLS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ folds

@register("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    f = inputs.document_folds(spark, sf_dir)
    return f.select(F.col("doc_id").cast("bigint"), F.col("label").cast("bigint"), "fold")


@register("stratified_fold_counts")
def q_stratified_fold_counts(spark, sf_dir):
    f = inputs.document_folds(spark, sf_dir)
    return f.groupBy("fold", F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- metrics

def _metric_select(df: DataFrame, group_cols: list[str]) -> DataFrame:
    return df.select(*group_cols, "n", *[r6(c, c) for c in METRIC_COLS])


@register("metrics_fold")
def q_metrics_fold(spark, sf_dir):
    pred = inputs.scored_documents(spark, sf_dir)
    return _metric_select(M.fold_metrics(pred, ["model", "fold"]), ["model", "fold"])


@register("metrics_lineitem")
def q_metrics_lineitem(spark, sf_dir):
    pred = inputs.scored_lineitems(spark, sf_dir)
    return _metric_select(M.fold_metrics(pred, ["model"]), ["model"])


# ------------------------------------------------------- cleaning

from scorelens.operators import clean as C  # noqa: E402
from scorelens.sources.tables import table, table_version  # noqa: E402


@register("validity_split")
def q_validity_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.text_is_valid("text", "n_chars").alias("is_valid"))


@register("validity_counts")
def q_validity_counts(spark, sf_dir):
    docs = C.with_validity(table(spark, sf_dir, "documents"), C.text_is_valid("text", "n_chars"))
    return C.validity_counts(docs)


@register("sample_id")
def q_sample_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("_labelled"))
    named = docs.join(lab, "doc_id", "left").withColumn(
        "name", F.when(F.col("_labelled"), F.col("source")))
    return named.select("doc_id", C.sample_id("name", "doc_id").alias("sample_id"))


@register("split_xy")
def q_split_xy(spark, sf_dir):
    df, _ = C.split_xy(inputs.labelled_documents(spark, sf_dir), "label", "doc_id", ("text",))
    return df.withColumn("label", F.col("label").cast("bigint"))


@register("label_encode")
def q_label_encode(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    return C.fit_label_encoder(ev, "event_type", "code").transform(ev)


@register("label_distribution")
def q_label_distribution(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("toxic").cast("bigint").alias("label"))
    return C.label_distribution(lab.filter(F.col("label").isNotNull()), "label")


@register("class_weights")
def q_class_weights(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("toxic").cast("bigint").alias("label"))
    w = C.class_weights(lab.filter(F.col("label").isNotNull()), "label")
    return w.select("label", "n_c", r6("weight", "weight"))


# ------------------------------------------------------------ text graph + fingerprints

from scorelens.operators import descriptors as D  # noqa: E402
from scorelens.operators import fingerprint as FP  # noqa: E402


@register("token_graph")
def q_token_graph(spark, sf_dir):
    from scorelens.operators.tokens import doc_edges

    return doc_edges(table(spark, sf_dir, "documents")).select(
        "doc_id", "src_pos", "dst_pos", "src_tok", "dst_tok")


@register("fingerprint_r1")
def q_fingerprint_r1(spark, sf_dir):
    return FP.fingerprint_bits(FP.environments(table(spark, sf_dir, "documents"), radius=1, masks=True))


@register("fingerprint_r3")
def q_fingerprint_r3(spark, sf_dir):
    return FP.fingerprint_bits(FP.environments(table(spark, sf_dir, "documents"), radius=3, masks=True))


def labelled_fingerprints(spark, sf_dir):
    """F3 on the labelled documents: (doc_id, name, label, bits ARRAY<BIGINT>)."""
    lab = inputs.labelled_documents(spark, sf_dir)
    ents = lab.select("doc_id", F.col("source").alias("name"), F.col("label").cast("bigint"))
    bits = FP.fingerprint_bits(FP.environments(lab, radius=FP.RADIUS, masks=True))
    return FP.fingerprint_table(ents, bits)


@register("fingerprint_table")
def q_fingerprint_table(spark, sf_dir):
    ft = labelled_fingerprints(spark, sf_dir)
    return ft.select("doc_id", "name", "label", F.size("bits").cast("bigint").alias("n_on"),
                     F.array_join("bits", ",").alias("bits"))


@register("fingerprint_width")
def q_fingerprint_width(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    vec = FP.bits_to_vector(labelled_fingerprints(spark, sf_dir), "bits", "ecfp")
    dense = vec.select("doc_id", vector_to_array("ecfp").alias("x"))
    return dense.select(
        "doc_id",
        F.size("x").cast("bigint").alias("width"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("n_on"),
        F.aggregate(F.transform("x", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
        .cast("bigint").alias("checksum"),
    )


# ------------------------------------------------------------------ descriptors

INT_DESCRIPTORS = ("hbd", "hba", "rotatable_bonds", "ring_count", "aromatic_rings",
                   "aliphatic_rings", "heavy_atoms")


def _desc_select(df, keys):
    return df.select(*keys, *[
        F.col(c).cast("bigint").alias(c) if c in INT_DESCRIPTORS else r6(c, c)
        for c in D.DESCRIPTOR_COLUMNS])


def document_descriptors(spark, sf_dir, docs=None):
    docs = docs if docs is not None else table(spark, sf_dir, "documents")
    return D.descriptor_table(docs.select("doc_id"), docs.select("doc_id", "text"),
                              D.node_type_weights(spark))


@register("descriptors")
def q_descriptors(spark, sf_dir):
    return _desc_select(document_descriptors(spark, sf_dir), ["doc_id"])


@register("fill_zero")
def q_fill_zero(spark, sf_dir):
    """Descriptors come only from valid documents; every document gets a row,
    invalid ones all-zero; the (possibly null) label is left alone."""
    docs = table(spark, sf_dir, "documents")
    valid = docs.filter(C.text_is_valid("text", "n_chars"))
    feats = document_descriptors(spark, sf_dir, valid)
    # the label stays null for unlabelled documents (never filled); as a double,
    # the type Spark ML labels have
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    ents = docs.select("doc_id").join(lab, "doc_id", "left")
    filled = D.fill_zero(ents.join(feats, "doc_id", "left"), D.DESCRIPTOR_COLUMNS)
    return _desc_select(filled, ["doc_id", "label"])


# -------------------------------------------------------------------- joins

@register("combined_features")
def q_combined_features(spark, sf_dir):
    ft = labelled_fingerprints(spark, sf_dir)
    lab = inputs.labelled_documents(spark, sf_dir)
    desc = document_descriptors(spark, sf_dir, lab)
    both = ft.join(desc, "doc_id", "inner")
    return _desc_select(both.select("*", F.size("bits").cast("bigint").alias("n_on"),
                                    F.array_join("bits", ",").alias("bits_csv")),
                        ["doc_id", "label", "n_on", "bits_csv"])


@register("alignment_check")
def q_alignment_check(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("l_id"))
    right = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("r_id"))
    j = left.join(right, F.col("l_id") == F.col("r_id"), "full_outer")
    return j.agg(
        F.count("l_id").alias("n_left"),
        F.count("r_id").alias("n_right"),
        F.count_if(F.col("l_id").isNull() | F.col("r_id").isNull()).alias("n_mismatch"),
    )


# -------------------------------------------------------------------- file round trips

from scorelens.session import checkpointed, scratch_path  # noqa: E402
from scorelens.sources import files as IO  # noqa: E402


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "customer_csv")
    IO.write_csv(cust, path, sep=",", encoding=IO.LATIN1)
    return IO.read_csv(spark, path, cust.schema, sep=",", encoding=IO.LATIN1)


@register("tsv_roundtrip")
def q_tsv_roundtrip(spark, sf_dir):
    nat = table(spark, sf_dir, "nation")
    path = scratch_path(spark, "nation_tsv")
    IO.write_csv(nat, path, sep="\t")
    return IO.read_csv(spark, path, nat.schema, sep="\t", encoding="UTF-8")


# ------------------------------------------------------------ metrics family

def _doc_thresholds(spark, sf_dir):
    return M.threshold_table(inputs.scored_documents(spark, sf_dir), ["model", "fold"])


@register("confusion")
def q_confusion(spark, sf_dir):
    pred = inputs.scored_documents(spark, sf_dir).withColumn("y_pred", M.predict_class("y_prob"))
    cm = M.confusion_matrix(pred, ["model", "fold"])
    return cm.select("model", "fold", F.col("actual").cast("bigint").alias("actual"),
                     F.col("pred_0").cast("bigint"), F.col("pred_1").cast("bigint"))


@register("roc_points")
def q_roc_points(spark, sf_dir):
    pts = M.roc_points(_doc_thresholds(spark, sf_dir), ["model", "fold"])
    return pts.select("model", "fold", r6("threshold", "threshold"), r6("fpr", "fpr"), r6("tpr", "tpr"))


@register("roc_points_reduced")
def q_roc_points_reduced(spark, sf_dir):
    th = _doc_thresholds(spark, sf_dir).withColumnRenamed("score", "threshold")
    red = M.roc_points_reduced(th, ["model", "fold"])
    return red.select("model", "fold", r6("threshold", "threshold"),
                      r6(safe_div("cum_neg", "N", None), "fpr"), r6(safe_div("cum_pos", "P", None), "tpr"))


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    rk = M.ranking_metrics(_doc_thresholds(spark, sf_dir), ["model", "fold"])
    return rk.select("model", "fold", r6("roc_auc", "roc_auc"))


@register("average_precision")
def q_average_precision(spark, sf_dir):
    rk = M.ranking_metrics(_doc_thresholds(spark, sf_dir), ["model", "fold"])
    return rk.select("model", "fold", r6("pr_auc", "pr_auc"))


@register("metric_summary")
def q_metric_summary(spark, sf_dir):
    per_fold = M.fold_metrics(inputs.scored_documents(spark, sf_dir), ["model", "fold"])
    s = M.metric_summary(per_fold, ["model"])
    return s.select("model", *[r6(c, c) for c in s.columns if c != "model"])


# ------------------------------------------------------------ scaling

@register("scale_descriptors")
def q_scale_descriptors(spark, sf_dir):
    from scorelens.operators.scaling import FamilyScaler

    lab = inputs.labelled_documents(spark, sf_dir)
    # fitted on, then transformed: derive it once
    desc = checkpointed(document_descriptors(spark, sf_dir, lab).join(
        inputs.document_folds(spark, sf_dir).select("doc_id", "fold"), "doc_id"))
    cols = list(D.DESCRIPTOR_COLUMNS)
    model = FamilyScaler(inputCols=cols, outputCols=cols).fit(desc.filter(F.col("fold") != 1))
    out = model.transform(desc)
    return out.select("doc_id", "fold", *[r6(c, c) for c in cols])


# ------------------------------------------------------------ attributions on embeddings

from scorelens.operators import attribution as A  # noqa: E402
from scorelens.operators import importance as I  # noqa: E402
from scorelens.plans import explain as X  # noqa: E402


@register("linear_attr")
def q_linear_attr(spark, sf_dir):
    att = X.embedding_attributions(spark, sf_dir)
    return att.select("model", "vec_id", r6("baseline", "baseline"), r6("raw_score", "raw_score"),
                      r6(A.attribution_sum("phi"), "phi_sum"))


@register("attr_long")
def q_attr_long(spark, sf_dir):
    lf = X.embedding_long(spark, sf_dir)
    return lf.select("model", "vec_id", "feature_idx", r6("phi", "phi"))


@register("mean_abs_attr")
def q_mean_abs_attr(spark, sf_dir):
    return X.embedding_mean_abs(spark, sf_dir).select("model", "feature_idx", r6("mean_abs", "mean_abs"))


@register("topn_importance")
def q_topn_importance(spark, sf_dir):
    ma = X.embedding_mean_abs(spark, sf_dir).filter(F.col("model") == "lt5")
    return I.top_n(ma, 10).select("feature_idx", r6("mean_abs", "mean_abs"))


@register("summary_points")
def q_summary_points(spark, sf_dir):
    ma = X.embedding_mean_abs(spark, sf_dir).filter(F.col("model") == "lt5")
    top = I.top_n(ma, 5).select("feature_idx")
    lf = X.embedding_long(spark, sf_dir).filter(F.col("model") == "lt5")
    pts = lf.join(F.broadcast(top), "feature_idx", "left_semi")  # top-5 list: 5 rows
    return pts.select("vec_id", "feature_idx", r6("phi", "phi"), r6("value", "value"))


# ------------------------------------------------------------ document importance

@register("family_filter")
def q_family_filter(spark, sf_dir):
    ecfp = I.family_filter(X.combined_importance(spark, sf_dir))
    return ecfp.select("model", "feature", r6("mean_abs", "mean_abs"))


@register("feature_index")
def q_feature_index(spark, sf_dir):
    ecfp = I.family_filter(X.doc_bit_importance(spark, sf_dir))
    return ecfp.select("model", "feature", I.feature_index("feature").alias("feature_idx"))


@register("importance_union")
def q_importance_union(spark, sf_dir):
    from pyspark.sql import Window

    u = X.combined_importance(spark, sf_dir)
    # global rank over an importance table: (models x features) rows, not data rows
    w = Window.orderBy(F.col("mean_abs").desc(), "model", "feature")
    return u.select("model", "feature", "family", r6("mean_abs", "mean_abs"),
                    F.row_number().over(w).cast("bigint").alias("rank"))


@register("importance_preview")
def q_importance_preview(spark, sf_dir):
    u = X.combined_importance(spark, sf_dir)
    top = u.orderBy(F.col("mean_abs").desc(), "model", "feature").limit(10)
    return top.select("model", "feature", r6("mean_abs", "mean_abs"))


@register("topn_per_model")
def q_topn_per_model(spark, sf_dir):
    return X.top_bits(spark, sf_dir).select("model", "feature", "feature_idx",
                                            r6("mean_abs", "mean_abs"), "rank")


@register("mean_of_fold_means")
def q_mean_of_fold_means(spark, sf_dir):
    folds = inputs.document_folds(spark, sf_dir).select("doc_id", "fold")
    labels = X.doc_labels_long(spark, sf_dir).join(folds, "doc_id")
    bits = FP.fingerprint_bits(X.doc_environments(spark, sf_dir, masks=True))
    per_fold = I.bit_importance(bits, labels, group_cols=["model", "fold"])
    pooled = I.mean_of_fold_means(per_fold, ["model", "bit"])
    return pooled.select("model", "bit", r6("mean_abs", "mean_abs"), "n_folds")


# ------------------------------------------------------------ fragments

def _fragment_rows(spark, sf_dir, pooled=False):
    top = X.pooled_top_bits(spark, sf_dir) if pooled else X.top_bits(spark, sf_dir)
    return X.fragment_rows(spark, sf_dir, top)


@register("bit_fragments")
def q_bit_fragments(spark, sf_dir):
    return X.first_fragments(spark, sf_dir, X.top_bits(spark, sf_dir)).select(
        "doc_id", "bit", F.col("radius").cast("bigint"), "pos", "fragment")


@register("top_bit_fragments")
def q_top_bit_fragments(spark, sf_dir):
    return _fragment_rows(spark, sf_dir)


@register("top_bit_fragments_pooled")
def q_top_bit_fragments_pooled(spark, sf_dir):
    return _fragment_rows(spark, sf_dir, pooled=True)


@register("fragments_nonblank")
def q_fragments_nonblank(spark, sf_dir):
    rows = _fragment_rows(spark, sf_dir)
    return rows.filter(F.col("fragment").isNotNull() & (F.trim("fragment") != "")) \
        .select("model", "doc_id", "bit", "fragment")


@register("benchmark_fragments")
def q_benchmark_fragments(spark, sf_dir):
    """Top slots traced in a second corpus, with warning rows for those it never sets."""
    return X.benchmark_fragment_rows(spark, sf_dir)


@register("unresolved_bits")
def q_unresolved_bits(spark, sf_dir):
    """(model, bit) of the top slots that no row of the second corpus resolves."""
    rows = X.benchmark_fragment_rows(spark, sf_dir)
    ok = rows.groupBy("model", "bit").agg(F.bool_or(F.col("fragment").isNotNull()).alias("ok"))
    return ok.filter(~F.col("ok")).select("model", "bit")


@register("bit_collisions")
def q_bit_collisions(spark, sf_dir):
    return FP.bit_collisions(X.doc_environments(spark, sf_dir, with_fragments=True))


@register("first_last_per_key")
def q_first_last_per_key(spark, sf_dir):
    rows = _fragment_rows(spark, sf_dir).filter(F.col("doc_id").isNotNull())
    return rows.groupBy("model", "bit").agg(
        F.min("doc_id").alias("first_doc"),
        F.min_by(F.struct("fragment"), "doc_id")["fragment"].alias("first_fragment"),
        F.max("doc_id").alias("last_doc"),
        F.max_by(F.struct("fragment"), "doc_id")["fragment"].alias("last_fragment"),
    )


def _lookup(spark, sf_dir):
    rows = _fragment_rows(spark, sf_dir)
    dictionary = X.fragment_dictionary(rows)
    top = X.top_bits(spark, sf_dir).select("model", "feature", F.col("feature_idx").alias("bit"),
                                          "mean_abs")
    return I.lookup_with_default(top, dictionary, ["model", "bit"], "fragment")


@register("fragment_lookup")
def q_fragment_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir).select("model", "bit", "feature", "fragment", r6("mean_abs", "mean_abs"))


@register("importance_merge")
def q_importance_merge(spark, sf_dir):
    merged = I.merge_models(_lookup(spark, sf_dir), X.DOC_MODELS)
    return merged.select("feature", "fragment",
                         *[r6(f"mean_abs_{m}", f"mean_abs_{m}") for m in X.DOC_MODELS])


# ------------------------------------------------------------ models and nested CV (M1-M11, rows-only)

from scorelens.plans import job as JOB  # noqa: E402


def flagship(spark, sf_dir):
    """Quick nested CV (Descriptors + Combined_Scaled, LogReg + RF) -> metric summary."""
    s = JOB.flagship(spark, sf_dir)
    return s.select("dataset", "feature_set", "model",
                    *[r6(c, c) for c in s.columns if c not in ("dataset", "feature_set", "model")])


register("flagship")(flagship)


def _single_fold_scores(spark, sf_dir, model, feature_set="Combined_Naive"):
    from scorelens.operators import tuning as T

    feats = JOB.document_features(spark, sf_dir)
    pred, _, _ = T.outer_fold_job(feats, feature_set, model, 1, True, "documents")
    return pred.select("doc_id", "y_true", r6("y_prob", "y_prob"), "y_pred")


@register("logreg_scores")
def q_logreg_scores(spark, sf_dir):
    return _single_fold_scores(spark, sf_dir, "logreg")


@register("rf_scores")
def q_rf_scores(spark, sf_dir):
    return _single_fold_scores(spark, sf_dir, "rf")


@register("gbt_scores")
def q_gbt_scores(spark, sf_dir):
    return _single_fold_scores(spark, sf_dir, "gbt", "Descriptors")


# ------------------------------------------------------------ fitted-model attributions (E1-E4, rows-only)

def _fold1_fit(spark, sf_dir, model, feature_set):
    from scorelens.operators import tuning as T

    feats = JOB.document_features(spark, sf_dir)
    train, test = feats.filter(F.col("fold") != 1), feats.filter(F.col("fold") == 1)
    best, params, score = T.grid_search(train, feature_set, model, quick=True)
    return feats, train, test, best


@register("tree_attr")
def q_tree_attr(spark, sf_dir):
    """E2 + E3: TreeSHAP of the fold-1 forest (quick grid) on its test rows."""
    from pyspark.ml.functions import vector_to_array

    from scorelens.operators import treeshap as TS

    _, _, test, best = _fold1_fit(spark, sf_dir, "rf", "Descriptors")
    forest = best.stages[-1]
    tables = TS.tree_tables(spark, forest, "rf")
    prepared = test
    for stage in best.stages[:-1]:
        prepared = stage.transform(prepared)
    rows = prepared.withColumn("x", vector_to_array("features"))
    att = TS.explain_rows(rows, tables, "x", ["doc_id"], forest.numFeatures)
    return att.select("doc_id", r6("baseline", "baseline"), r6("output", "output"),
                      r6(A.attribution_sum("phi"), "phi_sum"))


@register("logreg_attr")
def q_logreg_attr(spark, sf_dir):
    """E1 + E3 + E4: linear attributions of the fold-1 LogReg in its scaled space;
    background = mean of the transformed training rows."""
    from pyspark.ml.functions import vector_to_array

    _, train, test, best = _fold1_fit(spark, sf_dir, "logreg", "Descriptors")
    lr = best.stages[-1]

    def prep(df):
        for stage in best.stages[:-1]:
            df = stage.transform(df)
        return df.withColumn("x", vector_to_array("features"))

    dim = lr.numFeatures
    mu = A.feature_means(prep(train), "x", dim)["all"]
    att = A.linear_attributions(prep(test), "x", lr.coefficients.toArray().tolist(), mu,
                                float(lr.intercept))
    return att.select("doc_id", r6("baseline", "baseline"), r6("raw_score", "raw_score"),
                      r6(A.attribution_sum("phi"), "phi_sum"))


_GRID: dict = {}


def _grid_search_rows(spark, sf_dir):
    """The search result is a one-row table: kept per (session, table folder)
    so the JSON view of it does not run the search again."""
    key = table_version(spark, sf_dir, "documents", "labels")
    if key not in _GRID:
        _GRID[key] = _run_grid_search(spark, sf_dir)
    return _GRID[key]


def _run_grid_search(spark, sf_dir):
    from scorelens.operators import tuning as T

    feats = JOB.document_features(spark, sf_dir)
    train = feats.filter(F.col("fold") != 1)
    _, params, score = T.grid_search(train, "Descriptors", "logreg", quick=False, score_single=True)
    row = [("Descriptors", "logreg", {f"clf__{k}": str(v) for k, v in params.items()}, float(score))]
    return spark.createDataFrame(
        row, "feature_set string, model string, best_params map<string,string>, "
             "inner_cv_best_score double")


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """M5: full LogReg grid (4 points) by mean inner ROC-AUC on the fold-1 training rows."""
    return _grid_search_rows(spark, sf_dir)


@register("params_json")
def q_params_json(spark, sf_dir):
    """S8 + P12: the best parameters as JSON, estimator prefix stripped."""
    return IO.best_params_json(_grid_search_rows(spark, sf_dir)).select(
        "feature_set", "model", "params_json")


@register("nested_cv")
def q_nested_cv(spark, sf_dir):
    """M8: per outer fold, the tuned parameters and the inner CV score (quick grid,
    its one point scored by the inner folds), as written next to each fold's predictions."""
    _, info = JOB.run_nested_cv(spark, sf_dir, ("Descriptors",), ("logreg",), quick=True,
                                score_single=True)
    return spark.createDataFrame(
        [(i["dataset"], i["feature_set"], i["model"], int(i["fold"]), i["best_params"],
          i["inner_cv_best_score"]) for i in info],
        "dataset string, feature_set string, model string, fold long, best_params string, "
        "inner_cv_best_score double")


from scorelens.plans import fitted  # noqa: E402

QUERIES.update(fitted.QUERIES)
