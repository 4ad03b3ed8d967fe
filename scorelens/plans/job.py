"""M10 + M11: the end-to-end job on the documents table.

read -> validity filter with counts -> features (fingerprint vector + 15
descriptors, joined by a key check that aborts, stored once as Parquet) ->
stratified outer folds -> nested CV per (feature set, model, fold) ->
predictions, explanations, parameters written partitioned -> per-fold metrics
-> summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.operators import clean as C
from scorelens.operators import fingerprint as FP
from scorelens.operators import metrics as M
from scorelens.operators import tuning as T
from scorelens.operators.combine import aligned_join
from scorelens.operators.descriptors import descriptor_table, node_type_weights
from scorelens.operators.folds import stratified_folds
from scorelens.operators.tokens import TOKEN_SPLIT
from scorelens.plans import inputs
from scorelens.session import checkpointed, ensure_checkpoint_dir, scratch_path
from scorelens.sources.files import discover_datasets, results_base, scan_predictions
from scorelens.sources.tables import table_version

FLAGSHIP_SETS = ("Descriptors", "Combined_Scaled")
FLAGSHIP_MODELS = ("logreg", "rf")
ROWS_PER_PARTITION = 50_000
MIN_ROWS_PER_PARTITION = 1_000  # below this a fit's task costs more than its rows


_FEATURES: dict = {}
_COUNTS: dict = {}


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored feature table, built once per session and state of the tables."""
    key = table_version(spark, sf_dir, "documents", "labels")
    if key not in _FEATURES:
        _FEATURES[key], _COUNTS[key] = job_features(inputs.labelled_documents(spark, sf_dir))
    return _FEATURES[key]


def validity_report(spark: SparkSession, sf_dir: str) -> dict:
    """n_total, n_valid, n_dropped of the rows the job was given, valid or not."""
    document_features(spark, sf_dir)
    return _COUNTS[table_version(spark, sf_dir, "documents", "labels")]


def feature_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, reason) of the rows that get no features: ``invalid`` text, or a valid one with ``no_token``."""
    flagged = C.with_validity(docs, C.text_is_valid("text", "n_chars"))
    tokens = F.size(F.filter(F.split("text", TOKEN_SPLIT), lambda t: t != ""))
    reason = F.when(~F.col("is_valid"), "invalid").when(tokens == 0, "no_token")
    return flagged.select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")


def fit_partitions(rows: int, cores: int) -> int:
    """Partitions of the feature table, for the many fits that follow: one per core or per ROWS_PER_PARTITION rows,
    whichever are more, but of at least MIN_ROWS_PER_PARTITION rows each."""
    return max(1, min(rows // MIN_ROWS_PER_PARTITION, max(cores, -(-rows // ROWS_PER_PARTITION))))


def job_features(lab: DataFrame) -> tuple[DataFrame, dict]:
    """(doc_id, label, fold, ecfp SparseVector, 15 descriptors) of the valid labelled documents, and their counts.

    Invalid rows leave before anything is derived (P2); they are counted over
    the stored flags (an ``Observation`` cannot be used here: with one in the session, Spark's fitted
    linear models no longer serialise).  Fingerprints, descriptors and
    folds must describe the same ids, else the job ends (J2).  The finished table
    is written once as Parquet under the shared checkpoint folder, so every later fit reads
    only its own columns: a fit on descriptors leaves the fingerprints unread.
    """
    spark = lab.sparkSession
    ensure_checkpoint_dir(spark)
    flagged = C.with_validity(lab, C.text_is_valid("text", "n_chars"))
    ids = checkpointed(flagged.select("doc_id", "label", "is_valid"))
    counts = C.validity_counts(ids).first().asDict()
    valid = flagged.where("is_valid")
    bits = FP.fingerprint_bits(FP.environments(valid, FP.RADIUS, FP.N_BITS, masks=True))
    fp = FP.bits_to_vector(FP.fingerprint_table(valid.select("doc_id"), bits), "bits", "ecfp")
    desc = descriptor_table(valid.select("doc_id"), valid.select("doc_id", "text"), node_type_weights(spark))
    folds = stratified_folds(ids.where("is_valid").select("doc_id", "label"), "doc_id", "label", k=inputs.N_FOLDS,
                             seed=inputs.SEED).select("doc_id", F.col("label").cast("double"), "fold")
    feats = aligned_join(folds, aligned_join(fp.select("doc_id", "ecfp"), desc, "doc_id"), "doc_id")
    n = fit_partitions(counts["n_valid"], spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, "features")
    feats.repartition(n, "doc_id").write.parquet(path)
    return spark.read.schema(feats.schema).parquet(path), counts


def run_nested_cv(spark: SparkSession, sf_dir: str, feature_sets=FLAGSHIP_SETS,
                  models=FLAGSHIP_MODELS, quick: bool = True,
                  score_single: bool = False) -> tuple[str, list[dict]]:
    feats = document_features(spark, sf_dir)
    out = results_base(scratch_path(spark, "results"), quick)
    info = T.nested_cv(feats, out, feature_sets, models, quick=quick, score_single=score_single)
    return out, info


DATASET_SCHEMA = "doc_id long, text string, n_chars long, label int"


def run_folder(spark: SparkSession, raw_dir: str, out: str, feature_sets=FLAGSHIP_SETS, models=FLAGSHIP_MODELS,
               quick: bool = True, encoding: str = "UTF-8", **cv) -> tuple[list[dict], dict[str, int]]:
    """Nested CV of every dataset in a folder of CSV files; one results tree, partitioned by dataset first.

    Each dataset is screened, folded and fitted on its own.  Returns the infos of all jobs, and
    the datasets left out with their number of valid rows: those with fewer than folds.
    ``cv`` goes to ``tuning.nested_cv``.
    """
    raw = discover_datasets(spark, raw_dir, DATASET_SCHEMA, encoding)
    infos, left_out = [], {}
    for row in raw.select("dataset").distinct().orderBy("dataset").collect():  # one row per CSV of the folder
        name = row["dataset"]
        feats, counts = job_features(raw.where(F.col("dataset") == name).where("label IS NOT NULL").drop("dataset"))
        if counts["n_valid"] < inputs.N_FOLDS:
            left_out[name] = counts["n_valid"]
            continue
        infos += T.nested_cv(feats, out, feature_sets, models, quick=quick, dataset=name, **cv)
    return infos, left_out


def summary_from_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Entry 2: scan every prediction partition, metrics per fold, then mean/std."""
    pred = scan_predictions(spark, path)
    keys = ["dataset", "feature_set", "model", "fold"]
    per_fold = M.fold_metrics(pred, keys)
    return M.metric_summary(per_fold, keys[:-1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = run_nested_cv(spark, sf_dir)
    return summary_from_predictions(spark, path)
