"""Query inputs derived from the driver's tables.

The reference scores compounds; here the entity is a document:
``documents.text`` is the entity string, ``doc_id`` the id, ``labels.toxic``
the label.  Closed-form scores stand in for models where the point is the
metric or attribution operator, not the fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.session import checkpointed

from scorelens.operators.folds import stratified_folds
from scorelens.sources.tables import table, table_version

SEED = 42
N_FOLDS = 5


def labelled_documents(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """documents JOIN labels -> (doc_id, text, lang, source, n_chars, label)."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return docs.join(labels, "doc_id", "inner").filter(F.col("label").isNotNull())


_FOLDS: dict = {}


def document_folds(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """(doc_id, label, fold) for the labelled documents, stratified, seed 42.

    Every metric, scaler and CV query reads the folds, often several times in
    one plan; they are one row per entity, so they are derived once per
    (session, table folder) and checkpointed to the shared checkpoint folder.
    """
    key = (*table_version(spark, sf_dir, "documents", "labels"), label)
    if key not in _FOLDS:
        ids = labelled_documents(spark, sf_dir, label).select("doc_id", "label")
        _FOLDS[key] = checkpointed(stratified_folds(ids, "doc_id", "label", k=N_FOLDS, seed=SEED))
    return _FOLDS[key]


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form predictions: y_prob = (n_chars % 50) / 50 (exact ties on purpose).

    model = lang, y_true = toxic, fold from ``document_folds``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    folds = document_folds(spark, sf_dir)
    return docs.join(folds, "doc_id", "inner").select(
        "doc_id",
        F.col("lang").alias("model"),
        "fold",
        F.col("label").cast("int").alias("y_true"),
        ((F.col("n_chars") % 50).cast("double") / 50).alias("y_prob"),
    )


def scored_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale variant: y_prob = l_discount * 10, y_true = (l_returnflag = 'R'), model = l_linestatus."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linestatus").alias("model"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (F.col("l_discount") * 10).alias("y_prob"),
    )
