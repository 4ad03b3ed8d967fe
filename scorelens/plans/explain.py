"""Explanation reports on the driver's tables.

Two families of fixed linear models stand in for fitted ones, so every
number is reproducible by SQL:

* documents: class-mean-difference models on the labelled documents' hashed
  slots (and scaled descriptors), one per label column ("toxic", "quality");
* embeddings: class-mean-difference models on the 64 embedding slots for
  the binary targets label < 3, < 5, < 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.session import checkpointed

from scorelens.operators import attribution as A
from scorelens.operators import descriptors as D
from scorelens.operators import fingerprint as FP
from scorelens.operators import importance as I
from scorelens.operators.scaling import FamilyScaler
from scorelens.plans import inputs
from scorelens.sources.tables import table, table_version

DOC_MODELS = ("toxic", "quality")
EMB_MODELS = {"lt3": 3, "lt5": 5, "lt7": 7}
EMB_DIM = 64
TOP_N = 20
# Status of a fragment row.
NOTE_RESOLVED = "resolved"
NOTE_FAILED = "no_fragment"
NOTE_UNRESOLVED = "absent"


# ------------------------------------------------------------------ documents

def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, source, toxic, quality) for documents with labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf_dir, "labels").filter(F.col("toxic").isNotNull())
    return docs.join(lab.select("doc_id", "toxic", "quality"), "doc_id", "inner")


def doc_labels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, model, label): one row per labelled document and label column."""
    lab = labelled_docs(spark, sf_dir).select("doc_id", *DOC_MODELS)
    return lab.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).cast("int").alias("label"))
        for m in DOC_MODELS])).alias("_m")).select("doc_id", "_m.model", "_m.label") \
        .filter(F.col("label").isNotNull())


def doc_environments(spark: SparkSession, sf_dir: str, with_fragments: bool = False, masks: bool = False) -> DataFrame:
    return FP.environments(labelled_docs(spark, sf_dir), FP.RADIUS, FP.N_BITS,
                           with_fragments=with_fragments, masks=masks)


def doc_bit_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, feature, feature_idx, family, mean_abs) for the hashed slots."""
    bits = FP.fingerprint_bits(doc_environments(spark, sf_dir, masks=True))
    imp = I.bit_importance(bits, doc_labels_long(spark, sf_dir), group_cols=["model"])
    return imp.select("model", I.feature_name(I.ECFP_PREFIX, "bit").alias("feature"),
                      F.col("bit").alias("feature_idx"), F.lit("ECFP").alias("family"), "mean_abs")


def doc_descriptor_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, feature, feature_idx, family, mean_abs) for the 15 scaled descriptors.

    z = population-standardised descriptor; w = mean(z | 1) - mean(z | 0);
    mean |phi| = |w| * mean |z - mean z|.  Two small aggregates over one row
    per document.
    """
    ld = labelled_docs(spark, sf_dir)
    # read three times below (scaler fit, class means, deviations): one row per
    # document, so it is checkpointed once instead of re-derived from the text
    desc = checkpointed(D.descriptor_table(ld.select("doc_id"), ld.select("doc_id", "text"),
                                           D.node_type_weights(spark)))
    cols = list(D.DESCRIPTOR_COLUMNS)
    z = FamilyScaler(inputCols=cols, outputCols=cols).fit(desc).transform(desc)
    longz = z.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(1024 + j).cast("bigint").alias("feature_idx"),
                 F.col(c).alias("z")) for j, c in enumerate(cols)])).alias("_d")) \
        .select("doc_id", "_d.*")
    joined = longz.join(doc_labels_long(spark, sf_dir), "doc_id", "inner")
    stats = joined.groupBy("model", "feature", "feature_idx").agg(
        (F.avg(F.when(F.col("label") == 1, F.col("z")))
         - F.avg(F.when(F.col("label") == 0, F.col("z")))).alias("w"),
        F.avg("z").alias("mu"))
    dev = joined.join(stats, ["model", "feature", "feature_idx"]).groupBy(
        "model", "feature", "feature_idx", "w").agg(F.avg(F.abs(F.col("z") - F.col("mu"))).alias("mad"))
    return dev.select("model", "feature", "feature_idx", F.lit("descriptor").alias("family"),
                      (F.abs(F.coalesce("w", F.lit(0.0))) * F.col("mad")).alias("mean_abs"))


def combined_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed slots and descriptors of every model in one long table
    (models x features rows), built once per (session, table folder)."""
    return _once(("combined", *table_version(spark, sf_dir, "documents", "labels")),
                 lambda: doc_bit_importance(spark, sf_dir).unionByName(
                     doc_descriptor_importance(spark, sf_dir)))


_TOP: dict = {}


def _once(key, build):
    """A small derived table (a top-N list: models x N rows), computed once per
    (session, table folder) and checkpointed, so the reports that read it
    several times do not re-derive it from the text."""
    if key not in _TOP:
        _TOP[key] = checkpointed(build())
    return _TOP[key]


def top_bits(spark: SparkSession, sf_dir: str, n: int = TOP_N) -> DataFrame:
    """W4 after P5: top-n hashed slots per model, ties by slot."""
    def build():
        ecfp = I.family_filter(doc_bit_importance(spark, sf_dir))
        return I.top_n_per_group(ecfp, ["model"], n)
    return _once(("top", *table_version(spark, sf_dir, "documents", "labels"), n), build)


def pooled_top_bits(spark: SparkSession, sf_dir: str, n: int = TOP_N) -> DataFrame:
    """F8 + A3: slot importance per outer fold (training rows of that fold),
    averaged over folds, then top-n per model."""
    labels = doc_labels_long(spark, sf_dir).join(inputs.document_folds(spark, sf_dir).select("doc_id", "fold"), "doc_id")
    bits = FP.fingerprint_bits(doc_environments(spark, sf_dir, masks=True))
    pooled = I.pooled_bit_importance(bits, labels)
    pooled = pooled.withColumnRenamed("bit", "feature_idx").withColumn(
        "feature", I.feature_name(I.ECFP_PREFIX, "feature_idx"))
    return _once(("pooled", *table_version(spark, sf_dir, "documents", "labels"), n), lambda: I.top_n_per_group(pooled, ["model"], n))


def first_fragments(spark: SparkSession, sf_dir: str, bits: DataFrame) -> DataFrame:
    """(doc_id, bit, radius, pos, fragment) -- first environment per (labelled document, selected bit)."""
    return fragments_in(labelled_docs(spark, sf_dir), bits)


def fragments_in(docs: DataFrame, bits: DataFrame, radius: int = FP.RADIUS, id_col: str = "doc_id") -> DataFrame:
    """First environment, up to ``radius``, per (text of ``docs``, selected bit).

    The selected slots are a top-N list (models x N values): they go into the
    row-level pass as a literal, so only their environments leave it and only those get a fragment.
    """
    wanted = sorted({int(r[0]) for r in bits.select("feature_idx").collect()})
    envs = FP.environments(docs, radius, FP.N_BITS, with_fragments=True, id_col=id_col, fragment_bits=wanted,
                           only_bits=True)
    return FP.first_environment_per_bit(envs).select("doc_id", "bit", "radius", "pos", "fragment")


def fragment_rows(spark: SparkSession, sf_dir: str, top: DataFrame) -> DataFrame:
    """F7 on the labelled documents, named by their source."""
    docs = labelled_docs(spark, sf_dir)
    return fragment_report(docs, docs.select("doc_id", F.col("source").alias("name")), top)


def fragment_report(docs: DataFrame, names: DataFrame, top: DataFrame, radius: int = FP.RADIUS) -> DataFrame:
    """F7 + U2 + P15: per model, one row per (entity, top bit it holds) and one
    warning row for each top bit that no entity resolves (J5, A11).

    (model, name, doc_id, bit, fragment, note); ``docs`` need not be the corpus the slots come from.
    """
    slots = top.select("model", F.col("feature_idx").alias("bit"))
    first = fragments_in(docs, top, radius)
    # ``slots`` is the top-N list.  Rows are read twice below (rows and the resolved check): entities x top-N at most
    rows = first.join(F.broadcast(slots), "bit").join(names, "doc_id", "inner").select(
        "model", "name", "doc_id", "bit", "fragment",
        F.when(F.col("fragment").isNotNull(), F.lit(NOTE_RESOLVED))
        .otherwise(F.lit(NOTE_FAILED)).alias("note"))
    rows = checkpointed(rows)
    resolved = rows.groupBy("model", "bit").agg(
        F.bool_or(F.col("fragment").isNotNull()).alias("_ok"))
    missing = slots.join(resolved.filter("_ok"), ["model", "bit"], "left_anti")
    warn = missing.select(
        "model", F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("doc_id"),
        "bit", F.lit(None).cast("string").alias("fragment"), F.lit(NOTE_UNRESOLVED).alias("note"))
    return rows.unionByName(warn)


def benchmark_fragment_rows(spark: SparkSession, sf_dir: str, n: int = TOP_N) -> DataFrame:
    """The top slots of the document models looked up as single words (radius 0) of another corpus, ``benchmark``:
    slots that no word of it sets come back as warning rows."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    names = items.select("doc_id", F.concat(F.lit("item_"), F.col("doc_id").cast("string")).alias("name"))
    return fragment_report(items, names, top_bits(spark, sf_dir, n), radius=0)


def fragment_dictionary(frag_rows: DataFrame) -> DataFrame:
    """J4 dictionary: (model, slot) -> fragment of that model's LAST row (entity rows in id
    order, warning rows after them)."""
    ordered = frag_rows.withColumn("_warn", F.col("doc_id").isNull().cast("int")) \
        .withColumn("_ord", F.coalesce("doc_id", F.lit(-1)))
    return I.last_per_key(ordered, ["model", "bit"], "fragment", ["_warn", "_ord"])


# ------------------------------------------------------------------ embeddings

_FITTED: dict = {}


def embedding_models(spark: SparkSession, sf_dir: str):
    """Fit the three embedding models once per (session, table folder)."""
    key = table_version(spark, sf_dir, "embeddings")
    if key not in _FITTED:
        emb = table(spark, sf_dir, "embeddings")
        _FITTED[key] = A.class_mean_differences(
            emb, "embedding", EMB_DIM, {n: F.col("label") < t for n, t in EMB_MODELS.items()})
    return _FITTED[key]


def embedding_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, vec_id, label, embedding, phi, baseline, raw_score) for every model."""
    emb = table(spark, sf_dir, "embeddings")
    out = None
    for name, (w, mu) in embedding_models(spark, sf_dir).items():
        att = A.linear_attributions(emb, "embedding", w, mu).withColumn("model", F.lit(name))
        out = att if out is None else out.unionByName(att)
    return out


def embedding_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.long_form(embedding_attributions(spark, sf_dir), ["model", "vec_id"], "phi", "embedding")


def embedding_mean_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mean_abs(embedding_long(spark, sf_dir), ["model"])
