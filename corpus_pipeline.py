"""The corpus pipeline: drop toxic documents, exact copies and near copies, cut repeated passages, pack into sequences.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept and returns a DataFrame; all but the last return the columns of
``documents``.  Between stages the rows are written as Parquet and read again.
Empty tables pass through; null texts count as empty; rows keep their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelens.llm import toxicity
from scorelens.llm.common import documents, labels, stored
from scorelens.llm.exact_dedup import drop_exact_copies
from scorelens.llm.ngram_join import drop_near_copies
from scorelens.llm.packing import pack
from scorelens.llm.queries import held_out, vocabulary
from scorelens.llm.window_dedup import without_repeats


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on the rows that are not held out, does not call toxic."""
    model = toxicity.train(documents(spark, sf_dir), labels(spark, sf_dir).where(~held_out(5, 0)))
    return toxicity.drop_toxic(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (the largest id)."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return drop_near_copies(docs, words=5, num=80, den=100)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a window of 13 words repeats from a document with a smaller id.

    ``n_chars`` is set to the new length; texts that lose nothing stay as they are.
    """
    return without_repeats(docs, k=13).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    pieces = pack(docs, vocabulary("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxic_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", pack_stage),
]

#: A trained classifier and a tokenizer are not SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
