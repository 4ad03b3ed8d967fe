"""Registered queries of the training-data operators and their DuckDB oracles.

Each query applies one operator, with production parameters, to the whole of
its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelens.llm import ann, language, toxicity
from scorelens.llm.common import documents, labels, scratch_dir
from scorelens.llm.exact_dedup import exact_dedup
from scorelens.llm.lexical import ranked_search
from scorelens.llm.licenses import license_scan, license_sql
from scorelens.llm.negatives import hard_negatives
from scorelens.llm.ngram_join import jaccard_components
from scorelens.llm.packing import pack
from scorelens.llm.piece_codec import encode_texts
from scorelens.llm.suffix_dedup import drop_repeated_bytes
from scorelens.llm.warc import page_summary, read_bundles, write_bundles
from scorelens.llm.window_dedup import drop_repeated_windows
from scorelens.sources.tables import spread


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(n: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest`` modulo ``n``: such rows are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == rest


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, labels(spark, sf_dir).where(~held_out(5, 0)))
    return (toxicity.score_toxicity(docs, model)
            .select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(~held_out(4, 2)))
    return (language.identify(docs, model)
            .select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees")


def op4_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_windows(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (jaccard_components(documents(spark, sf_dir), words=3, num=90, den=100)
            .select("doc_id", "n_shingles", "component_id"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_bytes(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC bundles in the shared folder, then described from the archives read back."""
    folder = scratch_dir(spark, "warc")
    write_bundles(_table(spark, sf_dir, "pages"), folder)
    return page_summary(read_bundles(spark, folder))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item by presence masks, over whole texts of all documents."""
    return ranked_search(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, against all rows, by vertical scan."""
    vectors = spread(_table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_toxicity": op2_toxicity,
    "op3_piece_codec": op3_piece_codec,
    "op4_window_dedup": op4_window_dedup,
    "op5_language": op5_language,
    "op6_ngram_join": op6_ngram_join,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_warc_bundles": op11_warc_bundles,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

_EXACT = """
WITH base AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
grouped AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM base GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM base JOIN grouped USING (norm)"""

_WARC = """
WITH base AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT payload, min(page_id) AS first FROM base GROUP BY payload),
digits AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1), '' ORDER BY i) AS digest
  FROM (SELECT DISTINCT hex FROM base), (SELECT unnest(range(0, 32)) AS i) GROUP BY hex)
SELECT page_id, strlen(payload) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM base JOIN firsts USING (payload) JOIN digits USING (hex)"""

_LEXICAL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lens AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS nd, sum(n)::BIGINT AS total FROM lens),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), corpus),
gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // total))) AS gain
  FROM tfs JOIN weights USING (term) JOIN lens USING (doc_id), corpus),
scores AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gains USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
found AS (
  SELECT p.*, n.other AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5"""

ORACLES = {
    "op8_exact_dedup": _EXACT,
    "op9_license_scan": license_sql(),
    "op11_warc_bundles": _WARC,
    "op12_lexical_search": _LEXICAL,
    "op13_hard_negatives": _NEGATIVES,
}
