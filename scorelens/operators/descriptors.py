"""Scalar descriptors as aggregates over node/edge tables.

All per-entity counts and sums run in ONE ``groupBy(doc_id)`` over the node
table (partial aggregation on the map side, so a huge document costs a few
partial rows per task, not one task).  Distinct-token counts are a two-level
aggregate; pair counts and the cycle rank of the distinct-token graph are
computed inside each document's row (``graph.pair_stats``).

Stand-ins for the chemistry descriptors on text (the operators are the
general ones; only the node typing is text specific):

========================  ==============================================
mol_wt / exact_mol_wt     sum of token lengths in characters / UTF-8 bytes
log_p, mol_mr, tpsa,      additive contribution sum: sum of w(type) over
labute_asa                nodes, type = min(token length, 8), weights from
                          a node-type dimension table (input)
hbd / hba                 tokens with a digit / starting upper-case
rotatable_bonds           adjacent token pairs both longer than 3 chars
heavy_atoms               token count
ring_count                cycle rank of the distinct-token graph (C = 1)
aromatic_rings            cycle rank of the subgraph of tokens <= 4 chars
aliphatic_rings           ring_count - aromatic_rings
fraction_csp3             share of vowel-initial tokens, 0 when no tokens
class_entropy             Shannon entropy (bits) of the token counts
========================  ==============================================
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.operators.graph import PAIR_COUNTS, chain_stats
from scorelens.operators.tokens import TOKEN_SPLIT

DESCRIPTOR_COLUMNS = (
    "mol_wt", "exact_mol_wt", "log_p", "tpsa", "hbd", "hba", "rotatable_bonds",
    "ring_count", "aromatic_rings", "aliphatic_rings", "heavy_atoms", "fraction_csp3",
    "mol_mr", "labute_asa", "class_entropy",
)
WEIGHT_COLUMNS = ("log_p", "mol_mr", "tpsa", "labute_asa")
N_TYPES = 8
SLICE_TOKENS = 100_000  # tokens counted at once; a longer document is a slice of its own
SHORT_TOKEN = 4
LONG_TOKEN = 3

# Per node-type contribution weights of the text stand-in
# (type = min(token length, 8)).  Multiples of 1/8 so every sum is exact.
NODE_TYPE_WEIGHTS = [
    # type, log_p, mol_mr, tpsa, labute_asa
    (1, -0.5, 1.0, 12.0, 3.5),
    (2, -0.25, 2.5, 9.0, 5.0),
    (3, 0.125, 4.0, 6.0, 6.5),
    (4, 0.25, 5.5, 3.0, 8.0),
    (5, 0.5, 7.0, 1.5, 9.5),
    (6, 0.75, 8.5, 0.5, 11.0),
    (7, 0.875, 10.0, 0.0, 12.5),
    (8, 1.25, 12.0, 0.0, 15.0),
]


def node_type_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        NODE_TYPE_WEIGHTS, "type int, log_p double, mol_mr double, tpsa double, labute_asa double")


VOWELS = tuple("aeiou")
COUNTS = ("heavy_atoms", "s_len", "s_oct", "hbd", "hba", "s_vowel", "n_tokens_distinct")


def _by_doc(doc: np.ndarray, values: np.ndarray, n_docs: int) -> np.ndarray:
    """Whole-number sums of ``values`` per document."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    return total[at[1:]] - total[at[:-1]]


def _slices(batch: pa.RecordBatch):
    """Runs of whole rows of ``batch`` whose lists, in its second column, hold ``SLICE_TOKENS`` items together."""
    ends = batch.column(1).offsets.to_numpy().astype(np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_TOKENS, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def token_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a text: token counts, entropy, counts per node type, pair and component counts.

    Spark splits the text; an Arrow batch is worked through in slices of whole documents, at most
    ``SLICE_TOKENS`` tokens or one document long, so a task's memory does not grow with its input.  A slice is
    dictionary encoded: every token is looked at once per slice, not once per occurrence, and all
    counts are array operations over its codes.  Nothing is shuffled and one pass
    gives every descriptor input.  ``types`` lists the occurrences of node types
    1 .. N_TYPES (type = min(length, N_TYPES)).
    class_entropy = log2(n) - sum(c log2 c) / n over the counts c of lower-cased tokens.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.split(F.col(text_col), TOKEN_SPLIT).alias("tok"))
    names = [*COUNTS, "class_entropy", "types", *PAIR_COUNTS]

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            n = batch.num_rows
            coded = batch.column(1).flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(n), np.diff(batch.column(1).offsets.to_numpy()))
            words = coded.dictionary.to_pylist()
            length = np.array([len(w) for w in words], dtype=np.int64)
            low = [w.lower() for w in words]
            lower_code = {}
            lower_of = np.array([lower_code.setdefault(w, len(lower_code)) for w in low], dtype=np.int64)
            per_word = [np.ones(len(words), np.int64), length, np.array([len(w.encode()) for w in words], dtype=np.int64),
                        np.array([any("0" <= c <= "9" for c in w) for w in words], dtype=np.int64),
                        np.array([w[:1] != v[:1] if len(v) == len(w) else w[:1] != w[:1].lower() for w, v in zip(words, low)], dtype=np.int64),
                        np.array([v.startswith(VOWELS) for v in low], dtype=np.int64)]
            pairs = chain_stats(owner, lower_of[code] if len(code) else code, length[code] if len(code) else code, n,
                                LONG_TOKEN, SHORT_TOKEN)
            full = length[code] > 0 if len(code) else np.zeros(0, dtype=bool)
            code, owner = code[full], owner[full]
            sums = [_by_doc(owner, v[code], n) for v in per_word]
            width = np.int64(len(lower_code) + 1)
            slot, count = np.unique(owner * width + (lower_of[code] if len(code) else code), return_counts=True)
            doc = slot // width
            distinct = _by_doc(doc, np.ones(len(doc), np.int64), n)
            clogc = np.bincount(doc, count * np.log2(count), n)
            heavy = sums[0]
            some = np.maximum(heavy, 1)
            entropy = np.where(heavy > 0, np.log2(some) - clogc / some, 0.0)
            kind = np.minimum(length[code], N_TYPES) if len(code) else code
            types = np.bincount(owner * N_TYPES + kind - 1, minlength=n * N_TYPES)
            offsets = pa.array(np.arange(n + 1) * N_TYPES, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v) for v in (*sums, distinct)], pa.array(entropy),
                 pa.ListArray.from_arrays(offsets, pa.array(types, pa.int64())), *[pa.array(v) for v in pairs]],
                names=["doc_id", *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *[f"{c} long" for c in COUNTS], "class_entropy double", "types array<long>",
                        *[f"{c} long" for c in PAIR_COUNTS]])
    return rows.mapInArrow(run, schema)


def contributions(stats: DataFrame, weights: DataFrame, weight_cols=WEIGHT_COLUMNS) -> DataFrame:
    """Additive contributions: per document the sum over node types of occurrences times the type's weight.

    ``weights`` has one row per type; types without a row add nothing.  A document has
    at most N_TYPES rows here, whatever its length.
    """
    long = stats.select("doc_id", F.posexplode("types").alias("pos", "n")).where("n > 0")
    typed = long.join(weights, F.col("pos") + 1 == F.col("type"), "left")
    return typed.groupBy("doc_id").agg(*[F.sum(F.coalesce(F.col("n") * F.col(c), F.lit(0.0))).alias(c) for c in weight_cols])


def descriptor_table(entities: DataFrame, docs: DataFrame, weights: DataFrame,
                     id_col: str = "doc_id") -> DataFrame:
    """entities LEFT JOIN their 15 descriptors; P8 fills only descriptor nulls with 0.

    Output: entity columns, then descriptors in ``DESCRIPTOR_COLUMNS`` order (P7).
    The text is split once; what follows has one row (or N_TYPES rows) a document.

    ring_count: the distinct-token graph of a chain is connected, so its cycle rank
    is E - V + 1.  aromatic_rings: cycle rank of the subgraph of short-short pairs;
    isolated short tokens add one vertex and one component each, so only the
    vertices touched by a short pair matter.
    """
    stats = token_stats(docs).where("heavy_atoms > 0")
    ring = F.col("n_pairs") - F.col("n_tokens_distinct") + 1
    aromatic = F.col("short_pairs") - F.col("short_vertices") + F.col("short_components")
    feats = stats.withColumns({
        "mol_wt": F.col("s_len").cast("double"), "exact_mol_wt": F.col("s_oct").cast("double"), "ring_count": ring,
        "aromatic_rings": aromatic, "aliphatic_rings": ring - aromatic, "fraction_csp3": F.col("s_vowel") / F.col("heavy_atoms")})
    feats = feats.drop("types").join(contributions(stats, weights), "doc_id", "left")
    table = entities.join(feats.withColumnRenamed("doc_id", id_col), id_col, "left")
    return fill_zero(table, DESCRIPTOR_COLUMNS).select(
        *[c for c in entities.columns], *DESCRIPTOR_COLUMNS)


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """Null -> 0 on the given feature columns only (labels and names untouched)."""
    return df.na.fill(0, list(cols))
