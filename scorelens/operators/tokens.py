"""F1 (text producer): entity string -> node and edge tables.

Nodes are the whitespace-separated tokens of a document, ``(doc_id, pos,
tok_raw, tok)`` with ``tok = lower(tok_raw)``; an edge joins each token to the
next one.  ``pos`` comes from ``posexplode`` of the split, so inner tokens are
numbered contiguously (only a leading / trailing empty piece is dropped).

Neighbourhood work (fingerprints, fragments, adjacent-pair descriptors) needs
each token's neighbours.  A document is one row, so the neighbours are in
the same row: ``doc_edges`` and ``fingerprint.environments`` work on the
split array inside the row and never shuffle tokens.  For token tables that
arrive without their document row, ``with_halo`` + ``token_edges`` give the
same edges with windows over (doc_id, chunk) partitions: the token stream is
cut into chunks of ``chunk`` positions, each chunk also gets the R tokens on
either side as a read-only halo, so no window partition holds a whole
document and the core rows get exactly the values a whole-document window
gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


TOKEN_SPLIT = r"[ \n]+"
DEFAULT_CHUNK = 4096


def token_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, tok_raw, tok): one row per non-empty token, whole text."""
    pieces = docs.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(F.split(F.col(text_col), TOKEN_SPLIT)).alias("pos", "tok_raw"),
    )
    return pieces.filter(F.col("tok_raw") != "").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "tok_raw",
        F.lower("tok_raw").alias("tok"),
    )


def with_halo(nodes: DataFrame, radius: int, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Copy each node into its own chunk (core) and, near a chunk edge, into the
    neighbouring chunk (halo).  Adds ``chunk`` and ``core``."""
    if radius >= chunk:
        raise ValueError("radius must be smaller than the chunk length")
    c = F.floor(F.col("pos") / chunk).cast("bigint")
    off = F.pmod(F.col("pos"), F.lit(chunk))
    copies = F.array(
        F.struct(c.alias("chunk"), F.lit(True).alias("core")),
        F.when((off < radius) & (c > 0), F.struct((c - 1).alias("chunk"), F.lit(False).alias("core"))),
        F.when(off >= chunk - radius, F.struct((c + 1).alias("chunk"), F.lit(False).alias("core"))),
    )
    return nodes.select("*", F.inline(F.filter(copies, lambda x: x.isNotNull())))


def chunk_window() -> Window:
    return Window.partitionBy("doc_id", "chunk").orderBy("pos")


def token_edges(nodes: DataFrame, chunk: int = DEFAULT_CHUNK,
                carry: tuple[str, ...] = ("tok",)) -> DataFrame:
    """(doc_id, src_pos, dst_pos, src_<c>, dst_<c> for c in carry): each token to the next."""
    w = chunk_window()
    halo = with_halo(nodes, 1, chunk)
    nxt = halo.select(
        "doc_id", "pos", "core", *carry,
        F.lead("pos").over(w).alias("dst_pos"),
        *[F.lead(c).over(w).alias(f"dst_{c}") for c in carry],
    )
    return nxt.filter(F.col("core") & F.col("dst_pos").isNotNull()).select(
        "doc_id", F.col("pos").alias("src_pos"), "dst_pos",
        *[F.col(c).alias(f"src_{c}") for c in carry],
        *[f"dst_{c}" for c in carry],
    )


def doc_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """F1 edges straight from the documents, without a shuffle.

    A document is one row, so token i and token i+1 are zipped inside the
    row (``arrays_zip`` of the split and its shift) and exploded; only pairs
    of two non-empty tokens are edges.  Columns: doc_id, src_pos, dst_pos,
    src_tok, dst_tok (lower case), src_len, dst_len (raw lengths).
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.split(F.col(text_col), TOKEN_SPLIT).alias("a"))
    d = d.withColumn("b", F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))))
    z = d.select("doc_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "z"))
    z = z.filter((F.col("z.a") != "") & F.col("z.b").isNotNull() & (F.col("z.b") != ""))
    return z.select(
        "doc_id", F.col("pos").cast("bigint").alias("src_pos"),
        (F.col("pos") + 1).cast("bigint").alias("dst_pos"),
        F.lower("z.a").alias("src_tok"), F.lower("z.b").alias("dst_tok"),
        F.length("z.a").alias("src_len"), F.length("z.b").alias("dst_len"))
