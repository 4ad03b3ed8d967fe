"""Circular neighbourhood fingerprints on token chains.

Morgan / Weisfeiler-Lehman refinement on the token graph:

* radius 0 identifier of a node: first 8 hex digits of md5(token)
* radius r identifier: md5 prefix of "<left id> <own id> <right id>" at r-1,
  with '' past either end of the document
* slot (bit) of an identifier: its value mod ``n_bits``; a document's
  fingerprint is the set of slots of all its identifiers at radius 0..R
  (presence, not count).

Identifiers are compressed to a fixed width at every round (as Morgan
does), so labels never grow with the radius.  A document is one row, so all
rounds run in its own task: an Arrow batch is worked through in slices of whole
documents, and every step is an array operation over the tokens of a slice.  The
slots of a document are kept as bit masks, so what is shuffled is a few words a
document, not its identifiers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.arrays import md5_word, slices, words_of
N_BITS = 1024
RADIUS = 3
SLICE_BYTES = 1 << 19  # text worked on at once; a longer document is a slice of its own
MASK_BITS = 32  # slots kept in one mask

HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def _next_round(ident: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Identifiers of radius r from those of radius r - 1; ``first`` and ``last`` mark the ends of documents."""
    n = len(ident)
    digits = HEX[ident.astype(">u4").view(np.uint8)].reshape(n, 8)
    out = np.empty(n, np.uint32)
    for no_left in (False, True):
        for no_right in (False, True):
            at = np.flatnonzero((first == no_left) & (last == no_right))
            if len(at):
                blank = np.full((len(at), 1), 32, np.uint8)
                out[at] = md5_word(np.hstack([*([] if no_left else [digits[at - 1]]), blank, digits[at], blank,
                                              *([] if no_right else [digits[at + 1]])]))
    return out


def _slice_environments(text: np.ndarray, starts: np.ndarray, radius: int, with_fragments: bool):
    """Yield (radius, document, pos, identifier, fragment(at) or None) over the tokens of some documents.

    ``text`` is the documents' lower-cased bytes, end to end; document d begins at ``starts[d]``.
    """
    begin, end, doc, pos = words_of(text, starts)
    n = len(begin)
    if not n:
        return
    size = end - begin
    inside = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    letters = text[inside]
    offsets = np.concatenate([[0], np.cumsum(size)])
    words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    known = np.array([int.from_bytes(hashlib.md5(w).digest()[:4], "big") for w in coded.dictionary.to_pylist()], np.uint32)
    ident = known[coded.indices.to_numpy(zero_copy_only=False)]
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    last = np.concatenate([first[1:], [True]])
    if with_fragments:  # the tokens of all documents, one blank after each
        line = np.full(len(letters) + n, 32, np.uint8)
        line[np.arange(len(letters)) + np.repeat(np.arange(n), size)] = letters
        here = offsets[:-1] + np.arange(n)
        low, high = np.flatnonzero(first)[np.cumsum(first) - 1], np.flatnonzero(last)[np.cumsum(first) - 1]
    for r in range(radius + 1):
        if r:
            ident = _next_round(ident, first, last)

        def fragment(at, r=r):
            a = here[np.maximum(at - r, low[at])]
            to = np.minimum(at + r, high[at])
            length = here[to] + size[to] - a
            stop = np.cumsum(length)
            data = line[np.repeat(a - stop + length, length) + np.arange(length.sum())]
            return pa.Array.from_buffers(pa.large_binary(), len(at),
                                         [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int64)), pa.py_buffer(data)])

        yield r, doc, pos, ident, fragment if with_fragments else None


def environments(docs: DataFrame, radius: int = RADIUS, n_bits: int = N_BITS,
                 with_fragments: bool = False, id_col: str = "doc_id",
                 text_col: str = "text", fragment_bits: list[int] | None = None,
                 only_bits: bool = False, masks: bool = False) -> DataFrame:
    """(doc_id, pos, radius, ident, bit[, fragment]) for every token and radius 0..R.

    Input: one row per document (id, text).  A document is one row, so every
    neighbour of a token is in the same row: no shuffle, no sort, no window.
    ``pos`` is the index in the raw whitespace split (as ``tokens.token_nodes``).

    ``fragment`` is the text the identifier covers: tokens pos-r .. pos+r,
    clipped at the document ends.  It is only computed when asked for,
    and with ``fragment_bits`` (a short list, e.g. a top-N) only for the
    environments whose slot is in the list -- inside the task, so selecting
    fragments never moves document text.  With ``only_bits`` the environments of
    other slots are left out.

    With ``masks`` the environments leave the task as the slots they set, (doc_id, word, mask):
    bit i of a mask is slot ``word * MASK_BITS + i``.  ``fingerprint_bits`` takes either form.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).cast("binary").alias("text"))
    chosen = None if fragment_bits is None else np.array(sorted({int(b) for b in fragment_bits}), np.int64)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, starts, text in slices(batch.column(1), SLICE_BYTES):
                for r, doc, pos, ident, fragment in _slice_environments(text, starts, radius, with_fragments):
                    at = np.arange(len(pos))
                    wanted = None if chosen is None else np.isin(ident.astype(np.int64) % n_bits, chosen)
                    if wanted is not None and only_bits:
                        at, wanted = at[wanted], None
                    columns = [ids.take(pa.array(doc[at] + lo)), pa.array(pos[at]), pa.array(np.full(len(at), r, np.int32)),
                               pa.array(ident[at].astype(np.int64))]
                    if with_fragments and wanted is None:
                        columns.append(fragment(at).cast(pa.binary()))
                    elif with_fragments:
                        slot = np.cumsum(wanted) - 1
                        columns.append(fragment(at[wanted]).cast(pa.binary()).take(pa.array(slot, mask=~wanted)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    def run_masks(batches):
        words = -(-n_bits // MASK_BITS)
        for batch in batches:
            ids = batch.column(0)
            for lo, starts, text in slices(batch.column(1), SLICE_BYTES):
                held = np.zeros((len(starts) - 1, words * MASK_BITS), bool)
                for _, doc, _, ident, _ in _slice_environments(text, starts, radius, False):
                    held[doc, ident % np.uint32(n_bits)] = True
                mask = np.packbits(held, axis=1, bitorder="little").view("<u4")
                at, word = np.nonzero(mask)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at + lo)), pa.array(word), pa.array(mask[at, word].astype(np.int64))], names=["doc_id", "word", "mask"])

    names = ["doc_id", "pos", "radius", "key", *(["fragment"] if with_fragments else [])]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    if masks:
        return rows.mapInArrow(run_masks, f"doc_id {id_type}, word long, mask long")
    out = rows.mapInArrow(run, f"doc_id {id_type}, pos long, radius int, key long" + (", fragment binary" if with_fragments else ""))
    ident = F.lower(F.lpad(F.hex("key"), 8, "0"))
    return out.select("doc_id", "pos", "radius", ident.alias("ident"),
                      *([F.col("fragment").cast("string").alias("fragment")] if with_fragments else []),
                      F.pmod("key", F.lit(n_bits)).cast("bigint").alias("bit"))


def fingerprint_bits(envs: DataFrame) -> DataFrame:
    """distinct (doc_id, bit).

    The slots of a document are or-ed into masks of ``MASK_BITS`` slots on the map side (or in the task that
    made them, ``environments(masks=True)``), so a document sends its masks, not its environments; they come
    together by ``doc_id`` before they are spelled out, so a join on ``doc_id`` needs no other shuffle of the slots.
    """
    if "mask" in envs.columns:  # at most n_bits / MASK_BITS rows a document: one shuffle, by document
        masks = envs.repartition("doc_id").groupBy("doc_id", "word").agg(F.bit_or("mask").alias("mask"))
    else:
        masks = _slot_masks(envs).groupBy("doc_id").agg(F.collect_list(F.struct("word", "mask")).alias("m")).select(
            "doc_id", F.inline("m"))
    return masks.select("doc_id", "word", F.explode(_mask_slots(F.col("mask"))).alias("i")).select(
        "doc_id", (F.col("word") * MASK_BITS + F.col("i")).cast("bigint").alias("bit"))


def _slot_masks(bits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, word, mask) from rows with a slot ``bit`` each."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(MASK_BITS)).cast("int"))
    return bits.groupBy(id_col, F.floor(F.col("bit") / MASK_BITS).alias("word")).agg(F.bit_or(one).alias("mask"))


def _mask_slots(mask):
    """The places set in a mask, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(MASK_BITS - 1)), lambda i: mask.bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0)


def fingerprint_table(entities: DataFrame, bits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """entities LEFT JOIN their sorted bit set (empty when nothing parsed).

    Slots are gathered as masks, a few words an entity, so no list of single slots is sorted.
    """
    words = _slot_masks(bits.where("bit IS NOT NULL")).groupBy(F.col("doc_id").alias(id_col)).agg(
        F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("m"))
    sets = words.select(id_col, F.flatten(F.transform("m", lambda m: F.transform(
        _mask_slots(m["mask"]), lambda i: (m["word"] * MASK_BITS + i).cast("bigint")))).alias("bits"))
    return entities.join(sets, id_col, "left").withColumn(
        "bits", F.coalesce(F.col("bits"), F.array().cast("array<bigint>")))


def bits_to_vector(df: DataFrame, bits_col: str = "bits", out_col: str = "ecfp",
                   n_bits: int = N_BITS) -> DataFrame:
    """Sorted bit set -> SparseVector(n_bits) with 1.0 in every set slot.

    A count vectorizer whose vocabulary is "0".."n_bits-1" in order maps each
    slot to itself, so the conversion runs inside the JVM (no Python UDF) and
    stays sparse.  The vocabulary is built from ``n_bits``, not from the data.
    """
    from pyspark.ml.feature import CountVectorizerModel

    vocab = [str(i) for i in range(n_bits)]
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol="_bit_terms", outputCol=out_col,
                                              binary=True)
    terms = df.withColumn("_bit_terms", F.transform(bits_col, lambda b: b.cast("string")))
    return cv.transform(terms).drop("_bit_terms")


def first_environment_per_bit(envs: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """for each (doc, bit) the FIRST (radius, pos) that set it, with its fragment.

    ``bits`` (optional, one column ``bit``) restricts to selected slots by a
    semi join; it is a top-N list, so it is broadcast (size = N).
    """
    src = envs
    if bits is not None:
        src = envs.join(F.broadcast(bits.select("bit").distinct()), "bit", "left_semi")
    # min over a struct orders by radius, then pos: an aggregate, so a hot
    # (doc, bit) key is combined on the map side instead of sorted in one task
    first = src.groupBy("doc_id", "bit").agg(
        F.min(F.struct("radius", "pos", *[c for c in ("fragment",) if c in src.columns])).alias("_f"))
    return first.select("doc_id", "bit", "_f.*")


def bit_collisions(envs: DataFrame) -> DataFrame:
    """slots that hold more than one distinct fragment, with the count.

    Fragments are told apart by their 128-bit MD5, made in the row, so 16 bytes a
    fragment are shuffled whatever its length.
    """
    return (
        envs.where("fragment IS NOT NULL").select("bit", F.unhex(F.md5(F.col("fragment"))).alias("digest")).distinct()
        .groupBy("bit").agg(F.count(F.lit(1)).alias("n_fragments"))
        .filter(F.col("n_fragments") > 1)
    )
