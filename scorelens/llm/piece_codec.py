"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is an agenda: every adjacent pair of symbols whose concatenation is a
piece is queued under its score; the best pair (leftmost on ties) is merged and
its new neighbours are queued.  No piece of the supported vocabularies crosses
from a non-space into a space, and a character that occurs in no longer piece
never merges, so a text is cut there and equal cuts share one agenda run
(a bounded table per task).

Checks against the library, batch by batch: each newly segmented cut is
encoded by the library too, and each text must come back from the library's
decode; where it does not (a literal word-boundary mark, say), the library
encodes the whole text and its ids stand.  ``agrees`` tells.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
CACHE_CUTS = 250_000
LONGEST_CACHED = 48


class PieceEncoder:
    """Agenda encoder over the pieces of one model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib, self.rank, self.packed, longer = self.lib, {}, {}, set()
        for i in range(lib.get_piece_size()):
            if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i):
                continue
            if lib.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            piece = lib.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("vocabularies with pieces over a word boundary are not supported")
            self.rank[piece] = -lib.get_score(i)
            self.packed[piece] = i.to_bytes(4, "little")
            if len(piece) > 1:
                longer.update(piece)
        unk = lib.unk_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if unk in self.bytes:
            raise ValueError("the vocabulary has no byte fallback")
        self.bytes = [i.to_bytes(4, "little") for i in self.bytes]
        self.bos, self.eos = lib.bos_id().to_bytes(4, "little"), lib.eos_id().to_bytes(4, "little")
        lone = "" if "\n" in longer else "\n"
        self.cuts = re.compile(rf" +[^ {lone}]*|[^ {lone}]+" + (rf"|{lone}" if lone else "")).findall
        self.cache: dict[str, bytes] = {}

    def segment(self, cut: str) -> bytes:
        """Packed little-endian ids of one cut (spaces already marks)."""
        sym: list = list(cut)
        n = len(sym)
        if n > 1:
            rank, left, right, agenda = self.rank, list(range(-1, n - 1)), list(range(1, n + 1)), []
            for i in range(n - 1):
                pair = sym[i] + sym[i + 1]
                r = rank.get(pair)
                if r is not None:
                    agenda.append((r, i, pair))
            heapq.heapify(agenda)
            while agenda:
                _, i, pair = heapq.heappop(agenda)
                a = sym[i]
                if a is None:
                    continue
                j = right[i]
                if j >= n or a + sym[j] != pair:
                    continue
                sym[i], sym[j] = pair, None
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    new = pair + sym[k]
                    r = rank.get(new)
                    if r is not None:
                        heapq.heappush(agenda, (r, i, new))
                h = left[i]
                if h >= 0:
                    new = sym[h] + pair
                    r = rank.get(new)
                    if r is not None:
                        heapq.heappush(agenda, (r, h, new))
        packed, out = self.packed, []
        for s in sym:
            if s is not None:
                got = packed.get(s)
                out.append(got if got is not None else b"".join(self.bytes[b] for b in s.encode()))
        return b"".join(out)

    def batch(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """(ids with begin and end, decoded text, agrees) of each text."""
        cut_lists, missing = [], {}
        cache = self.cache
        if len(cache) > CACHE_CUTS:
            cache.clear()
        for t in texts:
            cuts = self.cuts(" " + t.replace(SPACE, " ")) if t else []
            cut_lists.append(cuts)
            missing.update(dict.fromkeys(c for c in cuts if c not in cache))
        for c in missing:
            missing[c] = self.segment(c.replace(" ", SPACE))
        bad = self._unconfirmed(missing)
        ids_of = [self.bos + b"".join([cache[c] if c in cache else missing[c] for c in cuts]) + self.eos
                  for cuts in cut_lists]
        doubts = [bool(bad) and any(c in bad for c in cuts) for cuts in cut_lists]
        for c, ids in missing.items():
            if len(c) <= LONGEST_CACHED and c not in bad:
                cache[c] = ids
        decoded = self.lib.decode([np.frombuffer(ids, "<u4").tolist() for ids in ids_of]) if texts else []
        result = []
        for t, ids, doubt, back in zip(texts, ids_of, doubts, decoded, strict=True):
            agrees = True
            if back != t or doubt:
                lib = np.array(self.lib.encode(t, add_bos=True, add_eos=True), "<u4")
                agrees = lib.tobytes() == ids
                if not agrees:
                    ids, back = lib.tobytes(), self.lib.decode(lib.tolist())
            result.append((ids, back, agrees))
        return result

    def _unconfirmed(self, found: dict[str, bytes]) -> set[str]:
        """The new cuts starting a word for which the library gives other ids."""
        words = [c for c in found if c[0] == " " and len(c) > 1]
        theirs = self.lib.encode([c[1:] for c in words], num_threads=1) if words else []
        return {c for c, ids in zip(words, theirs, strict=True) if np.array(ids, "<u4").tobytes() != found[c]}


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model_path: str) -> PieceEncoder:
    """One encoder per worker process and model file."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = PieceEncoder(model_path)
    return _ENCODERS[model_path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 batch_chars: int = 1_000_000) -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit, with begin and end), decoded, agrees.

    One output row per input row, in no order; null text is empty; a null id
    stays null; repeated rows repeat; extra columns are ignored.  Whole texts
    are encoded; a batch holds about ``batch_chars`` characters or one text.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, size, part = 0, 0, []
            for i in range(len(texts)):
                part.append(texts[i].as_py() or "")
                size += len(part[-1])
                if size >= batch_chars or i + 1 == len(texts):
                    got = enc.batch(part)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, len(part)), pa.array([g[0] for g in got], pa.binary()),
                         pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.bool_())],
                        names=["id", "ids", "decoded", "agrees"])
                    start, size, part = i + 1, 0, []

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return (rows.mapInArrow(run, f"id {id_type}, ids binary, decoded string, agrees boolean")
            .withColumnRenamed("id", id_col))
