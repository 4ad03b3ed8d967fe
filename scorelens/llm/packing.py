"""Packing: minimum bin slack over the remaining lengths of tokenised documents.

Each task tokenises its documents, cuts full windows off each one and pools the
remaining pieces by length.  For each window the longest remaining piece is
taken and a bitset subset-sum over the pooled lengths (bounded counts) finds
the multiset that fills the rest of the window closest to capacity; the counts
are traced back through the saved bitsets.  A window that the pool cannot fill
is topped up by cutting a piece, and what is left of a task's pool (less than
one window) is cut into powers of two, so nothing is padded.

No shuffle: windows are filled from the rows of one input partition, and
``sequence_id`` is the partition number and a running number in it.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Fixed values of the byte-level vocabulary: its split pattern and its special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256

_ENCODINGS: dict = {}


def encoding(ranks_path: str):
    """One byte-level BPE encoder per worker process (same ids as the vocabulary's JSON file)."""
    if ranks_path not in _ENCODINGS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[ranks_path] = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks,
                                                   special_tokens={SPECIAL: SPECIAL_ID})
    return _ENCODINGS[ranks_path]


def token_ids(enc, text: str, end_id: int) -> np.ndarray:
    if SPECIAL in text:
        ids = np.array(enc.encode(text, allowed_special="all"), dtype="<u4")
    else:
        ids = enc.encode_to_numpy(text, disallowed_special=())
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = end_id
    return out


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Multiset [(length, count)] of the pool whose sum is the largest that fits ``room``.

    ``lengths``: the distinct lengths of the pool, longest first.  One bitset per
    length; bit s says that a sum of s is reachable; the search ends once ``room`` is.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in lengths:
        if size > room:
            continue
        left, before, step = min(counts[size], room // size), reach, 1
        if left <= 0:
            continue
        while left > 0:  # binary splitting of the bounded count
            take = min(step, left)
            reach |= (reach << (take * size)) & mask
            left -= take
            step *= 2
        steps.append((size, before))
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total -= size
            used += 1
        if used:
            picked.append((size, used))
    return picked


class Pool:
    """Remaining pieces by length; yields filled windows as lists of pieces (document, start, ids)."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.tokens, self.pieces = capacity, defaultdict(list), 0, 0

    def add(self, piece: tuple) -> None:
        if len(piece[2]):
            self.by_length[len(piece[2])].append(piece)
            self.tokens += len(piece[2])
            self.pieces += 1

    def _take(self, size: int) -> tuple:
        group = self.by_length[size]
        piece = group.pop()
        if not group:
            del self.by_length[size]
        self.tokens -= size
        self.pieces -= 1
        return piece

    def windows(self, keep: int) -> Iterator[list[tuple]]:
        """Filled windows while more than ``keep`` pieces (and a full window of tokens) are pooled."""
        while self.pieces > keep and self.tokens >= self.capacity:
            sizes = sorted(self.by_length, reverse=True)
            window = [self._take(sizes[0])]
            room = self.capacity - sizes[0]
            if room:
                counts = {s: len(g) for s, g in self.by_length.items()}
                for size, used in best_fill([s for s in sizes if s in counts], counts, room):
                    for _ in range(used):
                        window.append(self._take(size))
                    room -= size * used
            while room:  # no multiset closes the window: cut the longest piece into it
                doc, start, ids = self._take(max(self.by_length))
                window.append((doc, start, ids[:room]))
                self.add((doc, start + min(room, len(ids)), ids[room:]))
                room -= min(room, len(ids))
            yield window

    def rest(self) -> Iterator[list[tuple]]:
        """The last tokens, less than one window, as sequences of power-of-two lengths."""
        pieces = [self._take(size) for size in sorted(self.by_length, reverse=True) for _ in range(len(self.by_length[size]))]
        total = sum(len(p[2]) for p in pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            window = []
            while size:
                doc, start, ids = pieces.pop(0)
                window.append((doc, start, ids[:size]))
                if len(ids) > size:
                    pieces.insert(0, (doc, start + size, ids[size:]))
                size -= min(size, len(ids))
            yield window


def pack(docs: DataFrame, ranks_path: str, capacity: int = 2048, end_id: int = 1, pool_pieces: int = 1024,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian u32), doc_tokens, sequence_id, offset.

    A document's tokens are its byte-level BPE ids and ``end_id``; null and
    empty texts are the end id alone.  Each token lies in one piece; pieces of a
    sequence are gapless from offset 0.  Null ids and repeated rows are packed
    like any other row; extra columns are ignored; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pool = encoding(ranks_path), Pool(capacity)
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        held = 0

        def emit(window):
            nonlocal number, held
            at = 0
            for (doc, total), start, ids in window:
                out.append((doc, start, len(ids), ids.tobytes(), total, number, at))
                at += len(ids)
            held += at
            number += 1

        def flush():
            nonlocal held
            held = 0
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            cols = list(zip(*out, strict=True))
            out.clear()
            types = [arrow_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        arrow_id = None
        for batch in batches:
            arrow_id = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = token_ids(enc, text.as_py() or "", end_id)
                owner = (doc.as_py(), len(ids))
                full = len(ids) - len(ids) % capacity
                for at in range(0, full, capacity):
                    emit([(owner, at, ids[at:at + capacity])])
                pool.add((owner, full, ids[full:].copy()))
                if pool.pieces >= 2 * pool_pieces:
                    for window in pool.windows(pool_pieces):
                        emit(window)
                if held >= 1 << 19:
                    yield flush()
        for window in pool.windows(0):
            emit(window)
            if held >= 1 << 19:
                yield flush()
        for window in pool.rest():
            emit(window)
        if out:
            yield flush()

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    schema = (f"id {id_type}, start long, length long, ids binary, doc_tokens long, "
              "sequence_id long, offset long")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
