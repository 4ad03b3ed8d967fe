"""Minimiser runs and the search for minimisers that occur more than once.

A window of ``k`` symbols is represented by the m-mer in it with the smallest
hash, leftmost on ties; consecutive windows with the same m-mer occurrence form
a run.  Equal windows have equal minimisers, so only runs whose minimiser
occurs again can hold a repeated window.

``repeated`` finds those: runs are dealt to buckets by minimiser, packed as
arrays; their number follows the bytes of text.  A minimiser that a task already sees twice sends one mark instead of
all its rows, so a passage in a third of all documents costs its bucket one
mark for each megabyte of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelens.llm.common import shuffle_partitions, sliding_min, text_chunks

_LOW = np.uint64(0xFFFFFF)
BUCKET_TEXT = 128 << 20  # a run takes 12 bytes and comes every 4 to 5 words, so a bucket holds some 60 MB


@dataclass
class Runs:
    doc: np.ndarray      # document of the chunk
    start: np.ndarray    # first window, as a symbol number in the chunk
    count: np.ndarray    # windows
    mer: np.ndarray      # hash of the minimiser


def window_runs(mers: np.ndarray, off: np.ndarray, k: int, m: int) -> Runs:
    """Runs of the windows of ``k`` symbols; ``mers``: m-mer hashes by start; ``off``: symbol offsets of documents."""
    n = int(off[-1]) - k + 1
    if n <= 0:
        zero = np.zeros(0, np.int64)
        return Runs(zero, zero, zero, zero.view(np.uint64))
    place = np.arange(len(mers), dtype=np.uint64) & _LOW
    least = sliding_min((mers & ~_LOW) | place, k - m + 1)[:n]
    at = np.arange(n) + ((least & _LOW).astype(np.int64) - np.arange(n)) % (1 << 24)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = np.arange(n) + k <= off[1:][owner]
    new = np.ones(n, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    new &= inside
    ends = np.ones(n, dtype=bool)
    ends[:-1] = new[1:] | ~inside[1:]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(ends & inside) + 1
    return Runs(owner[start], start, stop - start, mers[at[start]])


def codes(mer: np.ndarray, buckets: int) -> np.ndarray:
    """Minimiser code: bucket and 32 bits of the hash."""
    return ((mer >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | (mer & np.uint64(0xFFFFFFFF))).view(np.int64)


def bucket_count(text_bytes: int, least: int) -> int:
    """Buckets of about BUCKET_TEXT bytes of text each (one bucket is one pandas group), ``least`` or more."""
    return max(least, -(-text_bytes // BUCKET_TEXT))


def repeated(rows: DataFrame, find: Callable[[np.ndarray, np.ndarray], Runs], within: bool) -> tuple[DataFrame, int]:
    """(key, codes): the minimisers of each row that occur again, and the number of buckets.

    ``rows``: (key long, text).  ``within``: an occurrence in the same row counts as another.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(int(total), shuffle_partitions(rows.sparkSession))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, j, data, off in text_chunks(batch.column(1)):
                runs = find(data, off)
                if not len(runs.doc):
                    continue
                code, key = codes(runs.mer, buckets), keys[i:j][runs.doc]
                order = np.lexsort((key, code))
                code, key = code[order], key[order]
                if not within:
                    new = np.ones(len(code), dtype=bool)
                    new[1:] = (code[1:] != code[:-1]) | (key[1:] != key[:-1])
                    code, key = code[new], key[new]
                first = np.ones(len(code), dtype=bool)
                first[1:] = code[1:] != code[:-1]
                size = np.diff(np.append(np.flatnonzero(first), len(code)))
                several = np.repeat(size > 1, size)
                send = first | ~several
                b, h, k, s = code[send] >> 32, code[send], key[send], several[send]
                cut = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
                out = [(int(b[x]), h[x:y].astype(np.uint32).tobytes(), k[x:y].tobytes(), np.packbits(s[x:y]).tobytes())
                       for x, y in zip(cut[:-1], cut[1:], strict=True)]
                turn = (turn * 31 + int(key[0])) % buckets
                if several.any():  # known here: they go on as they are, spread over all buckets
                    out.append((buckets + turn, code[several].tobytes(), key[several].tobytes(), b""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[c] for o in out], pa.binary()) for c in (1, 2, 3)]],
                    names=["bucket", "h", "k", "s"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        key = np.frombuffer(b"".join(pdf["k"]), np.int64)
        if bucket >= buckets:
            return pd.DataFrame({"key": key, "code": np.frombuffer(b"".join(pdf["h"]), np.int64)}).drop_duplicates()
        h = np.frombuffer(b"".join(pdf["h"]), np.uint32)
        mark = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(k) // 8)
                               for s, k in zip(pdf["s"], pdf["k"], strict=True)]).astype(bool)
        order = np.lexsort((key, h))
        h, key, mark = h[order], key[order], mark[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        other = np.zeros(len(h), dtype=bool)
        other[1:] = (h[1:] == h[:-1]) & (within | (key[1:] != key[:-1]))
        again = np.repeat(np.logical_or.reduceat(other | mark, start), size)
        tell = again & ~mark
        return pd.DataFrame({"key": key[tell], "code": (np.int64(bucket) << 32) | h[tell].astype(np.int64)}).drop_duplicates()

    found = (rows.mapInArrow(deal, "bucket int, h binary, k binary, s binary")
             .groupBy("bucket").applyInPandas(settle, "key long, code long"))
    return found.groupBy("key").agg(F.collect_set("code").alias("codes")), buckets
