"""Shared parts of the training-data operators: text chunks, words, hashes, scratch tables.

Texts arrive as Arrow batches.  ``text_chunks`` cuts a batch into runs of
whole documents of about a megabyte and exposes their UTF-8 bytes as one numpy
array plus document offsets, so tokenising and hashing are array operations
and a task's memory does not depend on the batch size (one document is the
smallest unit).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelens.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory of a fit on the driver back to the system (glibc keeps it otherwise)."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def pack_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with the column ``text`` replaced by its compressed bytes ``z``, which come last (cheaper to shuffle)."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            n = batch.num_columns - 1
            z = pa.array([squeeze(t.as_buffer()) for t in batch.column(n).cast(pa.large_binary()).fill_null(b"")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], z], names=[*others, "z"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others)
    return rows.select(*others, "text").mapInArrow(run, schema + ", z binary")


def unpacked(column) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, texts) of a column of ``pack_texts``, about a megabyte at a time."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    start, size, part = 0, 0, []
    for i in range(len(column)):
        part.append(open_(column[i].as_buffer()))
        size += len(part[-1])
        if size >= CHUNK_BYTES or i + 1 == len(column):
            yield start, i + 1, pa.array(part, pa.large_binary()).cast(pa.large_string())
            start, size, part = i + 1, 0, []


# ---------------------------------------------------------------- text chunks

def text_chunks(column, max_bytes: int = CHUNK_BYTES, max_docs: int = 1 << 15) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of whole documents; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1), i + max_docs)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) of the words ``[^\\x20\\x09-\\x0D]+`` and word offsets per document."""
    if len(data) == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


# ---------------------------------------------------------------- hashes

def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size > 8 * CHUNK_BYTES:  # a very long document: do not keep its table
            return have
        _POWERS[int(base)] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, independent of where the span lies."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * _powers(_BASE, len(data))[:len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_BASE_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring word hashes (length len(words) - k + 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[i:i + n])
    return out


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values (block prefix / suffix minima)."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    if w == 1:
        return values.copy()
    pad = -len(values) % w
    v = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
