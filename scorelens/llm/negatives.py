"""Hard-negative mining by a vertical scan with branch-and-bound over dimensions.

Rows are scanned in blocks stored dimension by dimension.  For an anchor the
dimensions are read in descending magnitude of the anchor's components; after
every few dimensions the least and greatest the remaining ones can add (from each
dimension's minimum and maximum in the block) bound every candidate's inner
product, and the candidate bitmap shrinks to rows that can still matter:

* positives: rows of the anchor's label whose upper bound reaches the k-th
  lower bound so far;
* negatives: rows of other labels that can lie in the window of some positive
  and, where k rows surely lie there already, can still be among its k highest.

Survivors of the last dimension have exact scores.  Anchors are the stated query
set: they go to the scan in blocks of bounded size, every row of the table
meets every block, and each task returns at most k rows per anchor and window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelens.llm.common import shuffle_partitions, stored
from scorelens.llm.lexical import best_ranked

ANCHORS_A_PASS = 1 << 14
ROWS_A_BLOCK = 1 << 14
#: Largest magnitude of a scaled component: inner products of up to 2^11 of them fit 64 bits.
LARGEST = 1 << 26


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part; v holds floor(scale * x), x as double."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                          v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    whole = F.transform("v", lambda x: F.floor(x * scale))
    fits = F.forall("w", lambda x: F.abs(x) <= LARGEST)
    checked = F.when(fits, F.col("w")).otherwise(F.raise_error(F.concat(
        F.lit("component too large for 64-bit inner products at id "), F.col("id").cast("string"))))
    return rows.select("id", "label", whole.alias("w")).select("id", "label", checked.alias("v"))


class Block:
    """Rows of one number of components, dimension by dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(vectors.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def remaining(self, anchor: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest sum the dimensions from each position of ``order`` on can add."""
        a = anchor[order]
        one, two = a * self.low[order], a * self.high[order]
        least, most = np.minimum(one, two), np.maximum(one, two)
        tail = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
        return tail(least), tail(most)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates that ``shrink(low, high)`` keeps at every step.

        ``bitmap`` marks the candidates; steps read 4, 8, 12, ... dimensions.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        least, most = self.remaining(anchor, order)
        rows = np.flatnonzero(bitmap)
        partial = np.zeros(len(rows), np.int64)
        at, step = 0, 4
        while len(rows):
            end = min(at + step, len(order))
            for d in order[at:end]:
                if anchor[d]:
                    column = self.columns[d]
                    partial += anchor[d] * (column if len(rows) == len(column) else column[rows])
            at, step = end, step + 4
            keep = shrink(partial + least[at], partial + most[at])
            if not keep.all():
                rows, partial = rows[keep], partial[keep]
            if at >= len(order):
                break
        return rows, partial


def _kth(values: np.ndarray, k: int):
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def keep_best(k: int, floor: int | None):
    """Candidates that can be among the ``k`` highest, given ``k`` known scores of at least ``floor`` elsewhere."""
    def shrink(low, high):
        least = _kth(low, k)
        bar = least if floor is None else floor if least is None else max(floor, least)
        return np.ones(len(low), dtype=bool) if bar is None else high >= bar
    return shrink


def keep_in_windows(k: int, windows: list[tuple[int, int, int | None]]):
    """Candidates that can be among the ``k`` highest scores of some window (least, greatest, floor)."""
    def shrink(low, high):
        keep = np.zeros(len(low), dtype=bool)
        for first, last, floor in windows:
            bar = first if floor is None else max(first, floor)
            sure = _kth(low[(low >= first) & (high <= last)], k)
            keep |= (high >= (bar if sure is None else max(bar, sure))) & (low <= last)
        return keep
    return shrink


def _blocks(batches, size: int):
    """Blocks of rows, one number of components each, of at most ``size`` rows."""
    for batch in batches:
        offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
        values = batch.column(2).values.to_numpy(zero_copy_only=False)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        dims = np.diff(offsets)
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            for low in range(0, len(rows), size):
                part = rows[low:low + size]
                yield int(d), Block(ids[part], labels[part], values[offsets[part][:, None] + np.arange(d)])


def _top(held: list, ids, scores, k: int) -> list:
    """The k first of (-score, id) pairs."""
    if len(scores) > k:
        keep = scores >= _kth(scores, k)
        ids, scores = ids[keep], scores[keep]
    return sorted(held + [(-int(s), int(i)) for s, i in zip(scores, ids)])[:k]


def positive_scan(anchors: list, k: int, size: int = ROWS_A_BLOCK):
    """Task function: per anchor (id, label, vector) its ``k`` first rows of the same label among the task's rows."""
    def run(batches):
        best = [[] for _ in anchors]
        for dims, block in _blocks(batches, size):
            same = {}
            for i, (a, label, vector) in enumerate(anchors):
                if len(vector) != dims:
                    continue
                if label not in same:
                    same[label] = block.labels == label
                floor = -best[i][-1][0] if len(best[i]) == k else None
                rows, scores = block.scan(vector, same[label] & (block.ids != a), keep_best(k, floor))
                if len(rows):
                    best[i] = _top(best[i], block.ids[rows], scores, k)
        rows = [(i, a[0], j, -s) for i, (a, held) in enumerate(zip(anchors, best)) for s, j in held]
        yield from _batch(rows, ["number", "anchor_id", "positive_id", "positive_score"])
    return run


def negative_scan(anchors: list, k: int, low: int, scale: int, size: int = ROWS_A_BLOCK):
    """Task function: per anchor (id, label, vector, positive scores) and distinct score, its ``k`` first negatives."""
    def run(batches):
        held = [{s: [] for s in a[3]} for a in anchors]
        for dims, block in _blocks(batches, size):
            other = {}
            for i, (_, label, vector, scores_of) in enumerate(anchors):
                if len(vector) != dims or not scores_of:
                    continue
                if label not in other:
                    other[label] = block.labels != label
                windows = [(-(-low * s // scale), s, -held[i][s][-1][0] if len(held[i][s]) == k else None) for s in scores_of]
                rows, scores = block.scan(vector, other[label], keep_in_windows(k, windows))
                for (first, last, _), s in zip(windows, scores_of):
                    fit = (scores >= first) & (scores <= last)
                    if fit.any():
                        held[i][s] = _top(held[i][s], block.ids[rows[fit]], scores[fit], k)
        rows = [(i, p, j, -s) for i, by in enumerate(held) for p, found in by.items() for s, j in found]
        yield from _batch(rows, ["number", "positive_score", "negative_id", "negative_score"])
    return run


def _batch(rows: list, names: list[str]):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def hard_negatives(vectors: DataFrame, is_anchor, k_positive: int = 5, k_negative: int = 5, low: int = 80,
                   scale: int = 100, factor: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", block_anchors: int = ANCHORS_A_PASS, block_rows: int = ROWS_A_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long but ``rank``.

    An anchor's positives are its ``k_positive`` highest other rows of the same
    label by integer inner product (ties to the smaller id); per positive come the
    ``k_negative`` highest rows of other labels with
    ``low * positive <= scale * negative <= scale * positive``.

    Rows with a null id, label or vector or a null or non-finite component take
    no part; a scaled component beyond 2^26 raises, since 64-bit products could
    overflow.  Vectors meet only vectors of the same number of components; empty
    ones score 0.  Rows that repeat an anchor's id are no positives of that
    anchor; other repeated rows count each for itself.  Anchors that differ in
    label or vector under one id are anchors of their own; wholly equal ones are one.  Other columns are ignored whatever their names.
    An empty table, or one without anchors, gives no rows.  ``is_anchor`` is a
    condition on the columns ``id`` and ``label``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, label_col, factor)
    queries = stored(rows.where(is_anchor).distinct(), "anchors")
    out, block = None, []

    def one_pass(block):
        top = rows.mapInArrow(positive_scan(block, k_positive, block_rows),
                              "number long, anchor_id long, positive_id long, positive_score long")
        order = [F.col("positive_score").desc(), F.col("positive_id")]
        found = stored(best_ranked(top, ["number"], order, k_positive, shuffle_partitions(spark)).drop("rank"), "positives")
        wanted: list[list[int]] = [[] for _ in block]
        for r in found.select("number", "positive_score").distinct().toLocalIterator():  # at most k_positive an anchor
            wanted[r.number].append(r.positive_score)
        seeking = [(*a, sorted(s for s in scores if s >= 0)) for a, scores in zip(block, wanted)]
        got = rows.mapInArrow(negative_scan(seeking, k_negative, low, scale, block_rows),
                              "number long, positive_score long, negative_id long, negative_score long")
        order = [F.col("negative_score").desc(), F.col("negative_id")]
        best = best_ranked(got, ["number", "positive_score"], order, k_negative, shuffle_partitions(spark))
        return found.join(best, ["number", "positive_score"]).select(*columns)

    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for q in queries.toLocalIterator():
        block.append((q.id, q.label, np.array(q.v, dtype=np.int64)))
        if len(block) == block_anchors:
            part = one_pass(block)
            out, block = part if out is None else out.unionByName(part), []
    if block:
        part = one_pass(block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in columns))
    return out
