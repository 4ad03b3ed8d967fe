"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors get one more component that brings all of them to the largest length,
queries are scaled to that length, so a large inner product is a small
Euclidean distance.  Each of ``TABLES`` tables floors ``k`` Gaussian
projections of a vector to cells of one width; a query visits its own cell and
then neighbouring cells in the order of their estimated chance to hold a near
vector (perturbations of the coordinates nearest to a cell wall come first).
Candidates of all tables are scored exactly, in double precision, on the
original vectors, and merged.  The own cells are searched first; what they find
bounds what a query still takes from the neighbouring cells, so those send few
rows however many of them it visits.

``k`` follows the number of vectors, so cells keep their size.  The number of
probes is fitted: for a bounded sample of queries the true neighbours are found
by brute force, and the smallest number of probes that finds ``recall`` of them
is taken.  Where ``MOST_PROBES`` do not find them, ``k`` falls by one and the
cells grow, down to ``k = 0``: one cell, in which blocks of queries meet blocks
of all vectors, so the search is exact.  ``fitted_hashing`` tells the recall
that the sample reached.

Equal vectors are searched once.  Since ties go to the smaller id, the smallest
``top + 1`` ids of a group of equal vectors are all that any answer can hold.
Vectors are dealt to cells of work by bucket, about ``cell_rows`` rows each; a
cell that dense buckets make larger is split, and its queries visit every part.  The
queries of a cell are split as well, by their expected number.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scorelens.llm.common import mix, stored

TABLES = 8
WIDTH = 2.0
MOST_PROBES = 512
SAMPLE_QUERIES = 100
_log = logging.getLogger(__name__)


def probe_order(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of wall slots (0: nearest wall of all 2k) by rising expected squared distance, own cell first."""
    if k == 0:
        return [()]
    walls = 2 * k

    def cost(j):  # expected squared distance of the j-th nearest wall, j from 1
        if j <= k:
            return j * (j + 1) / (4 * (k + 1) * (k + 2))
        r = walls + 1 - j
        return 1 - r / (k + 1) + r * (r + 1) / (4 * (k + 1) * (k + 2))

    c = [cost(j) for j in range(1, walls + 1)]
    out: list[tuple[int, ...]] = [()]
    agenda = [(c[0], (0,))]
    while agenda and len(out) < most:
        total, slots = heapq.heappop(agenda)
        if all(walls - 1 - s not in slots for s in slots):  # never both walls of one coordinate
            out.append(slots)
        last = slots[-1]
        if last + 1 < walls:
            heapq.heappush(agenda, (total - c[last] + c[last + 1], slots[:-1] + (last + 1,)))
            heapq.heappush(agenda, (total + c[last + 1], slots + (last + 1,)))
    return out


@dataclass
class Hashing:
    """Projections of all tables; ``length`` is the largest vector length."""

    dim: int
    k: int
    length: float
    seed: int = 17

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.width = WIDTH * self.length
        self.directions = rng.normal(size=(TABLES, self.dim + 1, self.k))
        self.shifts = rng.uniform(0, self.width, (TABLES, self.k))
        self.multipliers = rng.integers(1, 2**63, (TABLES, self.k), dtype=np.uint64) | np.uint64(1)

    def _cells(self, vecs: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        at = (vecs @ self.directions[table] + self.shifts[table]) / self.width
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def _keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        code = (cells.view(np.uint64) * self.multipliers[table]).sum(axis=-1, dtype=np.uint64)
        return mix(code + self.multipliers[table, 0] * np.uint64(2)).view(np.int64)

    def index_keys(self, vecs: np.ndarray) -> np.ndarray:
        """(vectors, TABLES) bucket keys."""
        gap = np.sqrt(np.maximum(self.length ** 2 - (vecs ** 2).sum(axis=1), 0))
        full = np.column_stack([vecs, gap])
        return np.column_stack([self._keys(self._cells(full, t)[0], t) for t in range(TABLES)])

    def probe_keys(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """(queries, TABLES, probes) bucket keys in visiting order."""
        order = probe_order(self.k, probes)
        chosen = np.zeros((len(order), 2 * self.k))
        for p, slots in enumerate(order):
            chosen[p, list(slots)] = 1
        scale = self.length / np.sqrt((queries ** 2).sum(axis=1))
        full = np.column_stack([queries * scale[:, None], np.zeros(len(queries))])
        out = np.empty((len(queries), TABLES, len(order)), dtype=np.int64)
        for t in range(TABLES):
            cell, frac = self._cells(full, t)
            walls = np.argsort(np.concatenate([frac, 1 - frac], axis=1), axis=1, kind="stable")
            step = np.zeros((len(queries), 2 * self.k, self.k))
            rows, slots = np.indices(walls.shape)
            step[rows, slots, walls % self.k] = np.where(walls < self.k, -1, 1)
            moved = cell[:, None, :] + np.rint(np.einsum("ps,qsk->qpk", chosen, step)).astype(np.int64)
            out[:, t] = self._keys(moved, t)
        return out


def _matrix(column) -> np.ndarray:
    """Arrow list column -> (rows, dim) doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_probes(hashing: Hashing, queries: np.ndarray, pairs: list[tuple[int, np.ndarray]], recall: float) -> tuple[int, float]:
    """Smallest number of probes whose buckets hold ``recall`` of the true pairs (query row, neighbour); and its recall."""
    if not pairs or hashing.k == 0:
        return 1, 1.0
    keys = hashing.probe_keys(queries, MOST_PROBES)
    near = hashing.index_keys(np.stack([v for _, v in pairs]))
    first = np.full(len(pairs), MOST_PROBES)
    for i, (q, _) in enumerate(pairs):
        hit = keys[q] == near[i][:, None]
        found = hit.any(axis=1)
        if found.any():
            first[i] = hit[found].argmax(axis=1).min()
    counts = np.cumsum(np.bincount(first, minlength=MOST_PROBES + 1)[:MOST_PROBES]) / len(pairs)
    enough = np.flatnonzero(counts >= recall)
    probes = int(enough[0]) + 1 if len(enough) else MOST_PROBES
    return probes, float(counts[min(probes, MOST_PROBES) - 1])


def _best(query: np.ndarray, rep: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` best distinct reps of each query."""
    order = np.lexsort((rep, -score, query))
    q, r = query[order], rep[order]
    pair = np.lexsort((r, q))
    again = np.zeros(len(q), dtype=bool)
    same = (q[pair][1:] == q[pair][:-1]) & (r[pair][1:] == r[pair][:-1])
    again[pair[1:][same]] = True  # lexsort is stable: the first of equal pairs has the best place
    order, q = order[~again], q[~again]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < top]


def search_cell(keys: np.ndarray, reps: np.ndarray, vecs: np.ndarray, probe_keys: list[np.ndarray], queries: np.ndarray,
                top: int, least: np.ndarray, block: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best reps of each query among the rows of its buckets that score its ``least`` or more: (query position, rep, score)."""
    order = np.argsort(keys, kind="stable")
    keys, reps, vecs = keys[order], reps[order], vecs[order]
    want = np.concatenate(probe_keys)
    who = np.repeat(np.arange(len(queries)), [len(p) for p in probe_keys])
    by = np.argsort(want, kind="stable")
    want, who = want[by], who[by]
    bounds = np.flatnonzero(np.concatenate([[True], want[1:] != want[:-1], [True]]))
    least = least.copy()
    held: list[tuple] = []
    size = 0

    def reduce():
        q, r, s = (np.concatenate([h[i] for h in held]) for i in range(3))
        pick = _best(q, r, s, top)
        q, r, s = q[pick], r[pick], s[pick]
        full = np.flatnonzero(np.bincount(q, minlength=len(queries)) == top)
        if len(full):
            worst = np.full(len(queries), np.inf)
            np.minimum.at(worst, q, s)
            least[full] = worst[full]
        held[:] = [(q, r, s)]
        return len(q)

    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        lo, hi = np.searchsorted(keys, want[a], "left"), np.searchsorted(keys, want[a], "right")
        if lo == hi:
            continue
        per = max(1, block // (hi - lo))
        for s in range(a, b, per):
            own = who[s:min(b, s + per)]
            score = queries[own] @ vecs[lo:hi].T
            i, j = np.nonzero(score >= least[own][:, None])
            held.append((own[i], reps[lo:hi][j], score[i, j]))
            size += len(i)
            if size >= block:
                size = reduce()
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    reduce()
    return held[0]


def nearest(vectors: DataFrame, queries_where, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20,
            recall: float = 0.96, cell_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, <id_col>, score): the nearest found of each row that fulfils ``queries_where``.

    ``queries_where`` is a condition on ``id_col``.  Nearness is the largest
    inner product; ties go to the smaller id; a query's own row is no candidate.
    Rows take no part whose id is null or whose vector is null, zero, holds a
    null or non-finite component, or has another length than most vectors.
    Repeated ids: each row is a candidate once per distinct vector.  Extra
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("vid").isNotNull() & v.isNotNull()
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0))
    schema = "query_id long, rank int, vid long, score double"
    sizes = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema).withColumnRenamed("vid", id_col)
    dim = sizes["d"]
    rows = rows.where(F.size(v) == dim)

    first_ids = Window.partitionBy("vec").orderBy("vid")
    reps = stored(rows.distinct().withColumn("i", F.row_number().over(first_ids)).where(F.col("i") <= top + 1)
                  .groupBy("vec").agg(F.sort_array(F.collect_list("vid")).alias("ids"))
                  .select(F.col("ids")[0].alias("rep"), "ids", "vec"), "ann-reps")
    length = F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, longest = reps.agg(F.count(F.lit(1)), F.sqrt(F.max(length))).first()
    asked = rows.withColumnRenamed("vid", id_col).where(queries_where).select(F.col(id_col).alias("query_id"), "vec").distinct()
    asked = stored(asked.join(reps.select("vec", "rep"), "vec").select("query_id", "rep"), "ann-queries")
    searched = reps.join(asked.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("q"), "vec")

    hashing, probes, reached = fitted_hashing(searched, reps, dim, longest, n, top, recall)
    _log.info("%d projections, %d probes: recall %.4f on the sample", hashing.k, probes, reached)
    n_asked = searched.count()
    found = _search(searched.withColumn("least", F.lit(float("-inf"))), reps, hashing, 0, 1, n, n_asked, top + 1, cell_rows)
    if probes > 1:
        found = stored(found, "ann-own")
        worst = found.groupBy("q").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("held")).where(F.col("held") > top)
        slack = 1e-12 * longest ** 2  # more than a product's rounding
        bounded = searched.join(worst, "q", "left").select(
            "q", "vec", F.coalesce(F.col("worst") - slack, F.lit(float("-inf"))).alias("least"))
        rest = _search(bounded, reps, hashing, 1, probes, n, n_asked, top + 1, cell_rows)
        found = found.unionByName(rest).groupBy("q", "rep").agg(F.max("score").alias("score"))

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vid")
    expanded = (found.join(reps.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vid"))
                .withColumn("i", F.row_number().over(best)).where(F.col("i") <= top + 1))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vid")
    answers = (asked.withColumnRenamed("rep", "q").join(expanded.drop("i"), "q").where("query_id != vid")
               .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top))
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vid").alias(id_col), "score")


def fitted_hashing(searched: DataFrame, reps: DataFrame, dim: int, longest: float, n: int, top: int,
                   recall: float) -> tuple[Hashing, int, float]:
    """(hashing, probes, recall reached on the sample): the finest cells from ``n`` on that find ``recall`` with MOST_PROBES."""
    matrix, pairs = _true_neighbours(searched, reps, top)
    k = int(np.clip(np.rint(np.log2(max(n, 2)) / 2 - 0.6), 2, 24))
    while True:
        hashing = Hashing(dim, k, longest)
        probes, reached = fit_probes(hashing, matrix, pairs, recall)
        if reached >= recall or k == 0:
            return hashing, probes, reached
        k -= 1


def _true_neighbours(searched: DataFrame, reps: DataFrame, top: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """A sample of at most SAMPLE_QUERIES queries and the pairs (query row, neighbour) that brute force finds."""
    some = searched.orderBy(F.xxhash64("q"), "q").limit(SAMPLE_QUERIES).collect()
    if not some:
        return np.zeros((0, 0)), []
    names = np.array([r.q for r in some])
    matrix = np.array([list(r.vec) for r in some], dtype=np.float64)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), _matrix(batch.column(1))
            score = matrix @ vecs.T
            score[names[:, None] == ids[None]] = -np.inf
            keep = np.argpartition(-score, min(top, len(ids)) - 1, axis=1)[:, :top]
            q = np.repeat(np.arange(len(names)), keep.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[keep.ravel()]), pa.array(score[q, keep.ravel()])],
                                             names=["q", "rep", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    true = (reps.select("rep", "vec").mapInArrow(brute, "q long, rep long, score double")
            .where(F.col("score") > float("-inf"))
            .withColumn("i", F.row_number().over(order)).where(F.col("i") <= top))
    pairs = [(r.q, np.array(r.vec, dtype=np.float64)) for r in true.join(reps.select("rep", "vec"), "rep").select("q", "vec").collect()]
    return matrix, pairs


def _search(searched: DataFrame, reps: DataFrame, hashing: Hashing, first: int, last: int, n: int, n_asked: int, top: int,
            cell_rows: int) -> DataFrame:
    """(q, rep, score) of the best candidates that probes [first, last) find for each (q, vec, least) and that score ``least`` or more."""
    tables = TABLES if hashing.k else 1  # one cell holds every vector once
    cells = -(-n * tables // cell_rows)
    vec_type = reps.schema["vec"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = hashing.index_keys(_matrix(batch.column(1)))[:, :tables]
            take = pa.array(np.repeat(np.arange(len(batch)), tables))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(take), batch.column(1).take(take)],
                                             names=["bucket", "rep", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each query and cell, with the buckets to visit there."""
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                who, cell, buckets = [], [], []
                for n, keys in enumerate(hashing.probe_keys(_matrix(part.column(1)), last)[:, :tables, first:].reshape(len(part), -1)):
                    keys = np.unique(keys)
                    home = keys % cells
                    order = np.argsort(home, kind="stable")
                    at, cut = np.unique(home[order], return_index=True)
                    who += [n] * len(at)
                    cell += at.tolist()
                    buckets += np.split(keys[order], cut[1:])
                take = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), part.column(0).take(take), pa.array(buckets, pa.list_(pa.int64())),
                     part.column(1).take(take), part.column(2).take(take)], names=["home", "q", "buckets", "vec", "least"])

    indexed = (reps.select("rep", "vec").mapInArrow(index, f"bucket long, rep long, vec {vec_type}")
               .withColumn("home", F.pmod("bucket", F.lit(cells))))
    split = (indexed.groupBy("home").count().where(F.col("count") > 2 * cell_rows)
             .select("home", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    # a cell is asked by the queries whose buckets fall into it: ``parts`` times the mean, at most all
    asks_of_cell = F.least(F.lit(float(n_asked)), F.lit(n_asked * tables * (last - first) / cells) * parts)
    shares = F.greatest(F.lit(1), F.ceil(asks_of_cell / cell_rows)).cast("int")

    def share(count):
        return F.explode(F.sequence(F.lit(0), count - 1))

    rows = (indexed.join(split, "home", "left").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
            .select("home", "part", share(shares).alias("share"), "bucket", "rep", "vec"))
    asks = (searched.select("q", "vec", "least")
            .mapInArrow(probe, f"home long, q long, buckets array<long>, vec {vec_type}, least double").join(split, "home", "left")
            .withColumn("share", F.pmod(F.xxhash64("q"), shares).cast("int"))
            .withColumn("part", share(parts)).drop("parts"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        q, rep, score = search_cell(
            left["bucket"].to_numpy(np.int64), left["rep"].to_numpy(np.int64), np.stack(left["vec"].to_numpy()).astype(np.float64),
            [np.asarray(b, dtype=np.int64) for b in right["buckets"]], np.stack(right["vec"].to_numpy()).astype(np.float64), top,
            right["least"].to_numpy(np.float64))
        return pd.DataFrame({"q": right["q"].to_numpy(np.int64)[q], "rep": rep, "score": score})

    found = (rows.groupBy("home", "part", "share").cogroup(asks.groupBy("home", "part", "share"))
             .applyInPandas(work, "q long, rep long, score double")
             .groupBy("q", "rep").agg(F.max("score").alias("score")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= top).drop("i")
