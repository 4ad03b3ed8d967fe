"""Ranked lexical search by presence masks.

Pass 1 reads each text once and keeps, for the terms of a block of items, the
document's length and its (term, occurrences) pairs; counts over the whole
corpus (N, L, df) come from group-bys over that table.

Pass 2 takes documents in blocks.  Per block every term has a bitmap over its
documents.  For an item the bitmaps of its terms are transposed into one
presence mask per document; documents are grouped by mask; a mask's maximum is
the sum of the greatest contributions its terms have in the block.  Distinct
masks are scored exactly by descending maximum until the next maximum is below
the item's k-th score so far, which makes the result exact.  The k best carry
over from block to block of a task and are merged in two steps over all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pyspark.sql.pandas.types import to_arrow_type

from scorelens.llm.common import ASCII_LOWER, shuffle_partitions, span_hashes, stored, text_chunks

TERMS_A_PASS = 1 << 18
BITS_A_BLOCK = 1 << 29
DOCS_A_BLOCK = 1 << 15
POSTINGS_A_BLOCK = 1 << 22
MASK_BYTES = 1 << 25

_TERM = np.ones(256, dtype=bool)  # [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]: digits, letters, all beyond ASCII
_TERM[:128] = False
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True


def term_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the terms and the number of terms before each document."""
    if len(data) == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of one text in order of first occurrence."""
    data = ASCII_LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    starts, ends, _ = term_spans(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return list(dict.fromkeys(raw[a:b] for a, b in zip(starts, ends)))


class TermTable:
    """Looks terms up by hash and compares their bytes, so unequal terms never pass for one another."""

    def __init__(self, terms: list[bytes]):
        blob = np.frombuffer(b"".join(terms), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        starts = ends - np.array([len(t) for t in terms], dtype=np.int64)
        hashes = span_hashes(blob, starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.order = hashes[order], order
        self.blob, self.starts, self.ends = blob, starts, ends
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two terms share a hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Term number of each span, -1 for others."""
        if not len(starts) or not len(self.hashes):
            return np.full(len(starts), -1, np.int64)
        h = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == h, self.order[at], -1)
        hit = np.flatnonzero(found >= 0)
        same = (self.ends - self.starts)[found[hit]] == (ends - starts)[hit]
        found[hit[~same]] = -1
        hit = hit[same]
        left = np.ones(len(hit), dtype=bool)
        lengths = (ends - starts)[hit]
        for i in range(int(lengths.max(initial=0))):  # byte by byte over all spans still that long
            live = np.flatnonzero(left & (lengths > i))
            if not len(live):
                break
            left[live] = data[starts[hit[live]] + i] == self.blob[self.starts[found[hit[live]]] + i]
        found[hit[~left]] = -1
        return found


# ---------------------------------------------------------------- pass 1

def postings(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, counts): length in terms, numbers and occurrences of the given terms in each document with a term."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        table = TermTable(terms)
        for batch in batches:
            for first, end, data, off in text_chunks(batch.column(1)):
                data = ASCII_LOWER[data]
                starts, ends, word_off = term_spans(data, off)
                found = table.find(data, starts, ends)
                size = np.diff(word_off)
                owner = np.repeat(np.arange(end - first), size)
                hit = found >= 0
                key, count = np.unique(owner[hit] * np.int64(len(terms) + 1) + found[hit], return_counts=True)
                who, term = np.divmod(key, np.int64(len(terms) + 1))
                keep = np.flatnonzero(size)
                lens = np.bincount(who, minlength=end - first)[keep]
                offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first).take(pa.array(keep)), pa.array(size[keep], pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64()))],
                    names=["doc", "n", "terms", "counts"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, f"doc {id_type.simpleString()}, n long, terms array<int>, counts array<long>")


# ---------------------------------------------------------------- pass 2

def contributions(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """w * (10^9 tf div (1000 tf + 8 m)), m = 10 + (90 n N) div L, in 64-bit integers (Python's beyond them)."""
    if len(n) and int(n.max()) * 90 * docs >= 1 << 63:
        long = np.array([90 * int(x) * docs // total for x in n], dtype=np.int64)
    else:
        long = 90 * n * docs // total
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * (100 - 90 + long)))


def term_bitmaps(term: np.ndarray, doc: np.ndarray, n_terms: int, n_docs: int) -> np.ndarray:
    """One bitmap over the documents per term (bit 7 of byte 0 is document 0); pairs are in document order."""
    width = (n_docs + 7) >> 3
    bits = np.zeros(n_terms * width, dtype=np.uint8)
    if len(term):
        key = term.astype(np.int64) * width + (doc >> 3)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bits[key[at]] = np.bitwise_or.reduceat((128 >> (doc[order] & 7)).astype(np.uint8), at)
    return bits.reshape(n_terms, width)


def presence_masks(bitmaps: np.ndarray, n_docs: int) -> np.ndarray:
    """Masks (documents x bytes): bit t of a document's mask is its bit in the t-th bitmap."""
    flags = np.unpackbits(bitmaps, axis=1, count=n_docs)
    return np.ascontiguousarray(np.packbits(flags, axis=0, bitorder="little").T)


def mask_maxima(masks: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Sum of ``best`` over the set bits of each mask: one table lookup a byte."""
    out = np.zeros(len(masks), np.int64)
    flags = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    for i in range(masks.shape[1]):
        part = best[8 * i:8 * i + 8]
        out += (flags[:, :len(part)] @ part)[masks[:, i]]
    return out


def grouped_masks(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct mask, group number of each row)."""
    width = masks.shape[1]
    words = np.zeros((len(masks), -(-width // 8) * 8), dtype=np.uint8)
    words[:, :width] = masks
    words = words.view(np.uint64)
    group = np.zeros(len(masks), np.int64)
    for i in range(words.shape[1]):  # refine by one 64-term word at a time
        _, part = np.unique(words[:, i], return_inverse=True)
        _, group = np.unique(group * np.int64(part.max(initial=0) + 1) + part, return_inverse=True)
    first = np.full(int(group.max(initial=-1)) + 1, 0, np.int64)
    first[group[::-1]] = np.arange(len(masks))[::-1]
    return first, group


class TopLists:
    """The k best (score, document) of every item seen so far; ties go to the smaller document, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.lists = k, [[] for _ in range(items)]

    def floor(self, item: int) -> int:
        have = self.lists[item]
        return -have[-1][0] if len(have) == self.k else 0

    def merge(self, item: int, scores: np.ndarray, docs: list) -> None:
        new = [(-int(s), d is None, d) for s, d in zip(scores, docs) if s > 0]
        self.lists[item] = sorted(self.lists[item] + new, key=lambda r: (r[0], r[1], 0 if r[2] is None else r[2]))[:self.k]


def search_block(block: dict, items: list[np.ndarray], top: TopLists) -> tuple[int, int]:
    """Raise ``top`` by one block of documents; (masks met, masks scored)."""
    n_docs, term, gain = block["docs"], block["term"], block["gain"]
    owner = np.repeat(np.arange(n_docs), np.diff(block["off"]))
    present, local = np.unique(term, return_inverse=True)
    best = np.zeros(len(present), np.int64)
    np.maximum.at(best, local, gain)
    bitmaps = term_bitmaps(local, owner, len(present), n_docs)
    member = np.zeros(len(present), dtype=bool)
    met = scored = 0
    for item, wanted in enumerate(items):
        at = np.searchsorted(present, wanted)
        mine = at[(at < len(present)) & (present[np.minimum(at, len(present) - 1)] == wanted)] if len(present) else at[:0]
        if not len(mine):
            continue
        member[mine] = True
        step = max(8, MASK_BYTES // len(mine) & ~7)
        for low in range(0, n_docs, step):  # very long items: fewer documents at a time
            high = min(low + step, n_docs)
            masks = presence_masks(bitmaps[mine, low >> 3:(high + 7) >> 3], high - low)
            first, group = grouped_masks(masks)
            most = mask_maxima(masks[first], best[mine])
            met += len(first)
            members = np.argsort(group, kind="stable")
            bounds = np.searchsorted(group[members], np.arange(len(first) + 1))
            queue = np.argsort(-most, kind="stable")
            size = np.cumsum(np.diff(bounds)[queue])
            done, want = 0, 4 * top.k
            while done < len(queue):
                floor = top.floor(item)
                if most[queue[done]] <= 0 or most[queue[done]] < floor:
                    break  # no document of this or any later mask can enter the list
                stop = max(done + 1, int(np.searchsorted(size, (size[done - 1] if done else 0) + want, side="right")))
                while most[queue[stop - 1]] < floor:
                    stop -= 1
                rows = low + np.concatenate([members[bounds[g]:bounds[g + 1]] for g in queue[done:stop]])
                scores = _scores(rows, block["off"], local, gain, member)
                _offer(top, item, scores, rows, block["ids"])
                done, want = stop, 2 * want
            scored += done
        member[mine] = False
    return met, scored


def _scores(rows, off, local, gain, member) -> np.ndarray:
    lens = off[rows + 1] - off[rows]
    ends = np.cumsum(lens)
    flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(off[rows] - (ends - lens), lens)
    parts = np.concatenate([[0], np.cumsum(np.where(member[local[flat]], gain[flat], 0))])
    return parts[ends] - parts[ends - lens]


def _offer(top: TopLists, item: int, scores: np.ndarray, rows: np.ndarray, ids: pa.Array) -> None:
    if len(scores) > top.k:  # keep ties of the k-th score: the smaller document wins them
        least = np.partition(scores, len(scores) - top.k)[len(scores) - top.k]
        keep = scores >= max(int(least), top.floor(item))
        scores, rows = scores[keep], rows[keep]
    top.merge(item, scores, ids.take(pa.array(rows)).to_pylist())


def _blocks(batches, weight, docs, total, max_docs):
    """Runs of documents as arrays, bounded in documents and postings."""
    for batch in batches:
        at = 0
        counts = batch.column(2)
        off = counts.offsets.to_numpy().astype(np.int64)
        while at < batch.num_rows:
            end = min(at + max_docs, int(np.searchsorted(off, off[at] + POSTINGS_A_BLOCK, side="right")) - 1)
            end = min(max(end, at + 1), batch.num_rows)
            part = slice(off[at], off[end])
            term = counts.values.to_numpy(zero_copy_only=False)[part].astype(np.int64)
            tf = batch.column(3).values.to_numpy(zero_copy_only=False)[part]
            local = off[at:end + 1] - off[at]
            n = np.repeat(batch.column(1).slice(at, end - at).to_numpy(zero_copy_only=False), np.diff(local))
            yield {"docs": end - at, "ids": batch.column(0).slice(at, end - at), "off": local, "term": term,
                   "gain": contributions(weight[term], tf, n, docs, total)}
            at = end


def best_ranked(rows: DataFrame, keys: list[str], order: list, k: int, salts: int) -> DataFrame:
    """The k first rows per key with their ``rank``: per (key, salt) first, so no key's rows meet in one task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    for extra in (["_salt"], []):
        salted = (salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, *extra).orderBy(*order)))
                  .where(F.col("rank") <= k))
    return salted.drop("_salt")


def item_blocks(items: DataFrame, item_col: str, text_col: str, max_terms: int):
    """Blocks of (first item number, item ids, term lists) with at most ``max_terms`` distinct terms (one item at least)."""
    ids, lists, seen, first, number = [], [], set(), 0, 0
    for row in items.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).toLocalIterator():
        terms = terms_of(row.text)
        if lists and len(seen.union(terms)) > max_terms:
            yield first, ids, lists
            ids, lists, seen, first = [], [], set(), number
        ids.append(row.id)
        lists.append(terms)
        seen.update(terms)
        number += 1
    if lists:
        yield first, ids, lists


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", max_terms: int = TERMS_A_PASS,
                  block_docs: int = DOCS_A_BLOCK) -> DataFrame:
    """(item, rank, document, score): each item's ``k`` highest-scoring documents with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lower-cased; null texts have none.  Statistics cover every
    document with a term.  Equal scores go to the smaller id, a null id last;
    repeated documents and repeated items count each for itself.  Other columns
    are ignored whatever their names.  Empty tables and items without known
    terms give no rows.  Items are taken in blocks of at most ``max_terms``
    distinct terms (one item at least); each block is one pass over the texts,
    its dictionary is all that is sent to the tasks.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()
    out = None
    for first, ids, lists in item_blocks(items, item_col, item_text_col, max_terms):
        terms = sorted({t for one in lists for t in one})
        if not terms:
            continue
        found = _search(docs, terms, first, lists, k, id_col, text_col, id_type, block_docs)
        names = spark.createDataFrame([(first + i, v) for i, v in enumerate(ids)], f"number long, item {item_type}")
        found = found.join(F.broadcast(names), "number")  # a block's items: bounded by max_terms
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{item_col} {item_type}, rank int, {id_col} {id_type}, score long")
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _search(docs, terms, first, lists, k, id_col, text_col, id_type, block_docs) -> DataFrame:
    spark = docs.sparkSession
    table = stored(postings(docs, terms, id_col, text_col), "postings")
    n_docs, total = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(terms), np.int64)
    for row in table.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[row.t] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(c) + 1))) for c in df], dtype=np.int64)
    number = {t: i for i, t in enumerate(terms)}
    wanted = [np.array(sorted(number[t] for t in one), dtype=np.int64) for one in lists]
    max_docs = min(block_docs, max(8, BITS_A_BLOCK // len(terms)))
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches):
        top = TopLists(len(wanted), k)
        for block in _blocks(batches, weight, n_docs, total, max_docs):
            search_block(block, wanted, top)
        rows = [(first + i, d, -s) for i, one in enumerate(top.lists) for s, _, d in one]
        if rows:
            numbers, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, kind), pa.array(scores, pa.int64())],
                                             names=["number", "doc", "score"])

    hits = table.select("doc", "n", "terms", "counts").mapInArrow(run, f"number long, doc {id_type}, score long")
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    return best_ranked(hits, ["number"], order, k, shuffle_partitions(spark))
