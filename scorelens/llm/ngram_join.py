"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence.

1. Sets.  A document's set holds the 64-bit hashes of its distinct word
   shingles; equal sets (128-bit digest and size) are joined once.
2. Blocks.  Two linked sets differ in few shingles, a number bounded by their
   sizes.  The hash space is cut into more segments than that, so linked sets
   agree on a whole segment; segment signatures are shuffled, sets that share
   one are candidates, and the components of the candidates are the blocks.
   Every linked pair lies inside a block.  A set leaves out its thinnest
   segments, as long as it has segments to spare: of two linked sets, the one
   that asks for fuller segments still has one of these in common with the other.
3. Product.  In each block the rows of the incidence matrix are multiplied with
   its transpose: overlaps are accumulated over the n-grams in order of rising
   frequency, rows that share none of the rarest n-grams that the size bound
   leaves are skipped, pairs below the bound are discarded.  Rows already
   reached are not multiplied again, so a group of copies costs one row each.
   A block above ``cell_shingles`` is cut into chunks and every two chunks are
   a cell of work.
4. The links (a spanning forest of each cell) are contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelens.llm.common import (ASCII_LOWER, as_long, mix, pack_texts, shingle_hashes, shuffle_partitions, span_hashes,
                                  stored, text_chunks, unpacked, word_spans)
from scorelens.operators.components import connected_labels

SALTS = 32
FULLEST = 6


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and their offsets."""
    low = ASCII_LOWER[data]
    starts, ends, at = word_spans(low, off)
    h = span_hashes(low, starts, ends)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(at))
    n = max(0, len(h) - words + 1)
    shingle, doc = shingle_hashes(h, words), owner[:n]
    inside = np.arange(n) + words <= at[1:][doc]
    shingle, doc = shingle[inside], doc[inside]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < words))
    if len(short):
        whole = [shingle_hashes(h[at[d]:at[d + 1]], int(at[d + 1] - at[d])) for d in short]
        shingle, doc = np.concatenate([shingle, *whole]), np.concatenate([doc, short])
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    shingle, doc = shingle[new], doc[new]
    return shingle, np.searchsorted(doc, np.arange(len(off)))


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def set_digests(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set, as two longs."""
    return (as_long(mix(_sums(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), off))),
            as_long(mix(_sums(mix(sets + np.uint64(0x14057B7EF767814F)), off))))


class Segments:
    """Segment counts per size class for the link rule ``den * |x & y| >= num * |x | y|``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lower, self.count = [1], []

    def _class(self, c: int) -> None:
        while len(self.count) <= c:
            i = len(self.count)
            self.lower.append(self.lower[i] * self.den // self.num + 1)
            largest = self.lower[i + 1] - 1
            apart = 2 * largest * (self.den - self.num) // (self.den + self.num)
            k = apart + 1 + (apart + 4) // 5
            self.count.append(k)

    def roles(self, sizes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For the own size class and the next one: (class, segments, spare segments) of each set."""
        top = int(sizes.max()) if len(sizes) else 1
        c = 0
        while True:
            self._class(c + 1)
            if self.lower[c + 1] > top:
                break
            c += 1
        own = np.searchsorted(np.array(self.lower), sizes, side="right") - 1
        out = []
        for cls in (own, own + 1):
            k = np.array(self.count)[cls]
            partner = np.minimum(np.array(self.lower)[cls + 1] - 1, sizes * self.den // self.num)
            apart = (sizes + np.maximum(partner, 0)) * (self.den - self.num) // (self.den + self.num)
            out.append((cls, k, k - apart - 1))
        return out


def signatures(sets: np.ndarray, off: np.ndarray, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of the segments of each nonempty set."""
    sizes = np.diff(off)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = mix(sets * np.uint64(0xDA942042E4DD58B5)) >> np.uint64(32)
    value = mix(sets ^ np.uint64(0xA0761D6478BD642F))
    sigs, docs = [], []
    for cls, k, spare in segments.roles(np.maximum(sizes, 1)):
        base = np.concatenate([[0], np.cumsum(k)])
        cell = base[owner] + ((place * k[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(total, cell, value)
        held = np.bincount(cell, minlength=base[-1])
        doc = np.repeat(np.arange(len(sizes)), k)
        least = np.zeros(len(sizes), dtype=np.int64)  # the most a segment may be asked to hold
        for most in range(1, FULLEST + 1):
            least[np.bincount(doc[held < most], minlength=len(sizes)) <= spare] = most
        keep = (held >= least[doc]) & (sizes[doc] > 0)
        number = (np.arange(base[-1]) - base[doc]).astype(np.uint64)
        code = mix(total + mix(number * np.uint64(0xE7037ED1A0B428DB) + cls[doc].astype(np.uint64)))
        sigs.append(code[keep])
        docs.append(doc[keep])
    return np.concatenate(sigs), np.concatenate(docs)


def link_block(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the sets (sorted distinct hashes each): row products by breadth."""
    n = np.array([len(s) for s in sets])
    off = np.concatenate([[0], np.cumsum(n)])
    _, term, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((term, df[term], owner))  # each row: rarest n-grams first
    term = term[order]
    rank = np.arange(len(term)) - off[owner]
    leading = rank < (n - -(-num * n // den) + 1)[owner]
    by = np.argsort(term[leading], kind="stable")
    post_term, post_row = term[leading][by], owner[leading][by]
    prefix_len = n - -(-num * n // den) + 1
    unseen = np.ones(len(sets), dtype=bool)
    mark = np.zeros(len(df), dtype=bool)
    links: list[tuple[int, int]] = []
    for root in range(len(sets)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            lead = term[off[x]:off[x] + prefix_len[x]]
            lead = lead[df[lead] > 1]
            lo, hi = np.searchsorted(post_term, lead, "left"), np.searchsorted(post_term, lead, "right")
            if not len(lead):
                continue
            y = np.unique(np.concatenate([post_row[a:b] for a, b in zip(lo, hi, strict=True)]))
            y = y[unseen[y] & (den * n[y] >= num * n[x]) & (den * n[x] >= num * n[y])]
            if not len(y):
                continue
            mark[term[off[x]:off[x + 1]]] = True
            for part in np.array_split(y, -(-int(n[y].sum()) // 2_000_000)):
                cells = np.concatenate([term[off[i]:off[i + 1]] for i in part])
                overlap = np.add.reduceat(mark[cells].astype(np.int64), np.concatenate([[0], np.cumsum(n[part])[:-1]]))
                good = part[overlap * (den + num) >= num * (n[part] + n[x])]
                unseen[good] = False
                queue.extend(good.tolist())
                links.extend((x, int(i)) for i in good)
            mark[term[off[x]:off[x + 1]]] = False
    return links


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest node of its local component (nodes that are it left out)."""
    node, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(node))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text", cell_shingles: int = 4_000_000) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, set_hi, set_lo, text_key (xxhash64 of the text).

    Words are maximal runs of other characters than ASCII white space, A-Z
    lower-cased; a text of fewer than ``words`` words is one shingle.  Two
    documents link when ``den * |intersection| >= num * |union|``;
    ``component_id`` is the smallest id reachable.  Null, empty and wordless
    texts have an empty set and link with nothing.  Rows without an id do not
    link and have component_id null.  Rows with the same id and different texts
    take each its own set's component.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(1)):
                sets, at = shingle_sets(data, off, words)
                hi, lo = set_digests(sets, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(hi), pa.array(lo),
                                                  batch.column(2).slice(i, j - i)], names=["id", "n", "hi", "lo", "text_key"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(num, den)
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0)):
                sets, at = shingle_sets(data, off, words)
                node = set_digests(sets, at)[0]
                sig, doc = signatures(sets, at, segments)
                first = np.zeros(len(node), dtype=bool)
                first[np.unique(node, return_index=True)[1]] = True  # equal sets of a chunk: once
                keep = first[doc]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(sig[keep])), pa.array(node[doc[keep]])], names=["sig", "node"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by signature: ties each node to the first of its signature."""
        last_sig, head = None, None
        for batch in batches:
            sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.ones(len(sig), dtype=bool)
            new[1:] = sig[1:] != sig[:-1]
            lead = node[np.flatnonzero(new)][np.cumsum(new) - 1]
            if last_sig is not None and sig[0] == last_sig:
                lead[:np.flatnonzero(np.append(new[1:], True))[0] + 1] = head
            last_sig, head = sig[-1], lead[-1]
            tied = node != lead
            a, b = local_forest(node[tied], lead[tied])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = stored(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(
        describe, f"id {id_type}, n long, hi long, lo long, text_key long"), "ngram-sets")
    parts = shuffle_partitions(spark)
    tied = (rows.where("id IS NOT NULL").select("text").mapInArrow(sign, "sig long, node long")
            .repartition(parts, "sig").sortWithinPartitions("sig", "node").mapInArrow(share, "a long, b long"))
    blocks = stored(connected_labels(tied), "ngram-blocks")  # (node, component) over first digest halves

    sets = found.where("n > 0 AND id IS NOT NULL").groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"))
    # an id may stand on several sets: the nodes of the product are the sets themselves
    sets = sets.withColumn("node", F.expr("concat(lpad(hex(hi), 16, '0'), lpad(hex(lo), 16, '0'), hex(n))"))
    placed = stored(sets.join(blocks.select(F.col("node").alias("hi"), F.col("component").alias("block")), "hi"), "ngram-placed")
    large = (placed.groupBy("block").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members"))
             .where("members > 1").withColumn("chunks", F.ceil(F.col("total") / cell_shingles).cast("int")).drop("members"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.when(F.col("chunks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: o != F.col("chunk")),
                    lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j"))))
    wanted = placed.join(large, "block").withColumn("chunk", chunk)
    total = large.agg(F.sum(F.col("total") * F.greatest(F.lit(1), F.col("chunks") - 1))).first()[0] or 0
    cells = max(parts, -(-int(total) // cell_shingles))

    # the same plan at every size: the list of sets to load grows with the input and is never broadcast
    with_text = pack_texts(rows).withColumnRenamed("id", "rep").join(
        wanted.select("rep", "node", "hi", "lo", "block", F.explode(pairs).alias("tile")).hint("merge"), "rep").select(
        "node", "hi", "lo", "block", "tile.i", "tile.j", "z")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in unpacked(batch.column(6)):
                _, _, data, off = next(text_chunks(texts, 1 << 62, 1 << 62))
                part = batch.slice(i, j - i)
                sets, at = shingle_sets(data, off, words)
                hi, lo = set_digests(sets, at)
                same = (hi == part.column(1).to_numpy()) & (lo == part.column(2).to_numpy())
                packed = pa.array([sets[at[d]:at[d + 1]].tobytes() if same[d] else None for d in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in (0, 3, 4, 5)], packed],
                                                 names=["node", "block", "i", "j", "grams"])

    loaded = (with_text.mapInArrow(load, "node string, block long, i int, j int, grams binary")
              .where("grams IS NOT NULL").withColumn("cell", F.pmod(F.xxhash64("block", "i", "j"), F.lit(cells))))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, group in pdf.groupby(["block", "i", "j"], sort=False):
            group = group.drop_duplicates("node")
            node = group["node"].to_numpy()
            for x, y in link_block([np.frombuffer(g, np.uint64) for g in group["grams"]], num, den):
                a.append(node[x])
                b.append(node[y])
        return pd.DataFrame({"a": pd.Series(a, dtype=pdf["node"].dtype), "b": pd.Series(b, dtype=pdf["node"].dtype)})

    links = loaded.groupBy("cell").applyInPandas(multiply, "a string, b string")
    # (node, smallest id of its component); a component of many sets is dealt over salts
    joined = stored(connected_labels(links).join(sets.select("node", "rep"), "node")
                    .withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), "ngram-joined")
    part = joined.groupBy("component", "salt").agg(F.min("rep").alias("least"))
    least = part.select("component", "salt").join(part.groupBy("component").agg(F.min("least").alias("least")), "component")
    ids = joined.join(least, ["component", "salt"]).select("node", "least")
    by_set = (sets.join(ids, "node", "left")
              .select("hi", "lo", "n", F.coalesce("least", "rep").alias("component")))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    salted = found.where("n > 0 AND id IS NOT NULL").select("hi", "lo", "n", salt).distinct().join(by_set, ["hi", "lo", "n"])
    out = found.withColumn("salt", salt).join(salted, ["hi", "lo", "n", "salt"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
                      F.col("hi").alias("set_hi"), F.col("lo").alias("set_lo"), "text_key")


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their text's component, with all their columns.

    Rows without an id stay.  A row goes by its id and its text, so another text
    under the same id is judged by its own component; rows that share the smallest id all stay.
    """
    groups = jaccard_components(docs, words, num, den, id_col, text_col)
    gone = (groups.where(F.col(id_col) != F.col("component_id"))
            .select(F.col(id_col).alias("__gone"), F.col("text_key").alias("__key")))
    same = (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__key"])
    return docs.join(gone, same, "left_anti")
