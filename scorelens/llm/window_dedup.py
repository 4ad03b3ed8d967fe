"""Substring dedup over words: super-k-mer partitioning.

Consecutive windows of ``k`` words that share a minimiser travel as one packed
string (their words joined by a space) to the minimiser's bucket.  Strings are
combined before they travel; in the bucket the windows of all strings are
sorted, and each run of equal windows yields the smallest document id that has
it.  Only strings whose minimiser occurs in another document are sent at all.

A minimiser with more than ``most_strings`` different strings is not sorted in
one bucket: its windows are spread one by one and grouped by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelens.llm.common import pack_texts, shingle_hashes, span_hashes, stored, text_chunks, unpacked, word_spans
from scorelens.llm.minimisers import Runs, codes, repeated, window_runs

MER = 6


def word_runs(data: np.ndarray, off: np.ndarray, k: int) -> Runs:
    starts, ends, at = word_spans(data, off)
    m = min(MER, k)
    return window_runs(shingle_hashes(span_hashes(data, starts, ends), m), at, k, m)


def packed_runs(data: np.ndarray, off: np.ndarray, k: int, wanted: list, buckets: int) -> list[tuple[int, int, int, bytes]]:
    """(document, first word in it, code, words joined by a space) of the runs with a wanted code."""
    starts, ends, at = word_spans(data, off)
    runs = word_runs(data, off, k)
    code = codes(runs.mer, buckets)
    raw, sets, out = data.tobytes(), {}, []
    for d, s, c, x in zip(runs.doc.tolist(), runs.start.tolist(), runs.count.tolist(), code.tolist(), strict=True):
        if d not in sets:
            sets[d] = set(wanted[d])
        if x in sets[d]:
            e = s + c + k - 1
            if (starts[s + 1:e] - ends[s:e - 1] == 1).all() and b" " * (e - s - 1) == bytes(raw[i] for i in ends[s:e - 1].tolist()):
                text = raw[starts[s]:ends[e - 1]]
            else:
                text = b" ".join([raw[a:b] for a, b in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)])
            out.append((d, int(s - at[d]), x, text))
    return out


def sort_windows(strings: list[bytes], first: list[int], k: int) -> list[list[int]]:
    """For each string the smallest ``first`` among all strings that hold the window, by window."""
    windows = []
    for n, text in enumerate(strings):
        words = text.split(b" ")
        for o in range(len(words) - k + 1):
            windows.append((b" ".join(words[o:o + k]), first[n], n, o))
    windows.sort()
    out: list[list[int]] = [[0] * (s.count(b" ") + 2 - k) for s in strings]
    last, least = None, 0
    for text, f, n, o in windows:
        if text != last:
            last, least = text, f  # sorted by id next: the first of a run is the smallest
        out[n][o] = least
    return out


def _judge_windows(strings: DataFrame, k: int) -> DataFrame:
    """(code, hash, least) of strings whose windows are spread one by one and grouped by their words."""
    words = F.split(F.col("words").cast("string"), " ")
    spread = (strings.select("code", "hash", "first", words.alias("w"))
              .select("code", "hash", "first", F.posexplode(F.transform(
                  F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda o: F.array_join(F.slice("w", o, k), " "))).alias("pos", "window")))
    least = spread.groupBy("window").agg(F.min("first").alias("least"))
    return (spread.join(least, "window").groupBy("code", "hash")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "least"))), lambda s: s["least"]).alias("least")))


def drop_repeated_windows(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text",
                          most_strings: int = 20_000, carry: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (words joined by a space), spans [, row].

    Words are maximal runs of other characters than ASCII white space.  A word
    goes when a window of ``k`` words covers it whose words also start in a
    document with a smaller id; windows are judged on the input.  ``spans``:
    removed word runs [start, end).  Null text has no words.  Rows without an
    id keep everything and count for no other row; rows with the same id do
    not count for each other.  Extra columns are ignored whatever their names;
    ``carry`` adds the input row without its text as the struct ``row``, and
    then ``kept`` of a text that loses nothing is the text itself.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))
    base = docs.select(*cols)
    named = base.select("id", "key", "text").where("id IS NOT NULL")

    again, buckets = repeated(named.select("key", "text"), lambda d, o: word_runs(d, o, k), within=False)
    held = stored(pack_texts(named).join(again.hint("merge"), "key"), "window-docs")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in unpacked(batch.column(2)):
                _, _, data, off = next(text_chunks(texts, 1 << 62, 1 << 62))
                got = packed_runs(data, off, k, batch.column(3).slice(i, j - i).to_pylist(), buckets)
                take = pa.array([i + g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array([g[1] for g in got], pa.int32()),
                     pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.binary())],
                    names=["id", "key", "start", "code", "words"])

    sent = (held.select("id", "key", "z", "codes")
            .mapInArrow(strings, f"id {id_type}, key long, start int, code long, words binary")
            .withColumn("hash", F.xxhash64("words")))
    packed = stored(sent.groupBy("code", "hash", "words").agg(F.min("id").alias("first"), F.max("id").alias("last")),
                    "window-strings")
    per_code = packed.groupBy("code").agg(F.count(F.lit(1)).alias("strings"), F.sum(F.octet_length("words")).alias("bytes"))
    crowded = stored(per_code.where(F.col("strings") > most_strings).select("code"), "window-crowded")
    total, crowds = per_code.agg(F.sum("bytes")).first()[0] or 0, crowded.count()
    cells = max(buckets, -(-int(total) // (4 << 20)))
    plain = packed.join(crowded, "code", "left_anti") if crowds else packed

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        across = pdf.groupby("code").agg(lo=("first", "min"), hi=("last", "max"))
        pdf = pdf[pdf["code"].isin(across.index[across["lo"] < across["hi"]])]
        first = pdf["first"].tolist()
        least = sort_windows(pdf["words"].tolist(), first, k)
        keep = [n for n, row in enumerate(least) if first[n] != pdf["last"].iat[n] or any(f != first[n] for f in row)]
        part = pdf.iloc[keep]
        return pd.DataFrame({"code": part["code"], "hash": part["hash"], "least": pd.Series([least[n] for n in keep], part.index, dtype=object)})

    verdict = f"code long, hash long, least array<{id_type}>"
    judged = (plain.withColumn("cell", F.pmod(F.xxhash64("code"), F.lit(cells)))
              .groupBy("cell").applyInPandas(judge, verdict))
    if crowds:
        judged = judged.unionByName(_judge_windows(packed.join(crowded, "code"), k))

    gone = F.filter(F.transform("least", lambda f, o: F.when(f < F.col("id"), F.col("start") + o)), lambda p: p.isNotNull())
    windows = (sent.select("id", "key", "start", "code", "hash").join(judged, ["code", "hash"])
               .select("id", "key", gone.alias("gone")).where(F.size("gone") > 0)
               .groupBy("id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone")))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in unpacked(batch.column(1)):
                _, _, data, off = next(text_chunks(texts, 1 << 62, 1 << 62))
                starts, ends, at = word_spans(data, off)
                raw, lost, rows = data.tobytes(), batch.column(2).slice(i, j - i).to_pylist(), []
                for d in range(j - i):
                    a, b = int(at[d]), int(at[d + 1])
                    keep, spans = np.ones(b - a, dtype=bool), []
                    if lost[d]:
                        cover = np.zeros(b - a + 1, dtype=np.int64)
                        first = np.unique(np.array(lost[d]))
                        cover[first] += 1
                        np.subtract.at(cover, first + k, 1)
                        keep = np.cumsum(cover[:-1]) == 0
                        edge = np.flatnonzero(np.diff(np.concatenate([[1], keep, [1]]).astype(np.int8)))
                        spans = edge.reshape(-1, 2).tolist()
                    left = np.flatnonzero(keep) + a
                    kept = b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
                    if carry and not spans:
                        kept = raw[off[d]:off[d + 1]]
                    rows.append((b - a, b - a - len(left), kept.decode(), spans))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.list_(pa.int32()))),
                     *part.columns[3:]], names=names)

    names = ["id", "n_words", "n_removed", "kept", "spans", *(["row"] if carry else [])]
    schema = f"id {id_type}, n_words long, n_removed long, kept string, spans array<array<int>>"
    if carry:
        schema += ", row " + base.schema["row"].dataType.simpleString()
    out = pack_texts(base).join(windows.hint("merge"), ["id", "key"], "left").select("id", "z", "gone", *(["row"] if carry else []))
    return out.mapInArrow(clean, schema).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text that loses words replaced by the words kept, joined by one space.

    Same columns, one row per input row; other texts stay as they are (null becomes empty).
    """
    done = drop_repeated_windows(docs, k, id_col, text_col, carry=True)
    return done.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
