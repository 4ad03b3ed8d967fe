"""Substring dedup over bytes by suffix arrays built through suffix grouping.

Windows of ``k`` bytes go with their minimiser: runs whose minimiser occurs
again are sent as packed strings, equal strings are combined first and keep
their number of occurrences.  Where a minimiser has strings that occur once
beside other strings, stretches whose window hashes occur once are cut away,
equal remains are combined, and a suffix array puts equal windows next to each
other; their occurrences are added up.  Remains with several copies are repeated
whole; of these the array holds what the other remains may share.

The suffix array is built in two linear phases.  Grouping: suffixes start
grouped by first byte; groups are processed from the greatest to the smallest;
each suffix points to the nearest earlier one in a smaller group (previous
smaller pointers), and those pointed at, together with how often, move to new
groups right behind their old ones.  At the end a group holds the suffixes
with one Lyndon prefix.  Placing: from the smallest suffix on, the suffix
before a placed one takes the next place of its group, then the one its pointer
names, and so on; no ranks are renamed and nothing is sorted recursively.

A minimiser with more than ``most_strings`` different strings is not handled at
once: its windows are spread one by one and grouped by 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelens.llm.common import _BYTE_CODE, mix, pack_texts, span_hashes, stored, text_chunks, unpacked
from scorelens.llm.minimisers import Runs, codes, repeated, window_runs

MER = 24
CELL_STRINGS = 1000  # of at most 2k bytes each, on average, in a cell


def byte_runs(data: np.ndarray, off: np.ndarray, k: int) -> Runs:
    m = min(MER, k)
    mers = _BYTE_CODE[data]
    have, step = 1, 1
    while have < m:  # m-mer hashes by doubling
        step = min(have, m - have)
        if len(mers) <= step:
            return window_runs(np.zeros(0, np.uint64), off, int(off[-1]) + 1, m)
        mers = mix(mers[:-step] * np.uint64(0x9FB21C651E98DF25) + mers[step:])
        have += step
    return window_runs(mers, off, k, m)


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol must be smaller than all others."""
    n = len(text)
    # groups: linked list from the smallest to the greatest; members may be stale (the owner decides)
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in by_symbol:
            by_symbol[c].append(i)
        else:
            by_symbol[c] = [i]
    group = [0] * n
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        below.append(g - 1)
        above.append(g + 1)
        for i in by_symbol[c]:
            group[i] = g
    above[-1] = -1
    sizes = [len(m) for m in members]
    done = bytearray(n)
    pointer = [-1] * n
    jump = [-1] * n
    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        own.sort()
        members[now] = own
        for i in own:
            done[i] = 1
        hits: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = jump[j]
            pointer[i] = jump[i] = j
            if i and done[i - 1] and group[i - 1] != now:
                jump[i - 1] = j  # the next walk over it is short
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            by_times: dict[int, list[int]] = {}
            for j, times in hits.items():
                if times in by_times:
                    by_times[times].append(j)
                else:
                    by_times[times] = [j]
            for times in sorted(by_times, reverse=True):
                new: dict[int, int] = {}
                for j in by_times[times]:
                    old = group[j]
                    g = new.get(old)
                    if g is None:
                        g = new[old] = len(members)
                        members.append([])
                        sizes.append(0)
                        below.append(old)
                        above.append(above[old])
                        if above[old] >= 0:
                            below[above[old]] = g
                        above[old] = g
                    members[g].append(j)
                    sizes[g] += 1
                    sizes[old] -= 1
                    group[j] = g
        now = below[now]
    place, at, g = [0] * len(members), 0, 0
    while g >= 0:
        place[g] = at
        at += sizes[g]
        g = above[g]
    out = [0] * n
    out[0] = n - 1
    put = bytearray(n)
    put[n - 1] = 1
    place[group[n - 1]] += 1
    for r in range(n):
        s = out[r] - 1
        while s >= 0 and not put[s]:
            g = group[s]
            out[place[g]] = s
            place[g] += 1
            put[s] = 1
            s = pointer[s]
    return out


def _joined(strings: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all strings with one separator each, string offsets, owner of each byte, whether a window starts."""
    data = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    sizes = np.array([len(s) for s in strings])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    return data, base, owner, np.arange(base[-1]) + k <= (base[1:] - 1)[owner]


def equal_neighbours(strings: list[bytes], times: list[int], k: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``k`` bytes occur at least twice, by a suffix array."""
    data, base, owner, valid = _joined(strings, k)
    text = data.astype(np.int64) + 2
    text[base[1:] - 1] = 1
    order = np.array(suffix_array([*text.tolist(), 0]), dtype=np.int64)
    order = order[order < base[-1]]
    order = order[valid[order]]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = span_hashes(data, order[1:], order[1:] + k) == span_hashes(data, order[:-1], order[:-1] + k)
    check, span = np.flatnonzero(same), np.arange(k)
    for i in range(0, len(check), 1 << 14):  # neighbours in the suffix array: compare the bytes
        c = check[i:i + (1 << 14)]
        same[c] = (data[order[c][:, None] + span] == data[order[c - 1][:, None] + span]).all(axis=1)
    run = np.cumsum(~same) - 1
    weight = np.bincount(run, weights=np.array(times)[owner[order]]) if len(order) else np.zeros(0)
    flag = np.zeros(base[-1], dtype=bool)
    flag[order] = weight[run] >= 2
    return [flag[base[i]:max(base[i], base[i + 1] - k)] for i in range(len(strings))]


def _stretches(mask: np.ndarray) -> list[list[int]]:
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2).tolist()


def repeated_windows(strings: list[bytes], times: list[int], k: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``k`` bytes occur at least twice, ``times`` counted.

    Stretches whose window hashes all occur once are cut away first and equal
    remains are combined.  A remain with several copies holds repeated windows
    only; beside the others it matters where the hashes of its windows occur in
    them, and is cut to that.  The suffix array is built over what is left.
    """
    data, base, owner, valid = _joined(strings, k)
    at = np.flatnonzero(valid)
    _, which = np.unique(span_hashes(data, at, at + k), return_inverse=True)
    kind = np.full(base[-1], -1, dtype=np.int64)
    kind[at] = which
    often = np.zeros(base[-1], dtype=bool)
    if len(at):
        often[at] = np.bincount(which, weights=np.array(times)[owner[at]])[which] >= 2
    raw, weight, held = data.tobytes(), {}, []
    for a, b in _stretches(often):
        piece = raw[a:b + k - 1]
        weight[piece] = weight.get(piece, 0) + times[owner[a]]
        held.append((a, b, piece))
    single = {piece: (a, b) for a, b, piece in held if weight[piece] == 1}
    asked = np.zeros(len(at), dtype=bool)
    for a, b in single.values():
        asked[kind[a:b]] = True
    parts = dict.fromkeys(single, 1)
    for piece, (a, b) in {p: (a, b) for a, b, p in held if p not in single}.items() if single else ():
        for c, d in _stretches(asked[kind[a:b]]):
            part = raw[a + c:a + d + k - 1]
            parts[part] = parts.get(part, 0) + weight[piece]
    found = dict(zip(parts, equal_neighbours(list(parts), list(parts.values()), k), strict=True)) if parts else {}
    flag = np.zeros(base[-1], dtype=bool)
    for a, b, piece in held:
        flag[a:b] = found[piece] if piece in single else True
    return [flag[base[i]:max(base[i], base[i + 1] - k)] for i in range(len(strings))]


def flag_spans(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, one after the other."""
    return [edge for stretch in _stretches(flags) for edge in stretch]


def _judge_digests(strings: DataFrame, k: int) -> DataFrame:
    """(code, hash, runs) of strings whose windows are spread one by one and grouped by digest."""
    windows = F.octet_length("bytes") - (k - 1)
    spread = strings.select("code", "hash", "times", F.posexplode(F.transform(
        F.sequence(F.lit(1), windows), lambda o: F.unhex(F.md5(F.substring("bytes", o, k))))).alias("pos", "window"))
    often = spread.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
    return (spread.join(often, "window").groupBy("code", "hash")
            .agg(F.flatten(F.transform(F.collect_list("pos"), lambda p: F.array(p.cast("long"), p.cast("long") + 1))).alias("runs")))


def drop_repeated_bytes(docs: DataFrame, k: int = 400, id_col: str = "doc_id", text_col: str = "text",
                        most_strings: int = 20_000) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (binary), spans.

    A byte of a text's UTF-8 goes when a string of ``k`` bytes covers it that
    starts anywhere else too, in the same document or another; overlaps count;
    strings are judged on the input.  ``spans``: starts and ends of the maximal
    removed runs, one after the other.  Null text is empty.  Rows without an id
    and repeated rows are documents like any other.  Extra columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))
    again, buckets = repeated(base.select("key", "text"), lambda d, o: byte_runs(d, o, k), within=True)
    held = stored(pack_texts(base).join(again.hint("merge"), "key"), "suffix-docs")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in unpacked(batch.column(2)):
                _, _, data, off = next(text_chunks(texts, 1 << 62, 1 << 62))
                runs = byte_runs(data, off, k)
                code = codes(runs.mer, buckets)
                wanted = batch.column(3).slice(i, j - i).to_pylist()
                keep = np.zeros(len(code), dtype=bool)
                cut = np.searchsorted(runs.doc, np.arange(j - i + 1))
                for d in range(j - i):
                    keep[cut[d]:cut[d + 1]] = np.isin(code[cut[d]:cut[d + 1]], np.array(wanted[d], dtype=np.int64))
                raw = data.tobytes()
                at = np.flatnonzero(keep)
                take = pa.array(i + runs.doc[at], pa.int64())
                packed = [raw[s:s + c + k - 1] for s, c in zip(runs.start[at].tolist(), runs.count[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(runs.start[at] - off[runs.doc[at]], pa.int64()),
                     pa.array(code[at], pa.int64()), pa.array(packed, pa.binary())], names=["id", "key", "start", "code", "bytes"])

    sent = (held.select("id", "key", "z", "codes")
            .mapInArrow(strings, f"id {id_type}, key long, start long, code long, bytes binary")
            .withColumn("hash", F.xxhash64("bytes")))
    packed = stored(sent.groupBy("code", "hash", "bytes").agg(F.count(F.lit(1)).alias("times")), "suffix-strings")
    crowded = stored(packed.groupBy("code").count().where(F.col("count") > most_strings).select("code"), "suffix-crowded")
    crowds, cells = crowded.count(), max(buckets, -(-packed.count() // CELL_STRINGS))
    plain = packed.join(crowded, "code", "left_anti") if crowds else packed

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        by = pdf.groupby("code")["times"]
        pdf = pdf[(by.transform("size") > 1) | (pdf["times"] > 1)]
        strings = pdf["bytes"].tolist()
        flags = repeated_windows(strings, pdf["times"].tolist(), k) if strings else []
        keep = [n for n, f in enumerate(flags) if f.any()]
        part = pdf.iloc[keep]
        return pd.DataFrame({"code": part["code"], "hash": part["hash"], "runs": pd.Series([flag_spans(flags[n]) for n in keep], part.index, dtype=object)})

    # equal windows have one code, so a cell may judge the strings of all its codes together
    judged = (plain.withColumn("cell", F.pmod(F.xxhash64("code"), F.lit(cells)))
              .groupBy("cell").applyInPandas(judge, "code long, hash long, runs array<long>"))
    if crowds:
        judged = judged.unionByName(_judge_digests(packed.join(crowded, "code"), k))

    shifted = F.transform("runs", lambda r, o: r + F.col("start") + F.when(o % 2 == 1, F.lit(k - 1)).otherwise(F.lit(0)))
    gone = (sent.select("id", "key", "start", "code", "hash").join(judged, ["code", "hash"])
            .select("id", "key", shifted.alias("gone"))
            .groupBy("id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone")))
    gone = gone.select(F.col("id").alias("gid"), F.col("key").alias("gkey"), "gone")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in unpacked(batch.column(1)):
                lost, rows = batch.column(2).slice(i, j - i).to_pylist(), []
                for t, g in zip(texts.cast(pa.large_binary()).to_pylist(), lost, strict=True):
                    spans: list[int] = []
                    if g:
                        edges = np.array(g, dtype=np.int64).reshape(-1, 2)
                        edges = edges[np.argsort(edges[:, 0], kind="stable")]
                        reach = np.maximum.accumulate(edges[:, 1])
                        new = np.concatenate([[True], edges[1:, 0] > reach[:-1]])
                        spans = np.column_stack([edges[new, 0], reach[np.append(new[1:], True)]]).ravel().tolist()
                    at = [0, *spans, len(t)]
                    kept = b"".join([t[a:b] for a, b in zip(at[::2], at[1::2], strict=True)])
                    rows.append((len(t), len(t) - len(kept), len(spans) // 2, kept, spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array([r[c] for r in rows], pa.int64()) for c in range(3)],
                     pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    left = pack_texts(base)
    out = left.join(gone.hint("merge"), left["id"].eqNullSafe(gone["gid"]) & (left["key"] == gone["gkey"]), "left")
    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"
    return out.select("id", "z", "gone").mapInArrow(clean, schema).withColumnRenamed("id", id_col)
