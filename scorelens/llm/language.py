"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased, everything but letters becomes one space, and the
1- to 3-grams of a whole text are hashed to ``SLOTS`` features with
(1 + ln count) * idf, scaled to unit length.  Document frequencies are counted
over every training document by Spark.  The weights are fitted on a bounded
sample (``sample`` documents, an equal share of each language, smallest by
hash of the id) with follow-the-regularised-leader updates whose L1 and L2
penalties leave most weights at zero; a part of the sample then sets one
temperature for the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scorelens.llm.common import text_chunks

SLOTS = 8192
CHUNK_DOCS = 512
SALTS = 64
UNKNOWN = "und"
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-cased code point; 32 for anything that is not a letter."""
    if not _TABLE:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def gram_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse n-gram counts of a chunk: (document, slot, count) and whether each document has a letter."""
    docs = len(off) - 1
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    at = lead[off]
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
    first = at[:-1][np.diff(at) > 0]
    keep[first] = True
    total = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    letters = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars != 32, out=letters[1:])
    has_letter = letters[at[1:]] > letters[at[:-1]]
    chars, at = chars[keep], total[at]
    owner = np.repeat(np.arange(docs), np.diff(at))
    ends = np.repeat(at[1:], np.diff(at))
    counts = np.zeros(docs * SLOTS, dtype=np.int64)
    code = np.zeros(len(chars), dtype=np.uint32)
    for n in (1, 2, 3):
        m = len(chars) - n + 1
        if m <= 0:
            break
        code = (code[:m] ^ (chars[n - 1:] * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        slot = (code ^ (code >> np.uint32(15))) % np.uint32(SLOTS)
        inside = np.arange(m) + n <= ends[:m]
        counts += np.bincount(owner[:m][inside] * SLOTS + slot[inside], minlength=docs * SLOTS)
    cell = np.flatnonzero(counts)
    return cell // SLOTS, cell % SLOTS, counts[cell], has_letter


def weighted(doc: np.ndarray, slot: np.ndarray, count: np.ndarray, idf: np.ndarray, docs: int) -> np.ndarray:
    """Unit-length TF-IDF value of each (document, slot)."""
    value = (1 + np.log(count)) * idf[slot]
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=docs))
    return value / np.maximum(norm, 1e-12)[doc]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray      # (languages, slots), mostly zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, doc, slot, value, docs: int) -> np.ndarray:
        return np.stack([np.bincount(doc, weights=value * w[slot], minlength=docs) for w in self.weights], axis=1) + self.bias

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, probability, has a letter) per document."""
        docs = len(off) - 1
        doc, slot, count, has_letter = gram_counts(data, off)
        p = softmax(self.logits(doc, slot, weighted(doc, slot, count, self.idf, docs), docs) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(docs), best], has_letter


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4,
             alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, seed: int = 11):
    """Per-coordinate FTRL-proximal updates of a multinomial logistic model; returns (weights, bias)."""
    z, n = np.zeros((classes, SLOTS + 1)), np.zeros((classes, SLOTS + 1))
    rng = np.random.default_rng(seed)

    def current(zs, ns, penalty):
        return np.where(np.abs(zs) <= penalty, 0.0,
                        -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            slot, value = samples[i]
            cols = np.append(slot, SLOTS)
            x = np.append(value, 1.0)
            penalty = np.append(np.full(len(slot), l1), 0.0)
            zs, ns = z[:, cols], n[:, cols]
            w = current(zs, ns, penalty)
            p = softmax(w @ x)
            p[labels[i]] -= 1
            g = p[:, None] * x[None]
            more = ns + g * g
            z[:, cols] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[:, cols] = more
    w = current(z, n, np.append(np.full(SLOTS, l1), 0.0)[None])
    return w[:, :SLOTS], w[:, SLOTS]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least negative log-likelihood (golden-section search on its logarithm).

    The targets are smoothed by one pseudo-error, so rows without an error give a finite confidence.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    target = np.full(logits.shape, 1 / (len(labels) + 2) / (logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - 1 / (len(labels) + 2)

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean()

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(40):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = loss(b)
    return float(np.exp((lo + hi) / 2))


# ---------------------------------------------------------------- Spark side

def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = 3000, most_languages: int = 2000) -> LanguageModel | None:
    """Fit on the rows given (leave held-out rows out); None if no row has text and language.

    The fit reads at most ``sample`` documents (or one per language), each with at
    most ``SLOTS`` counts (64 KB), and learns every value of ``lang``; document
    frequencies cover all rows.  More than ``most_languages`` values (131 MB a
    matrix of the model at 2000) raise.  Rows with a null id, text or language do
    not count; an id on several rows of a language is one document of the sample,
    its text the smallest by hash.
    """
    rows = (docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} values of {lang_col}: the model cannot hold them all")
    if not languages:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text"), max_docs=CHUNK_DOCS):
                _, slot, _, _ = gram_counts(data, off)
                df += np.bincount(slot, minlength=SLOTS)
                n += j - i
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, SLOTS)), pa.array(np.append(df[used], n))],
                                         names=["slot", "n"])

    counted = (rows.select("text").mapInArrow(frequencies, "slot long, n long")
               .groupBy("slot").agg(F.sum("n").alias("n")).collect())  # at most SLOTS + 1 rows
    df = np.zeros(SLOTS + 1)
    for r in counted:
        df[r.slot] = r.n
    idf = np.log((1 + df[SLOTS]) / (1 + df[:SLOTS])) + 1

    share = max(1, sample // len(languages))
    ids = rows.select("id", "lang").distinct().withColumn("h", F.xxhash64("id"))
    for keys in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):  # no task ranks a whole language
        order = Window.partitionBy(*keys).orderBy("h", "id")
        ids = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= share).drop("k")
    chosen = (rows.join(F.broadcast(ids.drop("h")), ["id", "lang"])
              .groupBy("id", "lang").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row"))
              .select("id", "lang", "row.text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text"), max_docs=CHUNK_DOCS):
                doc, slot, count, has_letter = gram_counts(data, off)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                part = batch.slice(i, j - i)
                slots = [slot[at[d]:at[d + 1]].astype("<i4").tobytes() for d in range(j - i)]
                counts = [count[at[d]:at[d + 1]].astype("<i4").tobytes() if has_letter[d] else None for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("lang"),
                                                  pa.array(slots, pa.binary()), pa.array(counts, pa.binary())],
                                                 names=["id", "lang", "slots", "counts"])

    got = (chosen.mapInArrow(features, "id string, lang string, slots binary, counts binary")
           .where("counts IS NOT NULL").collect())
    if not got:
        return None
    got.sort(key=lambda r: (r.id, r.lang, r.slots, r.counts))
    samples, labels = [], np.array([languages.index(r.lang) for r in got])
    for r in got:
        slot, count = np.frombuffer(r.slots, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i4")
        samples.append((slot, weighted(np.zeros(len(slot), np.int64), slot, count, idf, 1)))
    held = np.arange(len(got)) % 5 == 4 if len(got) >= 20 else np.zeros(len(got), bool)
    held[np.unique(labels, return_index=True)[1]] = False  # one document of each language is always learned
    fit_rows = np.flatnonzero(~held)
    weights, bias = fit_ftrl([samples[i] for i in fit_rows], labels[fit_rows], len(languages))
    model = LanguageModel(languages, idf, weights, bias)
    out = np.flatnonzero(held)
    logits = np.array([weights[:, samples[i][0]] @ samples[i][1] + bias for i in out]).reshape(len(out), len(languages))
    model.temperature = fit_temperature(logits, labels[out])
    return model


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score.

    Null texts and texts without a letter, and all texts if there is no model,
    are ``und`` with score 0.  Ids pass through (null, repeated); extra columns
    are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x SLOTS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(1), max_docs=CHUNK_DOCS):
                if model is None:
                    best, p, ok = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i, bool)
                else:
                    best, p, ok = model.predict(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i),
                     pa.array([model.languages[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)], pa.string()),
                     pa.array(np.where(ok, p, 0.0))], names=["id", "lang_pred", "score"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)
