"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of ASCII letters and digits and of all other characters beyond
ASCII, A-Z lower-cased) are hashed to buckets with an embedding each; a word's
vector is the sum over itself and its leading parts of ``PARTS`` bytes, so
inflected forms share what they have in common.  Filters of several widths run
over the whole text, each filter's maximum over all positions goes into a
logistic unit.  Buckets that occur in few training documents share the zero
vector, so the model stays small.

Training (driver, numpy, Adam) uses a bounded sample of labelled documents:
``per_class`` documents of each label, the smallest by hash of the id, of at
most ``longest`` words, in that order while they have at most ``most_words``
words together (20 bytes a word reach the driver).  One remainder class of the training ids is kept out of
the fit and calibrates one threshold per language; the language of a text is
guessed from its own words, the column ``lang`` is read only while learning.
A score is the probability moved on the logit scale so that the threshold of
its language lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelens.llm.common import ASCII_LOWER, release_memory, span_hashes, stored, text_chunks

WIDTHS = (1, 2, 3)
PARTS = (5, 6, 7, 8)
FILTERS = 8
DIM = 8
PROFILE_WORDS = 40
STRIDE = 1 + len(PARTS)
DECAY = 0.02

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def hashed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, STRIDE) hashes of each word and its leading parts (0: no such part), word offsets per document."""
    low = ASCII_LOWER[data]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[off] = True
    word = _WORD[low]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    starts = np.flatnonzero(word & (~before | edge[:-1])) if len(low) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1 if len(low) else starts
    out = np.zeros((len(starts), STRIDE), dtype=np.uint32)
    for c, size in enumerate((None, *PARTS)):
        longer = slice(None) if size is None else np.flatnonzero(ends - starts > size)
        first = starts[longer]
        h = span_hashes(low, first, ends[longer] if size is None else first + size) >> np.uint64(32)
        out[longer, c] = np.maximum(h, 1)
    return out, np.searchsorted(starts, off)


@dataclass
class ToxicityModel:
    buckets: np.ndarray                       # sorted hashes with an embedding
    embedding: np.ndarray                     # (buckets + 1, DIM); row 0 is zero
    filters: dict[int, np.ndarray]            # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    offset: float
    profile: np.ndarray                       # (buckets + 1, languages): words typical of a language
    languages: list[str]
    thresholds: np.ndarray = field(default_factory=lambda: np.array([0.5]))  # per language, last: pooled
    constant: float | None = None             # without both labels: this score for every text

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding row of each hash (0: no bucket)."""
        if len(self.buckets) == 0:
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, hashes), len(self.buckets) - 1)
        return np.where(self.buckets[at] == hashes, at + 1, 0)

    def predict(self, hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, language index) per document; the last index is 'none'."""
        docs = len(off) - 1
        rows = self.rows(hashes)
        vec = self.embedding[rows[:, 0]]
        for c in range(1, STRIDE):
            vec += self.embedding[rows[:, c]]
        pooled = [max_pool(convolve(vec, off, self.filters[k]), off) for k in WIDTHS]
        x = np.concatenate([np.maximum(p + self.bias[k], 0) for k, p in zip(WIDTHS, pooled, strict=True)], axis=1)
        z = np.clip(x @ self.weights + self.offset, -30, 30)
        hits = segment_sums(self.profile[rows[:, 0]], off)
        lang = np.where(hits.any(axis=1), hits.argmax(axis=1), len(self.languages)) if hits.size else np.zeros(docs, int)
        return 1 / (1 + np.exp(-z)), lang

    def score(self, hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, probability, language index); score >= 0.5 from the language's threshold on."""
        if self.constant is not None:
            p = np.full(len(off) - 1, self.constant)
            return p, p, np.full(len(off) - 1, len(self.languages))
        p, lang = self.predict(hashes, off)
        t = self.thresholds[lang]
        odds = p / (1 - p) * (1 - t) / t
        return odds / (1 + odds), p, lang


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def convolve(vec: np.ndarray, off: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Filter responses at every word; words past the document's end count as zero vectors."""
    n = len(vec)
    out = vec @ filters[0]
    ends = np.repeat(off[1:], np.diff(off))
    for j in range(1, min(len(filters), n)):
        out[:n - j] += (vec[j:] @ filters[j]) * (ends[:n - j] > np.arange(j, n))[:, None]
    return out


def max_pool(conv: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Maximum of each filter over a document's words (0 responses for a text without words)."""
    out = np.zeros((len(off) - 1, conv.shape[1]), dtype=conv.dtype)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(conv, off[full], axis=0)
    return out


def fit(words: list[np.ndarray], labels: np.ndarray, langs: list[str | None], calibrate: np.ndarray,
        prior: float | None = None, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ToxicityModel:
    """Train on the documents outside ``calibrate`` and set the thresholds on those inside.

    ``prior``: share of label 1 among all labelled rows, which the sample need not keep.
    """
    labels = np.asarray(labels, dtype=float)
    fitted = np.flatnonzero(~calibrate)
    empty = ToxicityModel(np.zeros(0, np.uint32), np.zeros((1, DIM)), {}, {}, np.zeros(0), 0.0, np.zeros((1, 0)), [])
    if len(set(labels[fitted])) < 2:
        empty.constant = float(labels.mean()) if len(labels) else 0.0
        return empty
    seen = [np.unique(words[i]) for i in fitted]
    bucket, df = np.unique(np.concatenate(seen), return_counts=True)
    bucket = bucket[(df >= max(4, len(fitted) // 150)) & (bucket > 0)]
    names = sorted({x for x in langs if x is not None})
    profile = _profiles(seen, [langs[i] for i in fitted], bucket, names)

    rng = np.random.default_rng(seed)
    par = {"E": rng.normal(0, 0.1, (len(bucket) + 1, DIM))}
    par["E"][0] = 0
    for k in WIDTHS:
        par[f"W{k}"] = rng.normal(0, 0.3, (k, DIM, FILTERS))
        par[f"b{k}"] = np.zeros(FILTERS)
    par["v"] = rng.normal(0, 0.3, len(WIDTHS) * FILTERS)
    par["c"] = np.zeros(1)
    moment = {n: (np.zeros_like(a), np.zeros_like(a)) for n, a in par.items()}
    model = ToxicityModel(bucket, par["E"], {}, {}, par["v"], 0.0, profile, names)
    rows = [model.rows(words[i]) for i in fitted]
    y = labels[fitted]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            pick = order[s:s + batch]
            grads = _gradients(par, [rows[i] for i in pick], y[pick], weight[pick])
            step += 1
            for n, g in grads.items():
                if n == "E":
                    g[0] = 0
                    par["E"] *= 1 - rate * DECAY
                m, v = moment[n]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                par[n] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.embedding = par["E"].astype(np.float32)
    model.filters = {k: par[f"W{k}"].astype(np.float32) for k in WIDTHS}
    model.bias = {k: par[f"b{k}"] for k in WIDTHS}
    model.weights, model.offset = par["v"], float(par["c"][0])
    share = labels.mean()
    odds = 1.0 if prior is None or not 0 < prior < 1 else (1 - prior) / prior * share / (1 - share)
    _set_thresholds(model, words, labels, np.flatnonzero(calibrate), odds)
    return model


def _gradients(par: dict, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict:
    off = np.concatenate([[0], np.cumsum([max(len(d), 1) for d in docs])])
    rows = np.concatenate([d if len(d) else np.zeros((1, STRIDE), np.int64) for d in docs])
    vec = par["E"][rows].sum(axis=1)
    ends = np.repeat(off[1:], np.diff(off))
    x, best = [], {}
    for k in WIDTHS:
        conv = convolve(vec, off, par[f"W{k}"])
        best[k] = np.stack([off[d] + conv[off[d]:off[d + 1]].argmax(axis=0) for d in range(len(docs))])
        x.append(np.maximum(np.take_along_axis(conv, best[k], axis=0) + par[f"b{k}"], 0))
    x = np.concatenate(x, axis=1)
    z = np.clip(x @ par["v"] + par["c"][0], -30, 30)
    dz = weight * (1 / (1 + np.exp(-z)) - y) / len(docs)
    grads = {"v": x.T @ dz + 1e-4 * par["v"], "c": np.array([dz.sum()]), "E": np.zeros_like(par["E"])}
    for i, k in enumerate(WIDTHS):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        g = dz[:, None] * par["v"][None, part] * (x[:, part] > 0)
        grads[f"b{k}"] = g.sum(axis=0)
        dw = np.zeros_like(par[f"W{k}"])
        for j in range(k):
            at = best[k] + j
            inside = at < ends[best[k]]
            at = np.minimum(at, len(rows) - 1)
            gj = g * inside
            dw[j] = np.einsum("bfd,bf->df", vec[at], gj)
            part_grad = (gj[:, :, None] * par[f"W{k}"][j].T[None]).reshape(-1, 1, DIM)
            np.add.at(grads["E"], rows[at].reshape(-1, STRIDE), part_grad)
        grads[f"W{k}"] = dw
    return grads


def _profiles(seen: list[np.ndarray], langs: list[str | None], bucket: np.ndarray, names: list[str]) -> np.ndarray:
    """0/1 table of the words whose document share in a language most exceeds that elsewhere."""
    share = np.zeros((len(names), len(bucket) + 1))
    for w, lang in zip(seen, langs, strict=True):
        if lang is not None:
            at = np.searchsorted(bucket, w)
            at = at[(at < len(bucket))]
            share[names.index(lang), 1 + at[np.isin(bucket[at], w)]] += 1
    size = np.array([max(1, langs.count(n)) for n in names])
    share /= size[:, None] if len(names) else 1
    out = np.zeros((len(bucket) + 1, len(names)))
    for g in range(len(names)):
        rest = np.delete(share, g, axis=0).max(axis=0) if len(names) > 1 else 0
        gap = share[g] - rest
        top = np.argsort(-gap, kind="stable")[:PROFILE_WORDS]
        out[top[gap[top] > 0], g] = 1
    return out


def _set_thresholds(model: ToxicityModel, words: list[np.ndarray], labels: np.ndarray, inside: np.ndarray, odds: float) -> None:
    """Per language the threshold of best F1 on the calibration rows; pooled where a language has few."""
    model.thresholds = np.full(len(model.languages) + 1, 0.5)
    if not len(inside):
        return
    off = np.concatenate([[0], np.cumsum([len(words[i]) for i in inside])])
    p, lang = model.predict(np.concatenate([words[i] for i in inside]), off)
    y = labels[inside]
    model.thresholds[:] = best_threshold(p, y, odds)
    for g in range(len(model.languages)):
        own = lang == g
        if min(y[own].sum(), (1 - y[own]).sum()) >= 10:
            model.thresholds[g] = best_threshold(p[own], y[own], odds)


def best_threshold(p: np.ndarray, y: np.ndarray, odds: float = 1.0) -> float:
    """Midpoint between neighbouring probabilities with the highest F1 (nearest to 0.5 on ties).

    ``odds``: rows of label 0 that each such row of the sample stands for.
    """
    if y.sum() in (0, len(y)):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (hit + odds * (np.arange(1, len(y) + 1) - hit) + y.sum())
    below = np.append(p[order][1:], 0.0)
    cut = (p[order] + below) / 2
    f1[p[order] == below] = -1
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(np.clip(cut[good[np.argmin(np.abs(cut[good] - 0.5))]], 0.01, 0.99))


# ---------------------------------------------------------------- Spark side

def training_words(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str | None,
                   per_class: int, longest: int, most_words: int) -> DataFrame:
    """(id, label, lang, words) of the bounded sample: ``per_class`` ids of each label, smallest by hash, one row each.

    An id on several rows gives one of its texts (the smallest by hash), whatever their number.
    Texts of more than ``longest`` words stay out; the rest, by hash of the id, count up to ``most_words`` words.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
             .withColumn("h", F.xxhash64("id")))
    pick = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("h", "id").limit(per_class)
        pick = part if pick is None else pick.unionByName(part)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
            .join(F.broadcast(pick), "id")  # at most 2 * per_class ids
            .groupBy("id", "label", "h").agg(F.min(F.struct(F.xxhash64("text"), "text", "lang")).alias("row"))
            .select("id", "label", "h", "row.lang", "row.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text")):
                h, at = hashed_words(data, off)
                words = [h[at[d]:at[d + 1]].tobytes() if at[d + 1] - at[d] <= longest else None for d in range(j - i)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "label", "h", "lang")],
                                                  pa.array(words, pa.binary())], names=["id", "label", "h", "lang", "words"])

    id_type = docs.schema[id_col].dataType.simpleString()
    hashed = stored(rows.mapInArrow(run, f"id {id_type}, label int, h long, lang string, words binary")
                    .where("words IS NOT NULL"), "toxicity-sample")
    sizes = hashed.select("h", "id", F.octet_length("words").alias("n")).orderBy("h", "id").collect()
    fits = np.cumsum([r.n for r in sizes]) <= most_words * STRIDE * 4
    return hashed.where(F.col("id").isin([r.id for r, ok in zip(sizes, fits, strict=True) if ok])).drop("h")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", lang_col: str | None = "lang", per_class: int = 1500,
          longest: int = 20_000, most_words: int = 4_000_000) -> ToxicityModel:
    """Fit on the labelled rows given (leave held-out rows out of ``labels``).

    At most 2 * ``per_class`` documents and ``most_words`` words are read by the fit.  Labels other than
    0 and 1 and null ids do not count, an id with both labels has label 1, an id on several rows gives
    one text; null texts are texts without words.  Without both labels the score is the same for every text.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
    rows = training_words(docs, labels, id_col, text_col, label_col, lang_col, per_class, longest, most_words).collect()
    rows.sort(key=lambda r: (str(r.id), r.words))
    words = [np.frombuffer(r.words, np.uint32).reshape(-1, STRIDE) for r in rows]
    turn = np.arange(len(rows)) % 4 == 3  # a quarter, in id order, sets the thresholds
    model = fit(words, np.array([r.label for r in rows]), [r.lang for r in rows], turn, known)
    del rows, words
    release_memory()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                   carry: bool = False) -> DataFrame:
    """One row per input row: id, score, predicted, probability, language_guess [, row].

    Whole texts are read; null and empty texts get the score of a text without
    words.  Ids pass through (null, repeated); extra columns are ignored whatever
    their names; ``carry`` adds the input row as the struct ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    names = [*model.languages, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(0)):
                s, p, lang = shared.value.score(*hashed_words(data, off))
                arrays = [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(p),
                          pa.array([names[g] for g in lang], pa.string()),
                          *[c.slice(i, j - i) for c in batch.columns[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    cols = [F.col(text_col).alias("text"), F.col(id_col).alias("id")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = docs.select(*cols)
    out_names = ["score", "predicted", "probability", "language_guess", *rows.columns[1:]]
    schema = "score double, predicted int, probability double, language_guess string, id " + \
        docs.schema[id_col].dataType.simpleString()
    if carry:
        schema += ", row " + rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    return out.select(id_col, "score", "predicted", "probability", "language_guess", *(["row"] if carry else []))


def drop_toxic(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    return score_toxicity(docs, model, id_col, text_col, carry=True).where("predicted = 0").select("row.*")
