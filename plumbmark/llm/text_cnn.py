"""Toxicity: a convolutional text classifier, trained in numpy.

A word is two hashed embeddings side by side, of the word and of its first `PREFIX` bytes, which words of one
stem share. Convolutions of one, two and three words run over the whole text, each filter's largest value is kept
(max pooling), and a logistic unit weighs these. The first number of an embedding starts as the smoothed
log-odds of its bucket, for a training text taken from the other parts of the training texts only; the others are learned.

The logit is scaled and moved so that a score of 0.7 is the best cut on the training texts. `thresholds` holds a
cut for each language that has enough training texts, 0.7 for others; languages bear on decisions only, never on a score.

Training takes at most `PER_CLASS` whole texts of each label, `MOST_WORDS` words in all, as hashed words, to one task; the driver
gets the model only, which has a fixed size. Texts of more than `LONGEST` words are not learned from. Scoring runs over whole
texts in Arrow batches, two megabytes of text at a time, without a shuffle.

Defined results: null and empty texts score as a text without any word; without both labels in training every score is the
smoothed rate of label 1; rows that repeat get equal scores; other columns of the documents are kept as they are, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbmark.llm.arrow_words import NOT_WORD, release, slices
from plumbmark.llm.labelled import fold, sample
from plumbmark.llm.scratch import bounded_batches, drop, folder, keep, unused
from plumbmark.session import table

WORD_BITS, STEM_BITS, PREFIX = 18, 17, 5
CHANNELS, FILTERS, WIDTHS = 3, 4, (1, 2, 3)
#: The most training texts of label 0 and of label 1.
PER_CLASS = (6000, 4000)
#: The most words of all training texts, and of one; texts are taken whole or not at all.
MOST_WORDS, LONGEST = 8_000_000, 200_000
PARTS, EPOCHS, BATCH, RATE, PRIOR = 4, 6, 32, 0.02, 3.0
CUT = 0.7


@dataclass
class Model:
    word: np.ndarray  # (buckets, channels) embeddings of words and of stems
    stem: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, 2 * channels, filters)
    bias: np.ndarray
    dense: np.ndarray
    offset: float = 0.0
    scale: float = 1.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each width and tap, what a bucket adds to the filters."""
        c = self.word.shape[1]
        return [(w, k, self.word @ self.filters[w][k, :c], self.stem @ self.filters[w][k, c:]) for w in WIDTHS for k in range(w)]

    def logits(self, word: np.ndarray, stem: np.ndarray, bounds: np.ndarray, tables: list) -> np.ndarray:
        """Of texts whose words are word[bounds[i]:bounds[i + 1]]."""
        n, sizes = len(word), np.diff(bounds)
        pooled, at = np.zeros((len(sizes), FILTERS * len(WIDTHS)), np.float32), 0
        full = np.flatnonzero(sizes)
        if len(full):
            left = np.repeat(bounds[1:], sizes) - np.arange(n)  # words from here to the text's end
            for w in WIDTHS:
                z = np.zeros((n, FILTERS), np.float32)
                for _, k, a, b in (t for t in tables if t[0] == w):
                    part = a[word[k:]] + b[stem[k:]]
                    if k:
                        part[left[: n - k] <= k] = 0  # past the end stands nothing
                    z[: n - k] += part
                pooled[full, at : at + FILTERS] = np.maximum.reduceat(z, bounds[:-1][full], axis=0)
                at += FILTERS
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.offset

    def score(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * logits.astype(np.float64), -500, 500)))


def buckets(words) -> tuple[np.ndarray, np.ndarray]:
    return (words.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int32), (words.hashes(PREFIX) >> np.uint64(64 - STEM_BITS)).astype(np.int32)


def _texts_with(ids: np.ndarray, text: np.ndarray, label: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """(parts, 2, size): in how many texts of each part and label a bucket occurs."""
    out = np.zeros((PARTS, 2, size), np.int32)
    for p in range(PARTS):
        own = part[text] == p
        pairs = np.unique(text[own].astype(np.int64) * size + ids[own])
        of, bucket = pairs // size, pairs % size
        for value in (0, 1):
            out[p, value] = np.bincount(bucket[label[of] == value], minlength=size)
    return out


def _log_odds(zeros: np.ndarray, ones: np.ndarray, rate: float) -> np.ndarray:
    """Smoothed log-odds of each bucket, by texts, less those of the labels."""
    rate = float(np.clip(rate, 0.001, 0.999))
    return (np.log((ones + PRIOR * rate) / (zeros + PRIOR * (1 - rate))) - np.log(rate / (1 - rate))).astype(np.float32)


def fit(word: np.ndarray, stem: np.ndarray, sizes: np.ndarray, label: np.ndarray, lang: np.ndarray, rates: tuple[float, float], seed: int = 5) -> Model:
    """rates: how many of all texts of label 0 and 1 are in the sample, to weigh mistakes by."""
    rng = np.random.default_rng(seed)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    d = 2 * CHANNELS
    model = Model(
        rng.normal(0, 0.05, (1 << WORD_BITS, CHANNELS)).astype(np.float32), rng.normal(0, 0.05, (1 << STEM_BITS, CHANNELS)).astype(np.float32),
        {w: rng.normal(0, 0.1, (w, d, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.2, np.float32),
    )
    if len(set(label.tolist())) < 2:
        model.constant = float((label.sum() + 1) / (len(label) + 2))
        return model
    for w in WIDTHS:
        model.filters[w][0, [0, CHANNELS], :] += 0.5  # look for words that speak for label 1
    part = rng.permutation(len(sizes)) % PARTS
    counts = [_texts_with(word, text, label, part, 1 << WORD_BITS), _texts_with(stem, text, label, part, 1 << STEM_BITS)]
    totals = [c.sum(axis=0) for c in counts]
    odds = [[_log_odds(*(t - c[p]), label[part != p].mean() if (part != p).any() else 0.5) for c, t in zip(counts, totals, strict=True)] for p in range(PARTS)]
    model.offset = -1.0
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((label == 0).sum(), 1)) * len(label)
    moments: dict = {}

    def adam(key, value, grad, step, rate=RATE):
        m, v = moments.get(key, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        moments[key] = m, v
        return value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def embedded(docs: np.ndarray):
        where = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in docs]) if len(docs) else np.zeros(0, np.int64)
        p = np.repeat(part[docs], sizes[docs])
        e = np.concatenate([model.word[word[where]], model.stem[stem[where]]], axis=1)
        for q in range(PARTS):
            e[p == q, 0], e[p == q, CHANNELS] = odds[q][0][word[where[p == q]]], odds[q][1][stem[where[p == q]]]
        return where, e, np.concatenate([[0], np.cumsum(sizes[docs])])

    def forward(docs: np.ndarray):
        where, e, b = embedded(docs)
        n, full = len(where), np.flatnonzero(sizes[docs])
        left = np.repeat(b[1:], np.diff(b)) - np.arange(n)
        pooled, best = np.zeros((len(docs), FILTERS * len(WIDTHS)), np.float32), {}
        for i, w in enumerate(WIDTHS):
            if not len(full):
                break
            z = np.zeros((n, FILTERS), np.float32)
            for k in range(w):
                got = e[k:] @ model.filters[w][k]
                if k:
                    got[left[: n - k] <= k] = 0
                z[: n - k] += got
            top = np.maximum.reduceat(z, b[:-1][full], axis=0)
            pooled[full, i * FILTERS : (i + 1) * FILTERS] = top
            same = z == np.repeat(top, np.diff(b)[full], axis=0)
            best[w] = np.stack([np.minimum.reduceat(np.where(same[:, f], np.arange(n), n), b[:-1][full]) for f in range(FILTERS)], axis=1)
        hidden = np.maximum(pooled + model.bias, 0)
        return where, e, left, full, best, hidden, hidden @ model.dense + model.offset

    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(sizes))
        for at in range(0, len(order), BATCH):
            docs, step = order[at : at + BATCH], step + 1
            where, e, left, full, best, hidden, logit = forward(docs)
            wrong = ((1 / (1 + np.exp(-logit)) - label[docs]) * weight[docs] / len(docs)).astype(np.float32)
            back = wrong[:, None] * model.dense * (hidden > 0)
            grads = {w: np.zeros_like(model.filters[w]) for w in WIDTHS}
            for i, w in enumerate(WIDTHS):
                if w not in best:
                    continue
                for f in range(FILTERS):
                    at_word, g = best[w][:, f], back[full, i * FILTERS + f]
                    for k in range(w):
                        ok = left[at_word] > k
                        here = at_word[ok] + k
                        grads[w][k, :, f] += g[ok] @ e[here]
                        push = RATE * g[ok, None] * model.filters[w][k, :, f]
                        np.subtract.at(model.word, (word[where[here]][:, None], np.arange(1, CHANNELS)), push[:, 1:CHANNELS])
                        np.subtract.at(model.stem, (stem[where[here]][:, None], np.arange(1, CHANNELS)), push[:, CHANNELS + 1 :])
            dense = adam("dense", model.dense, hidden.T @ wrong, step)
            model.bias = adam("bias", model.bias, back.sum(0), step).astype(np.float32)
            model.offset = float(adam("offset", model.offset, wrong.sum(), step))
            model.dense = np.maximum(dense, 0).astype(np.float32)
            for w in WIDTHS:
                model.filters[w] = adam(w, model.filters[w], grads[w] + 1e-4 * model.filters[w], step).astype(np.float32)
    logit = np.concatenate([forward(np.arange(at, min(at + BATCH, len(sizes))))[-1] for at in range(0, len(sizes), BATCH)])
    real = np.where(label == 1, 1 / max(rates[1], 1e-9), 1 / max(rates[0], 1e-9))
    cut = best_cut(logit, label, real)
    model.offset -= cut
    spread = np.median(np.abs(logit - cut)) or 1.0
    model.scale = float(3.0 / spread)
    model.offset += float(np.log(CUT / (1 - CUT))) / model.scale
    scores = model.score(logit - cut + np.log(CUT / (1 - CUT)) / model.scale)
    for name in sorted({x for x in lang.tolist() if x is not None}):
        own = lang == name
        if label[own].sum() >= 30 and (label[own] == 0).sum() >= 30:
            model.thresholds[name] = float(np.clip(best_cut(scores[own], label[own], real[own]), 0.5, 0.9))
    model.word[:, 0], model.stem[:, 0] = (_log_odds(*t, label.mean()) for t in totals)
    return model


def best_cut(value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The cut of largest F1, halfway between the two values that it parts."""
    order = np.argsort(-value, kind="stable")
    v, hit, all_ = value[order], np.cumsum((label * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (label * weight).sum())
    f1[:-1][v[:-1] == v[1:]] = -1
    k = int(np.argmax(f1))
    return float((v[k] + v[k + 1]) / 2 if k + 1 < len(v) else v[k] - 1e-6)


def _untrained() -> Model:
    """The model without any training text: each score is one half."""
    zeros = lambda *shape: np.zeros(shape, np.float32)
    k = FILTERS * len(WIDTHS)
    return Model(zeros(1 << WORD_BITS, CHANNELS), zeros(1 << STEM_BITS, CHANNELS), {w: zeros(w, 2 * CHANNELS, FILTERS) for w in WIDTHS}, zeros(k), zeros(k), constant=0.5)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", may_train=None, per_class: tuple[int, int] = PER_CLASS) -> Model:
    """may_train: which doc_ids' labels may be used (all, if None)."""
    may = F.lit(True) if may_train is None else may_train
    picked = sample(docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else [])), labels, label, may, per_class)
    if "lang" not in picked.columns:
        picked = picked.withColumn("lang", F.lit(None).cast("string"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in slices(batch.column(1), NOT_WORD):
                a, b = buckets(words)
                cut = lambda x, w=words: pa.array([x[i:j].tobytes() for i, j in zip(w.bounds[:-1], w.bounds[1:], strict=True)], pa.binary())
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), cut(a), cut(b), part.column(2), part.column(3), pa.array(np.diff(words.bounds).astype(np.int64))], names=["doc_id", "word", "stem", "label", "lang", "n"])

    spark = docs.sparkSession
    bounded_batches(spark)
    path = folder(spark)
    rows = keep(picked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label", "lang").mapInArrow(hashed, "doc_id long, word binary, stem binary, label int, lang string, n long"), path, "sample").where(F.col("n") <= LONGEST)
    # of a sample beyond the bound, the texts whose hashed ids come first; the window sees numbers only
    until = rows.select("doc_id", F.sum("n").over(Window.orderBy(F.xxhash64(F.lit("words"), "doc_id"), "doc_id")).alias("until")).where(F.col("until") <= MOST_WORDS).select("doc_id").distinct()
    totals = {r[0]: r[1] for r in labels.where(F.col(label).isNotNull() & may).groupBy(F.col(label).cast("int")).count().collect()}

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, small = {"word": [], "stem": []}, []
        for batch in batches:
            for name, held in parts.items():
                held += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(name)]
            small.append(batch.select(["doc_id", "label", "lang"]))
        if not any(b.num_rows for b in small):
            return
        ids, label_of, lang = ([x for b in small for x in b.column(c).to_pylist()] for c in ("doc_id", "label", "lang"))
        sizes = np.array([len(x) for x in parts["word"]], np.int64)
        # the same order whatever the order the rows came in
        order = np.lexsort((sizes, np.array(ids, np.int64)))
        label_of = np.array(label_of, np.int64)[order]
        word, stem = (np.concatenate([held[i] for i in order]) for held in parts.values())
        parts.clear()
        rates = tuple(min(1.0, max((label_of == v).sum(), 1) / max(totals.get(v, 1), 1)) for v in (0, 1))
        model = fit(word, stem, sizes[order], label_of, np.array(lang, object)[order], rates)
        del word, stem
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        release()

    found = rows.join(F.broadcast(until), "doc_id", "left_semi").drop("n").repartition(1).mapInArrow(fitted, "model binary").first()
    drop(spark, path, "sample")
    return pickle.loads(found["model"]) if found else _untrained()


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with the score of each whole text, in a column called name, which docs doesn't have."""
    bounded_batches(docs.sparkSession)
    columns = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    column = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables()
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, words in slices(batch.column(column), NOT_WORD):
                out.append(own.score(own.logits(*buckets(words), words.bounds, tables)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out), pa.float64())], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType(), False)]))


def threshold(model: Model, lang) -> F.Column:
    out = F.lit(CUT)
    for name, cut in sorted(model.thresholds.items()):
        out = F.when(lang == name, cut).otherwise(out)
    return out


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier lets pass: a score below their language's threshold."""
    name = unused(docs, "toxicity")
    passed = score(docs, model, name=name)
    cut = threshold(model, F.col("lang")) if "lang" in docs.columns else F.lit(CUT)
    return passed.where(F.col(name) < cut).select(*[f"`{c}`" for c in docs.columns])


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = train(docs, table(spark, sf_dir, "labels"), may_train=~held)
    scored = score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"), threshold(model, F.col("lang")).alias("threshold"))


QUERIES = {"op3_toxicity_cnn": op3_toxicity_cnn}
ORACLES: dict[str, str] = {}
