"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Small gradient-boosted trees are grown in numpy over the statistics of labelled texts. Every path from a root to a node is a
rule, a conjunction of comparisons. A logistic regression with an L1 penalty weighs the rules, and with them the
statistics themselves, clipped and scaled; the penalty is the one that does best on a part of the training texts. What
keeps a weight is compiled into one Spark column expression over the statistics.

The statistics (`STATISTICS`) are computed over whole texts from Arrow batches, without a shuffle. Training takes
at most `PER_CLASS` texts of each label; only their statistics reach the driver.

Defined results: null and empty texts have statistics of 0 and get a score; without both labels in training every score
is the smoothed rate of label 1; rows that repeat get equal scores; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbmark.llm.arrow_words import SPACES, mix, slices
from plumbmark.llm.labelled import fold, sample
from plumbmark.session import table

#: The most training texts of label 0 and of label 1.
PER_CLASS = (5000, 10000)
TREES, DEPTH, SHRINK, CUTS, PENALTIES = 40, 3, 0.3, 32, (0.0003, 0.001, 0.003, 0.01)
CUT = 0.3

_LETTERS = np.zeros(256, np.int8)
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?", "bang": b"!", "pipe": b"|", "sign": b"#$%&*+-/<=>@[]^_{}~\\", "quote": b"\"'()`", "line": b"\n"}
for _i, _signs in enumerate(_CLASSES.values(), 1):
    _LETTERS[list(_signs)] = _i
#: What a text is judged by.
STATISTICS = ["chars_log", "words_log", "word_mean", "word_max_log", *[f"{c}_rate" for c in _CLASSES], "high_rate", "distinct_rate", "repeat_rate", "top_rate", "line_words_log", "sign_words_rate", "upper_words_rate", "short_words_rate"]


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over texts."""
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def statistics(words) -> np.ndarray:
    """(texts, statistics) of a slice."""
    n_bytes, n_words = np.diff(words.offsets).astype(np.float64), np.diff(words.bounds).astype(np.float64)
    some, any_words = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    kinds = _LETTERS[words.data]
    rates = [_per(kinds == i, words.offsets) / some for i in range(1, len(_CLASSES) + 1)]
    high = _per(words.data >= 128, words.offsets) / some
    sizes, hashes, text = words.ends - words.starts, words.hashes(), words.text_of()
    longest = np.zeros(len(n_words))
    full = np.flatnonzero(n_words)
    if len(full):
        longest[full] = np.maximum.reduceat(sizes, words.bounds[:-1][full])
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    # one number for a word of a text, so that a sort brings equal ones together
    own = np.sort(mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1))) >> np.uint64(24) | text.astype(np.uint64) << np.uint64(40)) if len(hashes) else hashes
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    runs, of = np.diff(np.concatenate([starts, [len(own)]])), (own[starts] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(of, minlength=len(n_words)).astype(np.float64)
    top = np.zeros(len(n_words))
    np.maximum.at(top, of, runs)
    last = words.data[words.ends - 1] if len(sizes) else np.zeros(0, np.uint8)
    sign = (_LETTERS[last] == 7) | (_LETTERS[last] == 5) | (_LETTERS[last] == 6)
    tail = np.maximum(words.ends - 2, words.starts) if len(sizes) else words.ends
    upper = (_LETTERS[words.data[tail]] == 1) & (_LETTERS[words.data[words.starts]] == 1) & (sizes > 1) if len(sizes) else np.zeros(0, bool)
    lines = np.maximum(rates[8] * some, 0) + 1
    cols = [np.log1p(n_bytes), np.log1p(n_words), n_bytes / any_words, np.log1p(longest), *rates, high, distinct / any_words, _per(again, words.bounds) / any_words, top / any_words, np.log1p(n_words / lines), _per(sign, words.bounds) / any_words, _per(upper, words.bounds) / any_words, _per(sizes <= 3, words.bounds) / any_words]
    return np.round(np.stack(cols, axis=1), 6)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with a column for each statistic."""
    keep = [c for c in docs.columns if c != text and c not in STATISTICS]
    docs = docs.select(F.col(text).alias("_text"), *[f"`{c}`" for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((0, len(STATISTICS)))] + [statistics(words) for _, _, words in slices(batch.column(0), SPACES)]
            found = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(found[:, j]) for j in range(len(STATISTICS))]], names=[*keep, *STATISTICS])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[1:], *[T.StructField(s, T.DoubleType(), False) for s in STATISTICS]]))


#: A comparison: statistic, value, True for at most the value, False for above it.
Rule = tuple[tuple[int, float, bool], ...]


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    linear: list[tuple[int, float, float, float]]  # statistic, low, high, weight of its place between them
    offset: float
    constant: float | None = None

    def column(self) -> Column:
        """The score, from columns named like the statistics."""
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.offset)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for j, value, at_most in rule:
                test = test & ((F.col(STATISTICS[j]) <= value) if at_most else (F.col(STATISTICS[j]) > value))
            total = total + F.when(test, weight).otherwise(0.0)
        for j, low, high, weight in self.linear:
            total = total + (F.least(F.greatest(F.col(STATISTICS[j]), F.lit(low)), F.lit(high)) - low) / (high - low) * weight
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, value, at_most in rule:
        out &= (x[:, j] <= value) if at_most else (x[:, j] > value)
    return out


def _grow(x, codes, cuts, gradient, hessian, rows, path, depth, found, step):
    """Splits rows where that lowers the loss most; gives every node's rule to found and its value to step."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        for j in range(x.shape[1]):
            if len(cuts[j]) == 0:
                continue
            size = len(cuts[j]) + 1
            left_g, left_h = (np.cumsum(np.bincount(codes[rows, j], v[rows], size))[:-1] for v in (gradient, hessian))
            number = np.cumsum(np.bincount(codes[rows, j], minlength=size))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            gain[(number < 5) | (len(rows) - number < 5)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if path:
        found.append(path)
    if best[1] is None:
        step[rows] = -SHRINK * g / (h + 1)
        return
    j, k = best[1]
    under = codes[rows, j] <= k
    for side, at_most in ((rows[under], True), (rows[~under], False)):
        _grow(x, codes, cuts, gradient, hessian, side, (*path, (j, float(cuts[j][k]), at_most)), depth - 1, found, step)


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[Rule]:
    """The distinct rules of boosted trees, each tree grown from half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(x.shape[1])], axis=1)
    total, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        rows = np.sort(rng.permutation(len(y))[: max(40, len(y) // 2)]) if len(y) > 200 else np.arange(len(y))
        step, paths = np.zeros(len(y)), []
        _grow(x, codes, cuts, p - y, p * (1 - p), rows, (), DEPTH, paths, step)
        found += paths
        total += step
    seen: dict[bytes, Rule] = {}
    for rule in found:
        holds = _holds(rule, x)
        if 0.002 * len(y) <= holds.sum() <= 0.998 * len(y):
            seen.setdefault(np.packbits(holds if holds[0] else ~holds).tobytes(), rule)
    return list(seen.values())


def lasso(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n = weight.sum()
    scale = 0.25 * np.linalg.norm(np.sqrt(weight)[:, None] * np.column_stack([x, np.ones(len(x))]), 2) ** 2 / n + 1e-9
    w, b = np.zeros(x.shape[1]), float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    wz, bz, t = w, b, 1.0
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-(x @ wz + bz))) - y) / n
        new = wz - x.T @ error / scale
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / scale, 0)
        offset, t_new = bz - error.sum() / scale, (1 + np.sqrt(1 + 4 * t * t)) / 2
        wz, bz = new + (t - 1) / t_new * (new - w), offset + (t - 1) / t_new * (offset - b)
        w, b, t = new, offset, t_new
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray, rates: tuple[float, float] = (1.0, 1.0)) -> Ensemble:
    """rates: the part of all texts of label 0 and 1 that x holds."""
    if len(set(y.tolist())) < 2:
        return Ensemble([], [], [], 0.0, float((y.sum() + 1) / (len(y) + 2)))
    rules = grow_rules(x, y)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    use = np.flatnonzero(high > low)
    place = (np.clip(x[:, use], low[use], high[use]) - low[use]) / (high[use] - low[use])
    design = np.column_stack([*[_holds(r, x).astype(np.float64) for r in rules], 0.4 * place])
    weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])
    check = np.arange(len(y)) % 4 == 0
    losses = []
    for penalty in PENALTIES:
        w, b = lasso(design[~check], y[~check], weight[~check], penalty)
        z = design[check] @ w + b
        losses.append((weight[check] * np.logaddexp(0, np.where(y[check] == 1, -z, z))).sum())
    w, b = lasso(design, y, weight, PENALTIES[int(np.argmin(losses))], 600)
    kept = [i for i in range(len(rules)) if abs(w[i]) > 1e-4]
    line = [(int(use[i]), float(low[use[i]]), float(high[use[i]]), float(0.4 * v)) for i, v in enumerate(w[len(rules) :]) if abs(v) > 1e-4]
    return Ensemble([rules[i] for i in kept], [float(w[i]) for i in kept], line, b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", may_train: Column | None = None, per_class: tuple[int, int] = PER_CLASS) -> Ensemble:
    """may_train: which doc_ids' labels may be used (all, if None)."""
    may = F.lit(True) if may_train is None else may_train
    rows = with_statistics(sample(docs.select("doc_id", "text"), labels, label, may, per_class)).toArrow().sort_by("doc_id")
    y = rows["label"].to_numpy().astype(np.float64)
    x = np.stack([rows[s].to_numpy() for s in STATISTICS], axis=1) if len(y) else np.zeros((0, len(STATISTICS)))
    totals = {r[0]: r[1] for r in labels.where(F.col(label).isNotNull() & may).groupBy(F.col(label).cast("int")).count().collect()}
    return fit(x, y, tuple(min(1.0, max((y == v).sum(), 1) / max(totals.get(v, 1), 1)) for v in (0, 1)))


def score(docs: DataFrame, ensemble: Ensemble, name: str = "quality") -> DataFrame:
    """docs without the text, with the score in a column called name, which docs doesn't have. Other columns stay, whatever their names."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return with_statistics(docs.select("text", others.alias("_others"))).select("_others.*", ensemble.column().alias(name))


def op1_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5) == 0
    ensemble = train(docs, table(spark, sf_dir, "labels"), may_train=~held)
    return score(docs, ensemble).select("doc_id", held.alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op1_rule_ensemble_quality": op1_rule_ensemble_quality}
ORACLES: dict[str, str] = {}
