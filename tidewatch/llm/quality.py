"""Quality by regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics (``STATISTICS``; logarithms and
logits, so that they spread like normal variables). Per class, Spark adds up counts,
sums and cross products of the labelled rows, which fixes mean and covariance; the
covariance is shrunk towards the pooled one and towards its own mean variance, and its
Cholesky factor is computed once and kept in the model. A score is the posterior of
class 1 from the difference of the two Mahalanobis log densities and the class shares.

Defined cases: a null text is empty and gets the score of the empty text's statistics;
labels that are null, or of documents that are not there, teach nothing; a doc_id with
several labels or rows teaches once per pair; with labels of one class or none only,
the score is the share of class 1 (0.5 without labels); an empty table gives no rows.
Language, source and doc_id are never looked at. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import column, held_out, map_batches, text_list, texts_of
from tidewatch.session import materialize

STATISTICS = (
    "chars", "words", "word_length", "word_spread", "distinct", "top_word", "repeated_neighbour",
    "digits", "letters", "upper", "symbols", "line_words", "stop_marks", "short_words", "distinct_lines",
)
SHRINK_POOLED = 0.05
SHRINK_DIAGONAL = 0.05
THRESHOLD = 0.3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


# Usual values of the statistics, worth PRIOR_CHARS characters or PRIOR_WORDS words: a
# short text stays near them, as a few words say little about a share.
PRIOR_CHARS, PRIOR_WORDS, PRIOR_LINES = 100, 20, 2


def _logit(hits: float, n: float, usual: float, weight: float) -> float:
    """Log odds of hits among n, smoothed towards the usual share."""
    return math.log((hits + weight * usual) / (n - hits + weight * (1 - usual)))


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    kinds = Counter(words)
    lines = raw.split(b"\n")
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    letters, upper = int(counts[_LETTER].sum()), int(counts[_UPPER].sum())
    digits, stops = int(counts[_DIGIT].sum()), int(counts[_STOP].sum())
    symbols = size - letters - digits - stops - int(counts[_SPACE].sum())
    mean = (float(lengths.sum()) + 6.0 * PRIOR_WORDS) / (n + PRIOR_WORDS)
    spread = (float(((lengths - mean) ** 2).sum()) + 12.0 * PRIOR_WORDS) / (n + PRIOR_WORDS)
    per_char = lambda hits, usual: _logit(hits, size, usual, PRIOR_CHARS)
    per_word = lambda hits, usual: _logit(hits, n, usual, PRIOR_WORDS)
    return [
        math.log(size + PRIOR_CHARS),
        math.log(n + PRIOR_WORDS),
        math.log(mean),
        math.log(spread),
        per_word(len(kinds), 0.9),
        per_word(max(kinds.values(), default=0), 0.05),
        per_word(again, 0.003),
        per_char(digits, 0.003),
        per_char(letters, 0.8),
        per_char(upper, 0.02),
        per_char(symbols, 0.003),
        math.log((n + PRIOR_WORDS) / (len(lines) + 1)),
        per_char(stops, 0.025),
        per_word(float((lengths <= 3).sum()), 0.35),
        _logit(len(set(lines)), len(lines), 0.97, PRIOR_LINES),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x (the statistics)."""
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": column(batch, "doc_id"), "x": [statistics(t) for t in text_list(batch)]}

        return step

    return map_batches(texts_of(docs), "doc_id long, x array<double>", make)


@dataclass(frozen=True)
class Model:
    """Log shares, means and Cholesky factors by class; empty if nothing was learnt."""

    share: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * np.sum(z * z, axis=0) - np.sum(np.log(np.diag(factor))))
        odds = logs[1] - logs[0] + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(labelled: DataFrame, pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> Model:
    """``labelled``: x, label (0 or 1). What reaches the driver is one row of sums per
    class and task that Spark has added up: d * d numbers per class."""
    d = len(STATISTICS)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            x = np.array(column(batch, "x").to_pylist(), dtype=np.float64).reshape(-1, d)
            label = column(batch, "label").to_numpy()
            out: dict[str, list] = {"label": [], "cell": [], "value": []}
            for c in (0, 1):
                rows = x[label == c]
                sums = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
                out["label"] += [c] * len(sums)
                out["cell"] += range(len(sums))
                out["value"] += sums.tolist()
            return out

        return step

    parts = map_batches(labelled.select("x", "label"), "label int, cell int, value double", make)
    sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for r in parts.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():
        sums[r["label"]][r["cell"]] = r["value"]
    n = [sums[c][0] for c in (0, 1)]
    if min(n) < 2:
        return Model(n[1] / sum(n) if sum(n) else 0.5)
    means, spreads = [], []
    for c in (0, 1):
        mean = sums[c][1 : 1 + d] / n[c]
        means.append(mean)
        spreads.append(sums[c][1 + d :].reshape(d, d) / n[c] - np.outer(mean, mean))
    both = sum(w * s for w, s in zip(n, spreads, strict=True)) / sum(n)
    factors = []
    for spread in spreads:
        shrunk = (1 - pooled) * spread + pooled * both
        own = np.trace(shrunk) / d
        factors.append(np.linalg.cholesky(
            (1 - diagonal) * shrunk + diagonal * own * np.eye(d) + 1e-9 * np.eye(d)))
    return Model(n[1] / sum(n), tuple(means), tuple(factors))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, rest: int = 0,
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted. Labelled rows in the held-out fold teach
    nothing."""
    found = materialize(features(docs), "quality-statistics")
    return apply(found, learn(found, labels, label, modulus, rest), threshold).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id"), modulus, rest), F.lit(False)).alias("held_out"),
        "score", "predicted",
    )


def learn(found: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, rest: int = 0) -> Model:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, rest))
    return fit(found.join(marks, "doc_id"))


def apply(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    d = len(STATISTICS)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            x = np.array(column(batch, "x").to_pylist(), dtype=np.float64).reshape(-1, d)
            values = model.score(x)
            return {"doc_id": column(batch, "doc_id"), "score": values,
                    "predicted": (values >= threshold).astype(np.int32)}

        return step

    return map_batches(found.select("doc_id", "x"), "doc_id long, score double, predicted int", make)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t or "") for t in batch.column(place).to_pylist()])
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
