"""Severity of toxic language by cumulative-link (proportional odds) regression.

P(grade > j) = sigmoid(w * x - t_j) with one weight vector w for all ordered
thresholds t_0 <= t_1 <= ...; x holds sparse features of a text (words,
1 + log of their count). The result is the expected
severity, the sum of these probabilities.

``fit`` takes any number of ordered grades. The labels here know clean and toxic only,
so ``score`` learns in two passes: a first fit on the two grades gives weights; the
toxic rows of the sample are then graded by thirds of their weighted evidence (mild,
medium, severe), and the final fit orders the four grades with shared weights.

The fit uses a bounded sample of the labelled texts (``SAMPLE_PER_CLASS`` per class, those
with the smallest hash) and the ``FEATURES`` words that tell the classes
apart best in it (with a chi-squared of ``LEAST_STRENGTH`` at least), so what reaches the driver is bounded. Everything else covers all rows.
All labelled texts are counted, and a sampled one stands for as many as its class has
per sampled text: in the fit, and in the words' strength.

Defined cases: a null text is empty and has no features; labels that are null or of
absent documents teach nothing; equal texts of a class teach once; with one class
or no labels every text gets that class's severity (0 without labels); an empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import column, held_out, map_batches, text_list, texts_of
from tidewatch.session import materialize

SAMPLE_PER_CLASS = 10_000
FEATURES = 2_000
LEAST_DOCUMENTS = 4
LEAST_STRENGTH = 15.0  # of a word's chi-squared against the class shares
RIDGE = 1.0
ROUNDS = 300
GRADES = 3  # of toxic rows

_MARKS = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")


PREFIX = 6


def words(text: str) -> Counter:
    """Counts of lower-cased words without punctuation around them, and of the first
    ``PREFIX`` bytes of words that are as long, which inflected forms share."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    counts: Counter = Counter()
    for word, n in Counter(raw.split()).items():
        bare = _MARKS.sub(b"", word)
        if bare:
            counts[bare] += n
        if len(bare) >= PREFIX:
            counts[b"<" + bare[:PREFIX]] += n
    return counts


@dataclass
class Model:
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float = 0.0

    def margin(self, counts: Counter) -> float:
        total = 0.0
        for word, n in counts.items():
            at = self.vocabulary.get(word)
            if at is not None:
                total += self.weights[at] * (1 + np.log(n))
        return total

    def above(self, margin: float) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        return 1 / (1 + np.exp(-np.clip(margin - self.thresholds, -500, 500)))


def fit(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, width: int,
        ridge: float = RIDGE, rounds: int = ROUNDS, stands_for: np.ndarray | None = None,
        ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model: penalised likelihood by
    gradient steps with a momentum, thresholds kept in order by positive gaps. A row
    counts ``stands_for`` times (once by default)."""
    times = np.ones(len(grades)) if stands_for is None else stands_for
    levels = int(grades.max()) + 1
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    value = np.concatenate(values) if values else np.zeros(0)
    shares = np.array([times[grades > j].sum() / times.sum() for j in range(levels - 1)])
    cuts = -np.log(shares / (1 - shares))
    first, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))
    theta = np.concatenate([np.zeros(width), [first], gaps])
    n, speed, square = len(grades), np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, steps = theta[:width], np.exp(theta[width + 1 :])
        cut = np.concatenate([[theta[width]], theta[width] + np.cumsum(steps)])
        margin = np.bincount(where, weights=w[index] * value, minlength=n)
        up = 1 / (1 + np.exp(-np.clip(margin[:, None] - cut[None, :], -500, 500)))
        padded = np.hstack([np.ones((n, 1)), up, np.zeros((n, 1))])
        at = np.arange(n)
        prob = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))])
        per = times / prob
        d_margin = -(slope[at, grades] - slope[at, grades + 1]) * per
        d_cut = np.zeros((n, levels + 1))
        d_cut[at, grades] += slope[at, grades] * per
        d_cut[at, grades + 1] -= slope[at, grades + 1] * per
        to_cut = d_cut.sum(axis=0)[1:-1]
        later = np.cumsum(to_cut[::-1])[::-1]
        grad = np.concatenate([
            np.bincount(index, weights=d_margin[where] * value, minlength=width) + ridge * w,
            [later[0]], later[1:] * steps,
        ]) / times.sum()
        speed = 0.9 * speed + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta = theta - 0.05 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    cut = np.concatenate([[theta[width]], theta[width] + np.cumsum(np.exp(theta[width + 1 :]))])
    return theta[:width], cut


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int) -> DataFrame:
    """label, same (a hash of the text), doc_id of each distinct text to learn from."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
        .dropDuplicates(["doc_id"])
    )
    hashed = texts_of(docs).select("doc_id", F.xxhash64("text").alias("same"))
    return hashed.join(marks, "doc_id").groupBy("label", "same").agg(F.min("doc_id").alias("doc_id"))


def sample(docs: DataFrame, marks: DataFrame, per_class: int) -> DataFrame:
    """text, label of the fit; at most ``per_class`` texts a class of ``labelled``."""
    chosen = None
    for c in (0, 1):
        part = marks.where(F.col("label") == c).orderBy(F.xxhash64("same"), "same").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    # at most 2 * per_class rows
    texts = texts_of(docs).withColumn("same", F.xxhash64("text"))
    return texts.join(F.broadcast(chosen), ["doc_id", "same"]).select("text", "label")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, rest: int = 0,
          per_class: int = SAMPLE_PER_CLASS, features: int = FEATURES) -> Model:
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"word": [], "n": []}
            for text in text_list(batch):
                counts = words(text)
                out["word"].append(list(counts))
                out["n"].append(list(counts.values()))
            return out | {"label": column(batch, "label")}

        return step

    marks = materialize(labelled(docs, labels, label, modulus, rest), "toxic-labels")
    whole = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = sample(docs, marks, per_class).withColumn(
        "twin", F.row_number().over(Window.partitionBy(F.xxhash64("text"), "label").orderBy(F.length("text")))
    ).where("twin = 1")
    bags = materialize(
        map_batches(rows.select("text", "label"), "label int, word array<binary>, n array<int>", make), "toxic-words"
    )
    sizes = {r["label"]: r["n"] for r in bags.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(constant=float(1 in sizes) * GRADES)
    times = {c: whole[c] / sizes[c] for c in sizes}
    one = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    seen = (
        bags.select("label", F.explode("word").alias("word")).groupBy("word")
        .agg(one.alias("a"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
        .select("word", (F.col("a") * times[1]).alias("a"),
                (F.col("a") * times[1] + (F.col("n") - F.col("a")) * times[0]).alias("n"))
    )
    share = whole[1] / (whole[0] + whole[1])
    # squared standardised difference from the class share; counts of a sample vary more
    spread = share * (1 - share) * (times[1] * (1 - share) + times[0] * share)
    strength = (F.col("a") - F.col("n") * share) ** 2 / (F.col("n") * spread)
    best = seen.where(strength >= LEAST_STRENGTH).orderBy(F.desc(strength), "word").limit(features).collect()
    vocabulary = {bytes(r["word"]): i for i, r in enumerate(best)}

    def narrow():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"at": [], "n": []}
            for found, n in zip(column(batch, "word").to_pylist(), column(batch, "n").to_pylist(), strict=True):
                hits = [(vocabulary[w], c) for w, c in zip(found, n, strict=True) if w in vocabulary]
                out["at"].append([a for a, _ in hits])
                out["n"].append([c for _, c in hits])
            return out | {"label": column(batch, "label")}

        return step

    kept = map_batches(bags, "label int, at array<int>, n array<int>", narrow).collect()
    kept.sort(key=lambda r: (r["label"], r["at"], r["n"]))
    index = [np.array(r["at"], dtype=np.int64) for r in kept]
    value = [1 + np.log(np.array(r["n"], dtype=np.float64)) for r in kept]
    label_of = np.array([r["label"] for r in kept])
    stands_for = np.array([times[c] for c in label_of])
    weights, _ = fit(index, value, label_of, len(vocabulary), stands_for=stands_for)
    evidence = np.array([float(weights[i] @ v) for i, v in zip(index, value, strict=True)])
    edges = np.quantile(evidence[label_of == 1], [g / GRADES for g in range(1, GRADES)])
    grades = np.where(label_of == 1, 1 + np.searchsorted(edges, evidence, side="right"), 0)
    levels, grades = np.unique(grades, return_inverse=True)
    weights, thresholds = fit(index, value, grades, len(vocabulary), stands_for=stands_for)
    return Model(vocabulary, weights, thresholds)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, rest: int = 0,
          per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, severity (0 to the highest grade), p_toxic (of a grade above
    clean), grade (the likeliest), toxic (p_toxic >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, modulus, rest, per_class))

    def make():
        model: Model = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("severity", "p_toxic", "grade", "toxic")}
            for text in text_list(batch):
                if len(model.thresholds):
                    above = model.above(model.margin(words(text)))
                    p = -np.diff(np.concatenate([[1.0], above, [0.0]]))
                    row = (float(above.sum()), float(above[0]), int(p.argmax()))
                else:
                    row = (model.constant, float(model.constant > 0), int(model.constant))
                for name, v in zip(("severity", "p_toxic", "grade"), row, strict=True):
                    out[name].append(v)
                out["toxic"].append(int(row[1] >= 0.5))
            return out | {"doc_id": column(batch, "doc_id")}

        return step

    found = map_batches(texts_of(docs), "doc_id long, severity double, p_toxic double, grade int, toxic int", make)
    fold = F.coalesce(held_out(F.col("doc_id"), modulus, rest), F.lit(False)).alias("held_out")
    return found.select("doc_id", fold, "severity", "p_toxic", "grade", "toxic")
