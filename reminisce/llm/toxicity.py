"""Toxicity grades of texts.

Method: cumulative-link ordinal regression. P(grade > k) = sigmoid(w.x - t_k) with one weight vector w for all
ordered thresholds t_k; x are log counts of words and word beginnings. The output is the expected grade.
Fitting reads a bounded sample of labelled documents; scoring is a map over all documents, with no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reminisce.llm.common import others, words
from reminisce.llm.samples import labelled

GRADES = 4
#: Word beginnings that are features, besides the whole word.
STEMS = (3, 4, 5, 6)
#: A toxic document's grade by how many of its words are marked: 1 up to the first number, 2 up to the second, else 3.
STEPS = (2, 5)


def features_of(word: str) -> list[str]:
    """A word's features: itself, and its beginnings where it is longer."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


@dataclass
class Model:
    """Weights by feature, and ascending thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def grades(self, text: str | None, memo: dict) -> np.ndarray:
        """P(grade > k) for each threshold. memo: word -> its features that have weights, kept by the caller."""
        found: Counter = Counter()
        for word in words(text):
            hits = memo.get(word)
            if hits is None:
                hits = tuple(x for x in features_of(word) if x in self.weights)
                if len(memo) < 200_000:
                    memo[word] = hits
            if hits:
                found.update(hits)
        total = sum(self.weights[k] * np.log1p(n) for k, n in found.items())
        return 1 / (1 + np.exp(-np.clip(total - self.thresholds, -500, 500)))


def _counted(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(words(x)) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("y"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["y", "words", "counts"])

    return sample.select("y", "text").mapInArrow(run, "y double, words array<string>, counts array<int>")


def learn(y: np.ndarray, docs: list[Counter], features: int = 4000, least: int = 3, rounds: int = 400, shrink: float = 1e-4) -> Model:
    """The model from 0/1 labels and counted words.

    Features are those in `least` toxic documents or more with the largest ratio of the two classes' rates. Labels have two
    values only, so a toxic document's grade is taken from how many of its words bear a feature five times as common
    among toxic documents.
    """
    toxic = y >= 0.5
    if not toxic.any() or toxic.all():
        share = float(np.clip(toxic.mean() if len(y) else 0.0, 0.01, 0.99))
        return Model({}, np.log((1 - share) / share) + np.arange(GRADES - 1.0))
    rates: tuple[Counter, Counter] = (Counter(), Counter())
    for is_toxic, doc in zip(toxic, docs, strict=True):
        rates[int(is_toxic)].update({f for w in doc for f in features_of(w)})
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    ratio = {f: (n + 0.1) / n1 / ((rates[0][f] + 0.1) / n0) for f, n in rates[1].items() if n >= least}
    strong = {f for f, r in ratio.items() if r >= 5}
    chosen = sorted(ratio, key=lambda f: (-np.log(ratio[f]) * np.sqrt(rates[1][f]), f))[:features]
    index = {f: i for i, f in enumerate(chosen) if ratio[f] > 1}
    rows, columns, values, grades = [], [], [], np.zeros(len(docs), int)
    for i, doc in enumerate(docs):
        found: Counter = Counter()
        marked = 0
        for w, n in doc.items():
            own = features_of(w)
            for f in own:
                if f in index:
                    found[index[f]] += n
            marked += n * any(f in strong and rates[1][f] >= 0.02 * n1 for f in own)
        if toxic[i]:
            grades[i] = 1 + sum(marked > s for s in STEPS)
        rows += [i] * len(found)
        columns += found
        values += found.values()
    r, c, v = np.array(rows, int), np.array(columns, int), np.log1p(np.array(values, float))
    w, start, gaps = np.zeros(len(index)), 2.0, np.full(GRADES - 2, 1.0)
    moments = [np.zeros(len(w) + GRADES - 1) for _ in range(2)]
    for step in range(1, rounds + 1):
        t = start + np.r_[0, np.cumsum(np.exp(gaps))]
        z = np.bincount(r, v * w[c], len(docs))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -50, 50)))
        # P(grade = k) is the difference of neighbours; the gradient of its logarithm
        full = np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))])
        at = np.arange(len(p))
        mass = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
        slope = full * (1 - full)
        dz = (slope[at, grades] - slope[at, grades + 1]) / mass
        dt = np.zeros_like(p)
        for k in range(GRADES - 1):
            dt[:, k] = np.where(grades == k + 1, -slope[:, k + 1] / mass, 0) + np.where(grades == k, slope[:, k + 1] / mass, 0)
        gt = dt.mean(0)
        # thresholds are a start and positive gaps, so they stay in order
        g = np.r_[np.bincount(c, v * dz[r], len(w)) / len(docs) - shrink * w, gt.sum(), [gt[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)]]
        moments = [0.9 * moments[0] + 0.1 * g, 0.99 * moments[1] + 0.01 * g * g]
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w += move[: len(w)]
        start += move[len(w)]
        gaps += move[len(w) + 1 :]
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, start + np.r_[0, np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000) -> Model:
    """The model, from labels.toxic of up to sample_rows documents that aren't held out; their counted words reach the driver."""
    ys, counted, known = [], [], {}
    for batch in _counted(labelled(docs, labels, "toxic", sample_rows)).toArrow().to_batches():
        for y, w, n in zip(batch.column("y").to_pylist(), batch.column("words"), batch.column("counts"), strict=True):
            ys.append(y)
            counted.append(Counter({known.setdefault(a, a): b for a, b in zip(w.as_py(), n.as_py(), strict=True)}))
    return learn(np.array(ys, float), counted)


def grade(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs with severity (the expected grade, 0 to 3), p_toxic, grade (the likeliest) and toxic, one row for each row.

    Null texts count as empty. Columns of docs stay, but those named as the new ones.
    """
    new = [("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.IntegerType())]
    kept = others(docs, *dict(new))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                over = np.array([model.grades(x, memo) for x in part.column("text").to_pylist()]).reshape(part.num_rows, -1)
                each = np.hstack([np.ones((len(over), 1)), over]) - np.hstack([over, np.zeros((len(over), 1))])
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array(over.sum(1)), pa.array(over[:, 0]), pa.array(each.argmax(1).astype(np.int32)), pa.array((over[:, 0] >= least).astype(np.int32))], schema.names)

    return docs.select(*kept).mapInArrow(run, schema)
