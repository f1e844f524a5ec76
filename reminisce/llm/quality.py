"""Quality classifier over document statistics.

Method: random Fourier features approximate a Gaussian kernel over standardised statistics of a text; each partition
sums its normal equations, whose total gives ridge scores; isotonic regression on rows kept apart calibrates them.
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

from reminisce.llm.common import cut, fresh, others
from reminisce.llm.samples import held_out, labelled

#: Bins of the raw score, 0.001 wide, from -1 to 2.
BINS, LOW, HIGH = 3000, -1.0, 2.0
#: The least score of a document that is kept.
LEAST = 0.3
PLAIN = frozenset(".,;:?!'\"()-")


def statistics(text: str | None) -> list[float]:
    """What a text looks like, whatever its language; all zero for an empty one."""
    text = text or ""
    tokens = text.split()
    if not tokens:
        return [0.0] * 18
    n, size = len(tokens), len(text)
    counts = Counter(tokens)
    ascii_counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower = int(ascii_counts[65:91].sum()), int(ascii_counts[97:123].sum())
    plain = sum(int(ascii_counts[ord(c)]) for c in PLAIN)
    symbols = int(ascii_counts[33:48].sum() + ascii_counts[58:65].sum() + ascii_counts[91:97].sum() + ascii_counts[123:127].sum()) - plain
    pairs = list(zip(tokens, tokens[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    bare = sum(1 for x in tokens if not x[-1].isalnum() and x[-1] not in PLAIN)
    return [
        np.log1p(n), size / n, symbols / size, upper / (upper + lower + 1), int(ascii_counts[48:58].sum()) / size,
        len(counts) / n, sum(a == b for a, b in pairs) / n, len(set(pairs)) / n, max(counts.values()) / n, plain / n,
        int(ascii_counts[ord("|")]) / n, int(ascii_counts[ord("!")]) / n, bare / n, int(ascii_counts[128:].sum()) / size,
        np.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), sum(len(x) <= 2 for x in tokens) / n,
    ]


@dataclass
class Model:
    """Standardisation, random directions, ridge weights and the calibration's corners."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    corners: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        z = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.corners, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the non-decreasing fit to means y with counts n at ascending x: pooled neighbours that violate the order."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([a / c for a, _, c in blocks]), np.array([b / c for _, b, c in blocks])


def _featurise(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("calibrates"), batch.column("y"), pa.array(found, pa.list_(pa.float64()))], ["calibrates", "y", "x"])

    return sample.withColumn("calibrates", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4).select("calibrates", "y", "text").mapInArrow(run, "calibrates boolean, y double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, features: int = 256, ridge: float = 1e-4, width: float = 1.0, seed: int = 11) -> Model:
    """The model, from labels.quality of rows whose id isn't held out.

    sample_rows bounds the labelled sample. Of its rows, those whose crc32 of the id leaves 4 mod 5 calibrate and the
    others give the ridge weights. width is the kernel's, in units of the square root of the statistics' number.
    Without labelled rows every score is 0.5.
    """
    d = len(statistics(""))
    table = cut(_featurise(labelled(docs, labels, "quality", sample_rows)), "quality-sample")
    train, rest = table.filter("not calibrates"), table.filter("calibrates")
    summed = train.select(F.count(F.lit(1)).alias("n"), *(f(F.element_at("x", i + 1) ** p).alias(f"{k}{i}") for k, f, p in (("m", F.avg, 1), ("s", F.avg, 2)) for i in range(d))).first()
    rng = np.random.default_rng(seed)
    mean = np.array([summed[f"m{i}"] or 0.0 for i in range(d)])
    square = np.array([summed[f"s{i}"] or 0.0 for i in range(d)])
    scale = np.sqrt(np.maximum(square - mean**2, 1e-8))
    model = Model(mean, scale, rng.normal(size=(d, features)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not summed["n"]:
        return model

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = model.lift(np.array(batch.column("x").to_pylist()))
            total += z.T @ np.hstack([z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
        yield pa.record_batch([pa.array(range(features + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    # a row of the equations from each partition, summed element by element: (features + 1) x (features + 2) sums reach the driver
    parts = train.select("y", "x").mapInArrow(normal, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    sums = np.zeros((features + 1, features + 2))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow().to_batches():
        sums[r.column("i").to_numpy(), r.column("j").to_numpy()] = r.column("v").to_numpy()
    model.weights = np.linalg.solve(sums[:, :-1] + ridge * summed["n"] * np.eye(features + 1), sums[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(model.raw(np.array(batch.column("x").to_pylist())), LOW, HIGH)
                yield pa.record_batch([pa.array(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int32)), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    rows = rest.select("y", "x").mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    if rows:
        model.corners, model.values = isotonic(*(np.array([r[k] for r in rows], float) for k in ("raw", "y", "n")))
    else:
        model.corners, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """docs with held_out, score and predicted (1 if the score is at least `least`), one row for each row.

    Null texts count as empty, and empty texts have a score too. Columns of docs stay, but those named as the new ones,
    which are replaced. Repeated rows are scored each, equal texts alike; an empty table gives an empty one.
    """
    kept, (held,) = others(docs, "held_out", "score", "predicted"), fresh(docs, "held")
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(batches, model):
            yield pa.record_batch([*(part.column(c) for c in kept), part.column(held), pa.array(found), pa.array((found >= least).astype(np.int32))], schema.names)

    return docs.select(*kept, held_out(F.col("doc_id")).alias(held)).mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of docs whose text scores `least` or more, with all their columns and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(batches, model):
            yield part.filter(pa.array(found >= least))

    return docs.mapInArrow(run, docs.schema)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            yield part, model.score(np.array([statistics(x) for x in part.column("text").to_pylist()]).reshape(part.num_rows, -1))
