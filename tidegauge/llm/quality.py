"""Operator 5: quality classifier on random Fourier features.

Document statistics are standardised and mapped to random Fourier features, which approximate a Gaussian kernel.
Every partition sums its part of the normal equations; their total is solved for ridge scores on one part of the
labelled rows. Scores of the other part are calibrated by isotonic regression (pool adjacent violators on scores
rounded to a grid, so its size is fixed). The result is the calibrated probability of label 1.

Labels that are null are left out; several labels of one id count as their largest. Learning takes at most
``max_labels`` labelled rows, those with the smallest hash of the id, with whole texts; this bound lets the ids be
broadcast to the one scan of the texts. Null and empty texts have the statistics of an empty text. Without any usable
label every score is 0.5; without calibration rows the ridge score itself, cut to 0..1, is used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, share

STATISTICS = (
    "log_words", "word_length", "distinct_words", "repeated_words", "distinct_pairs", "top_word", "upper", "digits", "marks", "exclaims",
    "packed", "log_line_length", "distinct_lines", "short_words", "closed_lines", "letters", "long_words",
)
GRID = 1000


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of STATISTICS."""
    text = text or ""
    words = text.split()
    n, chars = len(words) or 1, len(text) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    raw = text.encode("utf-8", "replace")
    letters = len(LETTERS.sub("", text))
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(counts) / n,
        sum(a == b for a, b in zip(lower, lower[1:])) / n,
        len(set(zip(lower, lower[1:]))) / n,
        max(counts.values(), default=0) / n,
        len(UPPER.findall(text)) / chars,
        len(DIGIT.findall(text)) / chars,
        len(MARK.findall(text)) / chars,
        text.count("!") / chars,
        len(zlib.compress(raw, 1)) / (len(raw) + 1),
        np.log1p(chars / (len(lines) or 1)),
        len(set(lines)) / (len(lines) or 1),
        sum(len(w) <= 3 for w in words) / n,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / (len(lines) or 1),
        letters / chars,
        sum(len(w) > 20 for w in words) / n,
    ]


LETTERS = re.compile(r"[\W\d_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[^\w\s]")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    grid: np.ndarray
    calibrated: np.ndarray

    def map(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant in front."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.directions + self.phase
        return np.column_stack([np.ones(len(z)), np.cos(z) * np.sqrt(2 / len(self.phase))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.map(stats) @ self.weights
        return np.clip(np.interp(raw, self.grid, self.calibrated) if len(self.grid) else raw, 0, 1)


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the increasing fit to mean by weight, for increasing x."""
    blocks: list[list[float]] = []
    for m, w in zip(mean, weight):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, n2 = blocks.pop()
            m1, w1, n1 = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), m) for m, _, n in blocks]) if blocks else np.zeros(0)


def _measured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), pa.array(stats, pa.list_(pa.float64()))], ["y", "part", "stats"])

    return rows.mapInArrow(run, "y double, part int, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", max_labels: int = 20_000, features: int = 160, ridge: float = 1e-2, bandwidth: float = 1.0, seed: int = 7) -> QualityModel:
    """Fit on the labelled rows given. ``bandwidth`` scales the kernel width sqrt(number of statistics)."""
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    model = QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, features)) / (bandwidth * np.sqrt(d)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(0), np.zeros(0))
    model.weights[0] = 0.5
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label)).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labels)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = rows.select("__text", "y", (F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(3)) == 0).cast("int").alias("part"))
    measured = checkpointed(_measured(rows))
    agg = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = measured.agg(F.count(F.lit(1)).alias("n"), *agg).first()
    if not got["n"]:
        return model
    model.mean = np.array([got[f"m{i}"] for i in range(d)])
    model.scale = np.maximum([got[f"s{i}"] for i in range(d)], 1e-9)
    shared = share(measured, model)
    width = features + 2  # the mapped features, then the label

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared(), np.zeros((width, width))
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist()).reshape(-1, d)
            z = np.column_stack([own.map(x), batch.column("y").to_numpy()])
            total += z.T @ z
        at = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(at[0] * width + at[1], pa.int64()), pa.array(total[at])], ["cell", "value"])

    fit_on = measured.where("part = 0").mapInArrow(sums, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(width * width)
    total[fit_on["cell"]] = fit_on["value"]
    total = total.reshape(width, width)
    total = np.triu(total) + np.triu(total, 1).T
    penalty = ridge * np.eye(width - 1) * max(1.0, total[0, 0] / features)
    penalty[0, 0] = 1e-9
    if total[0, 0]:
        model.weights = np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])
    shared = share(measured, model)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist()).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(own.map(x) @ own.weights, -1, 2) * GRID) / GRID), batch.column("y")], ["raw", "y"])

    points = measured.where("part = 1").mapInArrow(raw, "raw double, y double").groupBy("raw").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("raw")
    model.grid = points["raw"].to_numpy(float)
    model.calibrated = isotonic(model.grid, points["y"].to_numpy(float), points["n"].to_numpy(float))
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and score for every row."""
    shared = share(docs, model)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            stats = np.array([statistics(v.as_py()) for v in batch.column("__text")]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own.score(stats))], [*keep, "score"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, ", ".join([*fields, "score double"]))
