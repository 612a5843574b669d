"""Operator 12: toxicity by a factorization machine over hashed terms.

A document's terms are its lower-cased words and their first letters (``STEMS``), so that the forms of a word share terms; a term
counts again where it occurs ``LEVELS`` times or more. Terms are hashed into ``BUCKETS`` buckets. Buckets whose share among
toxic documents differs from the others' beyond chance (likelihood ratio of at least ``least``) enter the machine:

    z = bias + sum w_i + sum over pairs <v_i, v_j>,   score = 1 / (1 + exp(-z))

over the buckets of a document. The pair part finds what no single term shows, such as an insult together with a group's name. It
is fitted by rounds of averaging: every partition of the labelled rows goes some epochs of adaptive gradient steps on from the
common parameters, and their mean, weighted by rows, is the next common state.

Learning takes at most ``max_labels`` labelled rows, those with the smallest hash of the id, with whole texts; at most
``max_terms`` buckets enter, those of the largest ratio. Labels that are null are left out; several labels of one id count as
their largest. Null and empty texts have no term and so the score of the bias. Without a label of each kind the score is the mean
label, 0 without any.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, share

WORD = re.compile(r"\w+")
STEMS = (3, 4, 5, 6, 7)
LEVELS = (1, 2, 4)
BUCKETS = 1 << 18
#: Words whose terms a task remembers.
REMEMBERED = 200_000


def hashes(word: str) -> tuple[int, ...]:
    """64-bit hashes of a word and of its beginnings that are shorter than it."""
    return tuple(xxhash.xxh64_intdigest(t) for t in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)))


def bucket(term: int, level: int) -> int:
    return (term + level * 0x9E3779B97F4A7C15) % BUCKETS


def buckets(text: str | None, terms_of) -> set[int]:
    """The buckets of a whole text; terms_of gives the hashes of a word that matter."""
    counts: Counter[int] = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for t in terms_of(word):
            counts[t] += n
    return {bucket(t, level) for t, n in counts.items() for level in LEVELS if n >= level}


def remembered(fn):
    """fn with a memory of bounded size, which starts again when full."""
    memory: dict[str, tuple[int, ...]] = {}

    def look(word: str) -> tuple[int, ...]:
        got = memory.get(word)
        if got is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            got = memory[word] = fn(word)
        return got

    return look


@dataclass
class Machine:
    """bias, and for every bucket that takes part its weight and its factors."""

    bias: float
    place: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def active(self, found: set[int]) -> np.ndarray:
        return np.array(sorted(self.place[b] for b in found if b in self.place), np.int64)

    def margin(self, at: np.ndarray) -> float:
        v = self.factors[at]
        q = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + (q @ q - (v * v).sum()) / 2)

    def learn(self, rows: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, decay: float, rng: np.random.Generator) -> None:
        """Adaptive gradient steps on the log loss, one document at a time in random order."""
        sw, sv, sb = np.full(self.weights.shape, 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at = rows[i]
                error = probability(self.margin(at)) - y[i]
                sb += error * error
                self.bias -= rate * error / np.sqrt(sb)
                v, w = self.factors[at], self.weights[at]
                dw, dv = error + decay * w, error * (v.sum(axis=0) - v) + decay * v
                sw[at] += dw * dw
                sv[at] += dv * dv
                self.weights[at] = w - rate * dw / np.sqrt(sw[at])
                self.factors[at] = v - rate * dv / np.sqrt(sv[at])


def probability(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def likelihood_ratio(a, b, n1: int, n0: int):
    """Twice the log likelihood ratio of a of n1 against b of n0, as a column; negative where the first share is smaller."""
    p = (a + b) / F.lit(float(n1 + n0))
    part = lambda k, n, q: F.when(k > 0, k * F.log(k / F.lit(float(n)) / q)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((1 - k / F.lit(float(n))) / (1 - q))).otherwise(0.0)
    return 2 * (part(a, n1, p) + part(b, n0, p))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", max_labels: int = 20_000, max_terms: int = 8192, least: float = 12.0,
    rank: int = 8, rounds: int = 4, epochs: int = 3, rate: float = 0.1, decay: float = 1e-4, per_part: int = 5000, seed: int = 7,
) -> Machine:
    """Fit on the labelled rows given."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labels)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id").select("__id", "__text", "y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = remembered(hashes)
        for batch in batches:
            found = [sorted(buckets(t.as_py(), look)) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column("__id").cast(pa.string()), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "found"])

    seen = checkpointed(rows.mapInArrow(extract, "id string, y double, found array<int>"))
    n, n1 = seen.agg(F.count(F.lit(1)), F.sum("y")).first()
    n1 = int(n1 or 0)
    if not 0 < n1 < n:
        return Machine(30.0 if n1 else -np.inf)
    table = seen.select("y", F.explode("found").alias("b")).groupBy("b").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    ratio = likelihood_ratio(F.col("p"), F.col("q"), n1, n - n1)
    chosen_buckets = table.withColumn("g", ratio).where(F.col("g") >= least).orderBy(F.desc("g"), "b").limit(max_terms)
    place = {b: i for i, b in enumerate(sorted(r["b"] for r in chosen_buckets.select("b").collect()))}
    rng = np.random.default_rng(seed)
    model = Machine(float(np.log(n1 / (n - n1))), place, np.zeros(len(place)), rng.normal(0, 0.05, (len(place), rank)))
    if not place:
        return model
    parts = -(-n // per_part)
    only = F.array_intersect("found", F.lit(sorted(place)))
    dealt = checkpointed(seen.select("id", "y", only.alias("found")).repartition(parts, "id").sortWithinPartitions("id", "y"))
    for turn in range(rounds):
        shared = share(seen, model)

        def step(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            own, at, y = shared(), [], []
            for batch in batches:
                at += [own.active(set(f)) for f in batch.column("found").to_pylist()]
                y += batch.column("y").to_pylist()
            if at:
                own.learn(at, np.array(y), epochs, rate / (1 + turn), decay, np.random.default_rng(seed + turn))
                state = np.concatenate([[own.bias], own.weights, own.factors.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64()), pa.array([state.tobytes()], pa.binary())], ["n", "state"])

        got = dealt.mapInArrow(step, "n bigint, state binary").collect()  # a row a partition of the bounded sample
        state = np.average([np.frombuffer(r["state"]) for r in got], axis=0, weights=[r["n"] for r in got])
        k = len(place)
        model = Machine(float(state[0]), place, state[1 : k + 1].copy(), state[k + 1 :].reshape(k, rank).copy())
    return model


def score(docs: DataFrame, model: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and score, the probability of a toxic text, for every row."""
    shared = share(docs, model)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        look = remembered(lambda word: tuple(t for t in hashes(word) if any(bucket(t, level) in own.place for level in LEVELS)))
        for batch in batches:
            out = [0.0 if own.bias == -np.inf else probability(own.margin(own.active(buckets(v.as_py(), look)))) for v in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, "score"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, ", ".join([*fields, "score double"]))
