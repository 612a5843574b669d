"""Operator 13: hard negatives by one-dimensional distance keys.

Components become integers, and a score is the inner product of two rows. A coordinate sqrt(M2 - |x|2), where M2 is the largest
squared length, makes all rows equally long, and 0 is added to an anchor; then a score falls as the distance grows:

    distance2 = M2 + |anchor|2 - 2 score

Every row belongs to its nearest pivot and is stored sorted by (pivot, distance to the pivot). A row within r of an anchor has a key
within r of the anchor's own distance to that pivot, so a search scans the key intervals around those distances and widens them:
first to some thousand rows, then eightfold, and once k rows are found to their k-th distance, at which no unscanned row can be
better. Scores wanted between two bounds limit the distances likewise to an annulus. All results are exact.

The first search finds an anchor's positives, the rows of its label with the best scores; the second finds for every positive the
best rows of other labels between ``least`` hundredths of its score and its score. Ties go to smaller ids.

Rows take no part when id, label or vector is null, the vector is empty or holds a null or non-finite component, has another length
than the commonest one (the longer at a tie), or its integers have a squared length of 2**56 or more, whose hundredfold would not
fit a long. Of several rows with one id that with the smallest (label, vector) counts. Zero vectors take part. An anchor without
positives, or a positive without negatives in its range, gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, share

#: Squared lengths from which products are multiplied as integers, not as doubles.
EXACT = 2.0**53
LIMIT = 2.0**56
#: Pieces of the stored index at most; the directory sent to tasks has one entry a piece and one more a pivot.
MOST_PIECES = 20_000


@dataclass
class Keys:
    """Pivots (with their last coordinate) and the key ranges of the stored pieces, an entry for every piece and pivot."""

    top: float  # M2
    pivots: np.ndarray
    piece: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def tolerance(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.top))

    def to_pivots(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distances of rows x, with their last coordinates, from all pivots."""
        full = np.column_stack([x, last]).astype(float)
        square = (full * full).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * full @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def distance(self, squared_length: float, score: float) -> float:
        return float(np.sqrt(max(0.0, self.top + squared_length - 2.0 * score)))

    def widened(self, own: np.ndarray, rows: float) -> float:
        """A radius whose intervals hold about ``rows`` rows, if keys are even within an entry."""
        at, width = own[self.pivot], np.maximum(self.high - self.low, 1e-9)
        lo, hi = 0.0, float(2 * np.sqrt(self.top) + own.max() + 1)
        for _ in range(40):
            r = (lo + hi) / 2
            share_in = np.clip((np.minimum(self.high, at + r) - np.maximum(self.low, at - r)) / width, 0, 1)
            lo, hi = (lo, r) if (share_in * self.count).sum() >= rows else (r, hi)
        return hi


def pivots_of(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Centres of some rounds of k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(8):
        near = ((sample * sample).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * sample @ centres.T).argmin(axis=1)
        centres = np.array([sample[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def last_coordinate(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (x.astype(float) ** 2).sum(axis=1), 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def integer_rows(vectors: DataFrame, is_anchor: Column, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """id, label, v (array<long>), anchor, of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and x is not null").where((F.size("x") > 0) & ~F.exists("x", bad))
    rows = rows.withColumn("x", F.transform("x", lambda c: F.floor(c * scale)))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < LIMIT).withColumnRenamed("x", "v")
    twice = checkpointed(rows.groupBy("id").count().where("count > 1").select("id"))
    if not twice.isEmpty():
        first = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("m")).select("id", "m.label", "m.v", "m.anchor")
        rows = rows.join(twice, "id", "left_anti").select("id", "label", "v", "anchor").unionByName(first)
    return rows


@dataclass
class Stored:
    """The index: rows (piece, pivot, key, id, label, v), sorted by (pivot, key) and cut into pieces, and its directory."""

    rows: DataFrame
    keys: Keys
    exact: bool  # products stay below 2**53


def store(rows: DataFrame, top: float, n: int, pivots: int, per_piece: int, max_sample: int, seed: int) -> Stored:
    sample = np.array([r["v"] for r in rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(max_sample).collect()], float)
    centres = pivots_of(np.column_stack([sample, last_coordinate(sample, top)]), pivots, seed)
    none = np.zeros(0)
    sent = share(rows, Keys(top, centres, none, none, none, none, none))

    def assign(batches):
        keys = sent()
        for pdf in batches:
            x = matrix(pdf["v"])
            if len(x):
                far = keys.to_pivots(x, last_coordinate(x, keys.top))
                near = far.argmin(axis=1)
                yield pdf.assign(pivot=near.astype(np.int32), key=far[np.arange(len(x)), near])

    keyed = rows.select("id", "label", "v").mapInPandas(assign, "id bigint, label bigint, v array<bigint>, pivot int, key double")
    pieces = min(MOST_PIECES, max(1, -(-n // per_piece)))
    # the id cuts runs of equal keys, as of one very common vector
    placed = checkpointed(keyed.repartitionByRange(pieces, "pivot", "key", "id").sortWithinPartitions("pivot", "key", "id").withColumn("piece", F.spark_partition_id()))
    entries = placed.groupBy("piece", "pivot").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("count")).orderBy("pivot", "low", "piece").toPandas()
    keys = Keys(top, centres, *(entries[c].to_numpy() for c in ("piece", "pivot", "low", "high", "count")))
    return Stored(placed, keys, top < EXACT)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    at = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


WANTS = "anchor bigint, label bigint, v array<bigint>, want array<int>, low array<bigint>, high array<bigint>"


def search(index: Stored, wants: DataFrame, k: int, same: bool, start: int = 4096, per_block: int = 4096) -> DataFrame:
    """(anchor, want, id, score): the k best rows for every want of every anchor, among rows of its label or of the others.

    wants: anchor, label, v and, by want, its number and the least and the greatest score (a row an anchor).
    """
    spark, sent, exact = wants.sparkSession, share(wants, index.keys), index.exact
    blocks = max(1, -(-wants.count() // per_block))  # anchors meet the index in blocks

    def measure(batches):
        keys = sent()
        for pdf in batches:
            if len(pdf):
                v = matrix(pdf["v"])
                yield pdf.assign(own=list(keys.to_pivots(v, np.zeros(len(v)))))

    def plan(batches):
        keys = sent()
        tol = keys.tolerance()
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            for r in pdf.itertuples(index=False):
                own, v = np.asarray(r.own), np.asarray(r.v, float)
                length = float(v @ v)
                least = [max(lo, kth) for lo, kth in zip(r.low, r.kth)]
                last = max(keys.distance(length, s) for s in least) + tol
                near = keys.distance(length, max(r.high)) - tol
                rows = start * 8**r.turn
                known = all(kth >= lo for lo, kth in zip(r.low, r.kth))
                radius = last if known or rows >= keys.count.sum() else min(last, max(r.done, keys.widened(own, rows)))
                gap = own[keys.pivot]
                first = np.maximum(0, np.maximum(gap - keys.high, keys.low - gap))  # the least distance in an entry
                far = np.maximum(np.abs(gap - keys.low), np.abs(gap - keys.high))  # the greatest difference of keys in it
                meets = (first <= radius) & (far > r.done) & (gap + keys.high >= near)
                out.append((radius, radius >= last, np.unique(keys.piece[meets]).tolist()))
            yield pdf.assign(radius=[o[0] for o in out], final=[o[1] for o in out], pieces=[o[2] for o in out])

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            x, ids, labels = matrix(right["v"]), right["id"].to_numpy(), right["label"].to_numpy()
            pivot, key = right["pivot"].to_numpy(), right["key"].to_numpy()
            for at in range(0, len(left), 256):
                part = left.iloc[at : at + 256]
                q = matrix(part["v"])
                scores = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else q @ x.T
                for i, r in enumerate(part.itertuples(index=False)):
                    gap = np.abs(np.asarray(r.own)[pivot] - key)
                    mine = np.flatnonzero((gap <= r.radius) & (gap > r.done) & ((labels == r.label) == same) & (ids != r.anchor))
                    s = scores[i][mine]
                    for want, lo, hi in zip(r.want, r.low, r.high):
                        ok = np.flatnonzero((s >= lo) & (s <= hi))
                        for j in ok[best(s[ok], ids[mine[ok]], k)]:
                            found.append((r.anchor, want, ids[mine[j]], s[j]))
        return pd.DataFrame(found, columns=["anchor", "want", "id", "score"])

    result = "anchor bigint, want int, id bigint, score bigint"
    state = spark.createDataFrame([], result)
    # measured once, so that every round cuts the intervals at the same places
    active = wants.mapInPandas(measure, f"{WANTS}, own array<double>").withColumns({"kth": F.transform("low", lambda x: x - 1), "done": F.lit(-1.0), "turn": F.lit(0)})
    ranked = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "id")
    while True:
        columns = f"{WANTS}, own array<double>, kth array<bigint>, done double, turn int, radius double, final boolean, pieces array<int>"
        planned = checkpointed(active.mapInPandas(plan, columns))
        block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block")
        probes = planned.select("anchor", "label", "v", "own", "want", F.zip_with("low", "kth", lambda a, b: F.greatest(a, b)).alias("low"), "high", "done", "radius", block, F.explode("pieces").alias("piece"))
        asked = F.broadcast(probes.select("piece").distinct())  # at most MOST_PIECES
        rows = index.rows.join(asked, "piece", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = probes.groupBy("piece", "block").cogroup(rows.groupBy("piece", "block")).applyInPandas(scan, result)
        state = checkpointed(state.unionByName(found).withColumn("__r", F.row_number().over(ranked)).where(F.col("__r") <= k).drop("__r"))
        rest = planned.where("not final")
        if rest.isEmpty():
            return state
        # the k-th score of every want that has k rows already
        full = state.groupBy("anchor", "want").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
        full = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("want", "s"))).alias("full"))
        kth = F.zip_with("want", "low", lambda w, lo: F.coalesce(F.col("full")[w], lo - 1))
        active = rest.join(full, "anchor", "left").select("anchor", "label", "v", "want", "low", "high", "own", kth.alias("kth"), F.col("radius").alias("done"), (F.col("turn") + 1).alias("turn"))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    scale: int = 256, pivots: int = 32, per_piece: int = 20_000, max_sample: int = 8192, seed: int = 13,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = integer_rows(vectors, is_anchor, vec_id, embedding, label, scale)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = checkpointed(rows.where(F.size("v") == lengths["d"]))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, top = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    index = store(rows, top, n, pivots, per_piece, max_sample, seed)
    low, high = -(1 << 60), 1 << 60
    one = lambda x, kind: F.array(F.lit(x).cast(kind))
    anchors = checkpointed(rows.where("anchor").select(F.col("id").alias("anchor"), "label", "v"))
    near = search(index, anchors.select("*", one(0, "int").alias("want"), one(low, "long").alias("low"), one(high, "long").alias("high")), positives, True)
    place = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = checkpointed(near.select("anchor", F.row_number().over(place).alias("want"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # negative scores have no range: least hundredths of them lie above them
    ranges = near.where("positive_score >= 0").withColumn("low", F.expr(f"({least} * positive_score + 99) div 100"))
    wanted = ranges.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("want", "low", F.col("positive_score").alias("high")))).alias("w"))
    wanted = anchors.join(wanted, "anchor").select("anchor", "label", "v", "w.want", "w.low", "w.high")
    found = search(index, wanted, negatives, False)
    place = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "id")
    out = found.withColumn("rank", F.row_number().over(place)).join(near, ["anchor", "want"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
