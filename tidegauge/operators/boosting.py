"""Gradient boosting over feature histograms.

Features are cut into at most 255 bins at exact quantiles of the training rows and kept as blocks of bytes. For every open node tasks
sum gradients, second derivatives and rows by feature and bin; the sums of a node (or, for symmetric trees, of a feature) meet in one
group, which finds the best split and returns that alone. Rows never move. Rows of equal bins and label have equal derivatives in every
round, so unless rounds draw rows they are kept once, with their number.

Trees grow leaf by leaf (best gain first, up to ``leaves``), level by level (to ``depth``), or symmetrically (one split for all nodes of a
level). Best-first growth asks for the splits of all nodes that it could open next at once, and is repeated with what it has learned
until nothing is unknown: the tree is the same as one grown a leaf at a time, with about as many jobs as it has levels. Training sets of
one part (PART_BYTES) go the same way inside one task, without a job for every level.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import block, dimension, value_counts
from .ordering import settled
from .quantiles import exact_quantiles

MOST_BINS = 255
#: Memory of a part of the training rows.
PART_BYTES = 128_000_000


@dataclass(frozen=True)
class Settings:
    """How trees grow. The presets below carry the usual settings of the models of those names."""

    rounds: int = 300
    rate: float = 0.05
    growth: str = "leaf"  # leaf, level or symmetric
    leaves: int = 31
    depth: int = 6  # of level and symmetric trees
    l2: float = 1e-3
    least_rows: int = 20  # of a node
    least_weight: float = 1e-3  # second derivatives of a node
    row_share: float = 1.0
    column_share: float = 1.0
    balanced: bool = False  # classes of equal weight
    refresh: int = 25  # rounds after which margins are written anew


PRESETS = {
    "hist_gbdt": Settings(),
    "gbdt": Settings(),
    "lightgbm": Settings(rounds=500, l2=0.0, column_share=0.9, balanced=True),
    "xgboost": Settings(rounds=500, growth="level", leaves=64, l2=1.0, least_rows=1, least_weight=1.0, row_share=0.9, column_share=0.9),
    "catboost": Settings(rounds=500, growth="symmetric", leaves=64, l2=3.0, least_rows=1),
}


@dataclass
class Split:
    """What is known of a node: its sums, and its best split if it has one."""

    g: float
    h: float
    gain: float = 0.0
    feature: int = -1
    cut: int = -1  # bins up to it go left


@dataclass
class Tree:
    """Nodes by number (root 1, children 2n and 2n + 1): (feature, cut) of inner ones, values of leaves."""

    inner: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def ends(self, bins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves, with the places of the rows of bins that reach them."""
        todo = [(1, np.arange(len(bins)))]
        while todo:
            node, rows = todo.pop()
            if node in self.inner:
                f, cut = self.inner[node]
                left = bins[rows, f] <= cut
                todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
            else:
                yield node, rows

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for node, rows in self.ends(bins):
            out[rows] = self.values.get(node, 0.0)
        return out


@dataclass
class Model:
    edges: list[np.ndarray]
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)  # by round and class

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], "left")
        return out

    def margins(self, bins: np.ndarray, since: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.start)))
        for trees in self.trees[since:]:
            for k, t in enumerate(trees):
                out[:, k] += t.predict(bins)
        return out


def derivatives(margin: np.ndarray, y: np.ndarray, w: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, rows x classes (one column for two classes and for regression)."""
    if task == "regression":
        return (margin - y[:, None]) * w[:, None], np.repeat(w[:, None], margin.shape[1], 1)
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        return (p - y[:, None]) * w[:, None], np.maximum(p * (1 - p), 1e-16) * w[:, None]
    p = softmax(margin)
    return (p - (y[:, None] == np.arange(margin.shape[1]))) * w[:, None], np.maximum(p * (1 - p), 1e-16) * w[:, None]


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, c: np.ndarray, rows_of: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """nodes x columns x bins x (gradient, second derivative, rows) for the places of the rows of every node, which stand for c rows each."""
    width, n = MOST_BINS + 1, len(rows_of)
    out = np.zeros((n, len(columns), width, 3))
    rows = np.concatenate(rows_of)
    base, gr, hr, cr = np.repeat(np.arange(n) * width, [len(r) for r in rows_of]), g[rows], h[rows], c[rows]
    for j, f in enumerate(columns):
        key = base + bins[rows, f]
        for i, v in enumerate((gr, hr, cr)):
            out[:, j, :, i] = np.bincount(key, v, n * width).reshape(n, width)
    return out


def gains(hist: np.ndarray, s: Settings) -> np.ndarray:
    """Gain of a cut after every bin, over the last two axes of hist (bins, sums); minus infinity where it isn't allowed."""
    left = np.cumsum(hist, axis=-2)
    all_ = left[..., -1:, :]
    right = all_ - left
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.l2 + 1e-12)
    ok = (left[..., 2] >= s.least_rows) & (right[..., 2] >= s.least_rows) & (left[..., 1] >= s.least_weight) & (right[..., 1] >= s.least_weight) & (left[..., 2] > 0) & (right[..., 2] > 0)
    return np.where(ok, score(left) + score(right) - score(all_), -np.inf)


def best_split(hist: np.ndarray, columns: np.ndarray, s: Settings) -> Split:
    """Of one node: columns x bins x 3."""
    g, h, _ = hist[0].sum(axis=0)
    all_gains = gains(hist, s)
    j, cut = np.unravel_index(int(np.argmax(all_gains)), all_gains.shape)
    gain = all_gains[j, cut]
    return Split(float(g), float(h), float(gain), int(columns[j]), int(cut)) if gain > 1e-12 else Split(float(g), float(h))


def open_nodes(known: dict[int, Split], s: Settings) -> tuple[Tree, list[int]]:
    """Best-first growth (or by level) with the known splits: the tree and the nodes whose splits are missing."""
    tree, missing, leaves = Tree(), [], 1
    heap: list[tuple[float, int]] = []

    def reach(node: int) -> None:
        if node not in known:
            missing.append(node)
        elif known[node].feature >= 0 and (s.growth == "leaf" or node < 1 << s.depth):
            heapq.heappush(heap, (-known[node].gain if s.growth == "leaf" else node, node))

    reach(1)
    while heap and leaves < s.leaves:
        _, node = heapq.heappop(heap)
        tree.inner[node] = (known[node].feature, known[node].cut)
        leaves += 1
        reach(2 * node)
        reach(2 * node + 1)
    return tree, missing


def grown(ask: Callable[[list[Tree], list[list[int]]], list[dict[int, Split]]], classes: int, s: Settings) -> list[Tree]:
    """A tree a class. ``ask`` gives the best splits of nodes of partial trees (of symmetric trees, one for all nodes)."""
    known: list[dict[int, Split]] = [{} for _ in range(classes)]
    if s.growth == "symmetric":
        trees, active = [Tree() for _ in range(classes)], set(range(classes))
        for level in range(s.depth + 1):
            nodes = [list(range(1 << level, 2 << level)) if k in active else [] for k in range(classes)]
            got = ask(trees, nodes)
            for k in list(active):
                known[k] |= got[k]
                one = got[k].get(1 << level)
                if level < s.depth and one is not None and one.feature >= 0:
                    trees[k].inner |= {n: (one.feature, one.cut) for n in nodes[k]}
                else:
                    active.discard(k)
            if not active:
                break
    else:
        while True:
            plans = [open_nodes(k, s) for k in known]
            trees = [t for t, _ in plans]
            if not any(m for _, m in plans):
                break
            for k, got in enumerate(ask(trees, [m for _, m in plans])):
                known[k] |= got
    for k, tree in enumerate(trees):
        ends = {1} | {c for n in tree.inner for c in (2 * n, 2 * n + 1)}
        for n in ends - set(tree.inner):
            one = known[k].get(n)
            tree.values[n] = -s.rate * one.g / (one.h + s.l2 + 1e-12) if one is not None else 0.0
    return trees


@dataclass
class Rows:
    """A part of the training rows in memory."""

    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margin: np.ndarray
    ids: np.ndarray
    c: np.ndarray  # rows that each one stands for

    def drawn(self, turn: int, s: Settings, seed: int) -> np.ndarray:
        """1 for rows that take part in a round, by a hash of the row and the round."""
        if s.row_share >= 1:
            return np.ones(len(self.y))
        x = (self.ids.astype(np.uint64) + np.uint64(turn * 1_000_003 + seed)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(11)).astype(float) / float(1 << 53) < s.row_share).astype(float)

    def begin(self, turn: int, task: str, s: Settings, seed: int, classes: int) -> None:
        """Derivatives of a round, and all of its rows at the root."""
        use = self.drawn(turn, s, seed)
        self.g, self.h = derivatives(self.margin, self.y, self.w * self.c * use, task)
        self.where = [{1: np.flatnonzero(use)} for _ in range(classes)]

    def sums(self, trees: list[Tree], nodes: list[list[int]], columns: np.ndarray) -> list[np.ndarray | None]:
        """Histograms of nodes of partial trees; rows move down from where earlier calls of the round left them."""
        out: list[np.ndarray | None] = []
        for k, (t, own) in enumerate(zip(trees, nodes)):
            at = self.where[k]
            for node in sorted(t.inner):
                if 2 * node not in at:
                    f, cut = t.inner[node]
                    rows = at[node]
                    left = self.bins[rows, f] <= cut
                    at[2 * node], at[2 * node + 1] = rows[left], rows[~left]
            out.append(histograms(self.bins, self.g[:, k], self.h[:, k], self.c, [at[n] for n in own], columns) if own else None)
        return out


def decide(hists: list[np.ndarray | None], nodes: list[list[int]], columns: np.ndarray, s: Settings) -> list[dict[int, Split]]:
    """Best splits by class and node from whole histograms."""
    out = []
    for hist, own in zip(hists, nodes):
        if hist is None:
            out.append({})
        elif s.growth == "symmetric":
            all_gains = gains(hist, s)
            total = np.where(np.isfinite(all_gains), all_gains, 0).sum(axis=0)
            j, cut = np.unravel_index(int(np.argmax(total)), total.shape)
            good = total[j, cut] > 1e-12
            out.append({n: Split(*map(float, hist[i, 0].sum(axis=0)[:2]), float(total[j, cut]) if good else 0.0, int(columns[j]) if good else -1, int(cut)) for i, n in enumerate(own)})
        else:
            out.append({n: best_split(hist[i], columns, s) for i, n in enumerate(own)})
    return out


def columns_of(turn: int, d: int, s: Settings, seed: int) -> np.ndarray:
    """The features that a round may split."""
    if s.column_share >= 1:
        return np.arange(d)
    return np.sort(np.random.default_rng(seed + 7919 * turn).choice(d, max(1, int(round(d * s.column_share))), replace=False))


def as_rows(batches: list[pa.RecordBatch] | pa.Table, d: int) -> Rows:
    cols = {c: b"".join(v for b in batches for v in b.column(c).to_pylist()) for c in ("bins", "y", "w", "margin", "ids", "c")}
    y = np.frombuffer(cols["y"])
    return Rows(np.frombuffer(cols["bins"], np.uint8).reshape(-1, d), y, np.frombuffer(cols["w"]), np.frombuffer(cols["margin"]).reshape(len(y), -1), np.frombuffer(cols["ids"], np.int64), np.frombuffer(cols["c"]))


BLOCK = "bins binary, y binary, w binary, margin binary, ids binary, c binary"


def fit(train: DataFrame, task: str, settings: Settings = Settings(), seed: int = 42, features: str = "features", label: str = "label", per_part: int | None = None) -> Model:
    """Fit on rows with features and a label: a number, or a class from 0 up. Rows without a label are left out. A part holds
    ``per_part`` rows, by default as many as fit PART_BYTES with their bins, margins and derivatives."""
    s, known = settings, train.where(F.col(label).isNotNull())
    d = dimension(known, features)
    if not d:
        raise ValueError("no labelled row with features")
    grid = np.linspace(0, 1, MOST_BINS + 1)[1:-1]
    cuts = {r["feature_id"]: np.unique(np.array(r["q"], float)) for r in exact_quantiles(value_counts(known, [], "r", features), ["feature_id"], "value", list(grid), weight="r").collect()}
    facts = known.groupBy(F.col(label).cast("double").alias("y")).count() if task != "regression" else known.agg(F.avg(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("count"))
    facts = [(r["y"], r["count"]) for r in facts.collect()]  # a row a class
    n = sum(c for _, c in facts)
    if task == "regression":
        start, weights = np.array([facts[0][0]]), {}
    else:
        classes = int(max(y for y, _ in facts)) + 1
        counts = np.bincount([int(y) for y, _ in facts], [c for _, c in facts], max(2, classes))
        weights = {i: n / (len(facts) * c) if s.balanced and c else 1.0 for i, c in enumerate(counts)}
        shares = np.maximum(counts * [weights[i] for i in range(len(counts))], 1e-9)
        start = np.log(shares / shares.sum()) if classes > 2 else np.array([np.log(shares[1] / shares[0])])
    model = Model([cuts.get(j, np.zeros(0)) for j in range(d)], start)
    sent = train.sparkSession.sparkContext.broadcast((model.edges, start, weights))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value[:2])
        for batch in batches:
            if batch.num_rows:
                bins = own.bins(block(batch.column("x")))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), *(batch.column(c) for c in ("y", "id"))], ["bins", "y", "id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, start, weights = sent.value
        for batch in batches:
            if batch.num_rows:
                y, c = (batch.column(v).to_numpy(zero_copy_only=False).astype(float) for v in ("y", "c"))
                w = np.array([weights.get(int(v), 1.0) for v in y]) if weights else np.ones(len(y))
                whole = [b"".join(batch.column("bins").to_pylist()), *(v.tobytes() for v in (y, w, np.repeat(start[None, :], len(y), 0), batch.column("id").to_numpy().astype(np.int64), c))]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in whole], [v.split(" ")[0] for v in BLOCK.split(", ")])

    rows = known.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(features), F.col(label)).alias("id"))
    rows = rows.mapInArrow(binned, "bins binary, y double, id bigint")
    if s.row_share < 1:  # a round draws single rows
        rows = rows.withColumn("c", F.lit(1))
    else:
        rows = settled(rows.groupBy("bins", "y").agg(F.count(F.lit(1)).alias("c")).withColumn("id", F.xxhash64("bins", "y")).select("bins", "y", "id", "c"))
        n = rows.count()
    parts = max(1, -(-n // (per_part or PART_BYTES // (d + 40 + 24 * len(start)))))
    blocks = settled(rows.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(pack, BLOCK))
    if parts == 1:
        model.trees = _in_one_task(blocks, model, task, s, d, seed)
        return model
    done = 0
    for turn in range(s.rounds):
        if turn - done >= s.refresh:
            blocks, done = settled(_moved(blocks, model, done, d)), turn
        columns = columns_of(turn, d, s, seed)
        model.trees.append(grown(lambda trees, nodes: _asked(blocks, model, done, trees, nodes, task, s, columns, turn, seed, d), len(start), s))  # noqa: B023  called at once
    return model


def _in_one_task(blocks: DataFrame, model: Model, task: str, s: Settings, d: int, seed: int) -> list[list[Tree]]:
    """All rounds inside the task that holds the one part."""
    import pickle

    start = model.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = as_rows(list(batches), d), []
        for turn in range(s.rounds):
            columns = columns_of(turn, d, s, seed)
            part.begin(turn, task, s, seed, len(start))
            trees = grown(lambda t, n: decide(part.sums(t, n, columns), n, columns, s), len(start), s)  # noqa: B023  called at once
            part.margin = part.margin + np.column_stack([t.predict(part.bins) for t in trees])
            out.append([(t.inner, t.values) for t in trees])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["trees"])

    got = blocks.coalesce(1).mapInArrow(run, "trees binary").first()
    return [[Tree(*t) for t in trees] for trees in pickle.loads(got["trees"])]


def _moved(blocks: DataFrame, model: Model, done: int, d: int) -> DataFrame:
    """Blocks whose margins include all trees."""
    sent = blocks.sparkSession.sparkContext.broadcast(Model(model.edges, model.start, model.trees[done:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                part = as_rows([one], d)
                margin = part.margin + sent.value.margins(part.bins)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("bins", "y", "w")), pa.array([margin.tobytes()], pa.binary()), one.column("ids"), one.column("c")], one.schema.names)

    return blocks.mapInArrow(run, BLOCK)


def _asked(blocks: DataFrame, model: Model, done: int, trees: list[Tree], nodes: list[list[int]], task: str, s: Settings, columns: np.ndarray, turn: int, seed: int, d: int) -> list[dict[int, Split]]:
    """Best splits by class and node: sums by part, then a group a node, or a group a feature for symmetric trees."""
    sent = blocks.sparkSession.sparkContext.broadcast((Model(model.edges, model.start, model.trees[done:]), trees, nodes, columns))
    whole = s.growth == "symmetric"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since, trees, nodes, columns = sent.value
        total: list[np.ndarray | None] = [None] * len(trees)
        for batch in batches:
            for i in range(batch.num_rows):
                part = as_rows([batch.slice(i, 1)], d)
                part.margin = part.margin + since.margins(part.bins)
                part.begin(turn, task, s, seed, len(trees))
                got = part.sums(trees, nodes, columns)
                total = [a if b is None else b if a is None else a + b for a, b in zip(total, got)]
        for k, hist in enumerate(total):
            if hist is not None:
                keys = range(len(columns)) if whole else range(len(nodes[k]))
                pieces = [np.ascontiguousarray(hist[:, j : j + 1] if whole else hist[j : j + 1]).tobytes() for j in keys]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(pieces), pa.int32()), pa.array(list(keys), pa.int32()), pa.array(pieces, pa.binary())], ["class", "key", "hist"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, nodes, columns = sent.value
        k, key = int(pdf["class"].iloc[0]), int(pdf["key"].iloc[0])
        shape = (len(nodes[k]), 1, MOST_BINS + 1, 3) if whole else (1, len(columns), MOST_BINS + 1, 3)
        hist = sum(np.frombuffer(v).reshape(shape) for v in pdf["hist"])
        own = nodes[k] if whole else [nodes[k][key]]
        got = decide([hist], [own], columns[key : key + 1] if whole else columns, s)[0]
        return pd.DataFrame([(k, n, v.g, v.h, v.gain, v.feature, v.cut) for n, v in got.items()], columns=["class", "node", "g", "h", "gain", "feature", "cut"])

    rows = blocks.mapInArrow(sums, "class int, key int, hist binary").groupBy("class", "key").applyInPandas(best, "class int, node bigint, g double, h double, gain double, feature int, cut int").collect()
    out: list[dict[int, Split]] = [{} for _ in trees]
    for r in sorted(rows, key=lambda r: (-r["gain"], r["feature"])):  # symmetric trees: the best feature comes first
        out[r["class"]].setdefault(r["node"], Split(r["g"], r["h"], r["gain"], r["feature"], r["cut"]))
    return out


def predict(rows: DataFrame, model: Model, task: str, features: str = "features") -> DataFrame:
    """rows with scores (probability by class) and score (of the last class), or with predicted."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    name, kind = ("predicted", "double") if task == "regression" else ("scores", "array<double>")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = sent.value
            margin = own.start + own.margins(own.bins(block(batch.column(features))))
            if task == "regression":
                out = pa.array(margin[:, 0])
            else:
                p = softmax(np.column_stack([np.zeros(len(margin)), margin]) if margin.shape[1] == 1 else margin)
                out = pa.array(list(p), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    out = rows.mapInArrow(run, fields)
    return out if task == "regression" else out.withColumn("score", F.col("scores")[F.size("scores") - 1])
