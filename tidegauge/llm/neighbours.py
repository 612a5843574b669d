"""Operator 10: approximate nearest neighbours with a forest of random-projection trees.

Each tree splits a bounded sample of the vectors (at most ``max_sample``, those with the smallest hash) again and
again by the hyperplane halfway between two random members, at the median, until a node has at most ``leaf`` of them.
Every vector of the table is then put into its leaf of every tree. A query keeps one priority queue over all trees:
it descends from the nearest pending node, pending the far side of each split by its distance, and collects leaves
until they hold about ``search`` entries (by default 16 n**0.7 for n vectors, and every leaf up to 1000 vectors). The
entries of those leaves are ranked by exact Euclidean distance in double precision.

Equal vectors are one entry that carries its k + 1 smallest ids, so copies neither fill a leaf nor lose a result.
Large leaves are dealt over several salts, and queries visit all of them; each task works on a bounded part of the
index. Vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do vectors of
another length than the commonest one (the longer at a tie). A repeated id counts once for each distinct vector.
With fewer than k other vectors all of them are returned. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, share


@dataclass
class Tree:
    """Nodes as arrays. A leaf has child -1; its weight is its share of the sample."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray  # nodes x 2: at most the offset, above it
    weight: np.ndarray

    @staticmethod
    def grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
        normal, offset, child, weight = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            at = len(normal)
            if parent >= 0:
                child[parent][side] = at
            normal.append(np.zeros(points.shape[1]))
            offset.append(0.0)
            child.append([-1, -1])
            weight.append(len(own) / max(1, len(points)))
            if len(own) <= leaf:
                continue
            for _ in range(4):  # members may coincide
                a, b = points[rng.choice(own, 2, replace=False)]
                n = b - a
                size = np.sqrt(n @ n)
                if size > 0:
                    z = points[own] @ (n / size)
                    cut = float(np.median(z))
                    low = z <= cut
                    if 0 < low.sum() < len(own):
                        normal[at], offset[at] = n / size, cut
                        todo += [(own[low], at, 0), (own[~low], at, 1)]
                        break
        return Tree(np.array(normal), np.array(offset), np.array(child), np.array(weight))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.child[node, 0] >= 0)
            if not len(inner):
                return node
            n = node[inner]
            above = np.einsum("ij,ij->i", x[inner], self.normal[n]) > self.offset[n]
            node[inner] = self.child[n, above.astype(int)]


def visit(trees: list[Tree], q: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order of one shared queue until their shares sum to ``wanted``."""
    queue = [(0.0, t, 0) for t in range(len(trees))]
    out, got = [], 0.0
    while queue and got < wanted:
        bound, t, node = heapq.heappop(queue)
        tree = trees[t]
        while tree.child[node, 0] >= 0:
            gap = float(tree.normal[node] @ q) - tree.offset[node]
            side = int(gap > 0)
            heapq.heappush(queue, (max(bound, abs(gap)), t, int(tree.child[node, 1 - side])))
            node = int(tree.child[node, side])
        out.append((t, node))
        got += tree.weight[node]
    return out


def neighbours(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = 24, leaf: int = 48, max_sample: int = 20_000, search: int | None = None, per_task: int = 40_000, seed: int = 11) -> DataFrame:
    """The k nearest other vectors of every row where ``is_query`` holds: query_id, rank, vec_id, score."""
    component = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("v")
    good = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), is_query.alias("query"))
    good = good.where(v.isNotNull() & F.col("id").isNotNull() & ~F.exists(v, component) & F.exists(v, lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], result)
    good = good.where(F.size("v") == lengths["d"])
    first = Window.partitionBy("v").orderBy("id")
    # equal vectors: the limit on the rank works before the shuffle, so a hot vector sends few rows
    classes = good.select("id", "v").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = checkpointed(classes.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("v"), F.col("ids")[0]).select("v").limit(max_sample).toPandas()
    points = np.array(sample["v"].tolist(), float)
    rng = np.random.default_rng(seed)
    forest = [Tree.grow(points, leaf, rng) for _ in range(trees)]
    wanted = (search or max(16 * n**0.7, 1000 * trees)) / n
    biggest = max(float(t.weight[t.child[:, 0] < 0].max()) for t in forest)
    salts = max(1, int(np.ceil(biggest * n / per_task)))
    buckets = max(1, int(np.ceil(trees * n / per_task)))
    shared = share(vectors, forest)

    def index(batches):
        own = shared()
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
            for t, tree in enumerate(own):
                yield pdf.assign(tree=t, leaf=tree.leaves(x) if len(pdf) else [])

    def probes(batches):
        own = shared()
        for pdf in batches:
            rows = [(i, q, t, node) for i, q in zip(pdf["id"], pdf["v"]) for t, node in visit(own, np.asarray(q, float), wanted)]
            yield pd.DataFrame(rows, columns=["id", "v", "tree", "leaf"])

    bucket = F.pmod(F.xxhash64("tree", "leaf", "salt"), F.lit(buckets)).alias("bucket")
    kind = good.schema["v"].dataType.simpleString()
    entries = classes.mapInPandas(index, f"v {kind}, ids array<bigint>, tree int, leaf bigint").withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(salts)))
    queries = checkpointed(good.where("query").select("id", "v").distinct())
    # a task descends the trees for about 64 queries
    asked = queries.repartition(max(1, -(-queries.count() // 64)), "id").mapInPandas(probes, f"id bigint, v {kind}, tree int, leaf bigint").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    keep = k + 1  # the query's own vector may be among them

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            x = np.array(right["v"].tolist(), float)
            ids = right["ids"].to_numpy()
            own = {key: at for key, at in right.groupby(["tree", "leaf", "salt"]).indices.items()}
            found: dict[int, list[tuple]] = {}
            for i, q, t, node, s in zip(left["id"], left["v"], left["tree"], left["leaf"], left["salt"]):
                at = own.get((t, node, s))
                if at is None:
                    continue
                d = np.sqrt(((x[at] - np.asarray(q, float)) ** 2).sum(axis=1))
                near = np.flatnonzero(d <= np.partition(d, keep - 1)[keep - 1]) if len(d) > keep else np.arange(len(d))
                found.setdefault(i, []).extend((d[j], at[j]) for j in near)
            for i, pairs in found.items():
                best: dict[tuple, float] = {}
                for d, j in pairs:
                    best[tuple(ids[j])] = d
                top = sorted((d, m) for m, d in best.items())
                last = top[min(keep, len(top)) - 1][0]
                out += [(i, list(m), d) for d, m in top if d <= last]
        return pd.DataFrame(out, columns=["query_id", "ids", "score"])

    near = asked.select("id", "v", "tree", "leaf", "salt", bucket).groupBy("bucket").cogroup(entries.select("v", "ids", "tree", "leaf", "salt", bucket).groupBy("bucket")).applyInPandas(rank, "query_id bigint, ids array<bigint>, score double")
    pairs = near.dropDuplicates(["query_id", "ids", "score"]).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
