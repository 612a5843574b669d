"""Operator 8: sharding by Karmarkar-Karp differencing, law ``bytes``.

Rows of equal text form one indivisible group; the shards' byte totals are to be as equal as the groups allow. The
differencing method starts with one partial partition for every group (its size in one part, nothing in the others)
and keeps combining the two partial partitions with the largest spread, the largest part of one with the smallest of
the other, until one is left.

To run on any number of groups, the method is applied in independent buckets of small groups. Groups larger than
1/``max_large`` of all bytes (hence at most ``max_large`` of them) are partitioned first, in one task. The bytes that
each shard still lacks are divided evenly over the buckets, and each bucket starts from a partial partition that
stands for this lack, so its small groups fill it. The shard of a part is the one that its share of the lack names.

A row's size is the UTF-8 bytes of its text plus ``overhead``; a null text counts as empty, and both are one group.
Slots number a shard's rows from 0 without a gap, by bucket of the id and id; repeated ids are separate rows. Joins
are by group, with row counts left to the adaptive skew handling, as a group may hold a large part of all rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def differencing(sizes: np.ndarray, shards: int, start: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """The part of every item by k-way Karmarkar-Karp.

    With ``start``, a partial partition of given part sums takes part too, and parts are named by it; otherwise parts
    are named at random.
    """
    n = len(sizes)
    rng = np.random.default_rng(seed)
    sums: list[np.ndarray] = []
    child: list[tuple[int, int, np.ndarray, np.ndarray] | None] = []
    names = rng.permutation(shards)
    for s in sizes:
        parts = np.zeros(shards)
        parts[0] = s
        sums.append(parts)
        child.append(None)
    if start is not None:
        # parts that lack equally are taken in random order, so that what buckets leave over doesn't add up
        names = np.lexsort((rng.random(shards), -np.asarray(start, float)))
        sums.append(np.asarray(start, float)[names])
        child.append(None)
    if not sums:
        return np.zeros(0, np.int32)
    heap = [(-(p[0] - p[-1]), i) for i, p in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        sums[a] = sums[b] = None
        sums.append(both[order])
        child.append((a, b, order, shards - 1 - order))
        heapq.heappush(heap, (-(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    # downwards: where[i][p] is the final part of part p of partial partition i
    where: dict[int, np.ndarray] = {len(sums) - 1: np.arange(shards)}
    part = np.zeros(n, np.int32)
    anchor = np.arange(shards)
    for i in range(len(sums) - 1, -1, -1):
        final = where.pop(i)
        if child[i] is None:
            if i < n:
                part[i] = final[0]
            else:
                anchor = final
            continue
        a, b, in_a, in_b = child[i]
        for c, place in ((a, in_a), (b, in_b)):
            own = np.empty(shards, np.int64)
            own[place] = final
            where[c] = own
    named = np.empty(shards, np.int32)
    named[anchor] = names
    return named[part]


def fill_level(large: np.ndarray, rest: float) -> np.ndarray:
    """What each shard lacks up to a common level, such that all lacks sum to ``rest``; full shards lack nothing."""
    order = np.sort(large)
    for k in range(len(order), 0, -1):
        level = (rest + order[:k].sum()) / k
        if k == len(order) and level >= order[-1] or k < len(order) and order[k - 1] <= level <= order[k]:
            return np.maximum(level - large, 0)
    return np.full(len(large), rest / len(large))


def shard_by_bytes(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", overhead: int = 16, groups_per_bucket: int = 2500, max_large: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(value) + overhead).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(value, 256)).alias("key")
    )
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total, n = groups.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    limit = max(1, total / max_large)
    buckets = max(1, -(-n // groups_per_bucket))

    def place_large(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        return pdf.assign(shard=differencing(pdf["bytes"].to_numpy(float), shards))[["key", "bytes", "shard"]]

    large = checkpointed(groups.where(F.col("bytes") > limit).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(place_large, "key binary, bytes bigint, shard int"))
    have = np.zeros(shards)
    for s, b in large.groupBy("shard").agg(F.sum("bytes")).collect():
        have[s] = b
    lack = fill_level(have, total - have.sum()) / buckets
    start = lack.max() - lack

    def place_small(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        return pdf.assign(shard=differencing(pdf["bytes"].to_numpy(float), shards, start, int(key[0])))[["key", "shard"]]

    small = groups.where(F.col("bytes") <= limit).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    placed = small.groupBy("bucket").applyInPandas(place_small, "key binary, shard int").unionByName(large.select("key", "shard"))
    out = rows.join(placed, "key").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(buckets)).alias("part"))
    out = checkpointed(out)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return out.withColumn("at", inside).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"))
