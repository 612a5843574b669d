"""Connected components with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, persist

#: Rows of a partition of the tables of a round.
ROWS = 200_000


def components(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(id, component) for every end of the edges (a, b); component is the smallest id that can be reached.

    Random contraction: every node moves to its neighbour (or itself) with the smallest hash, edges follow, and the
    smaller graph is contracted again until no edge is left. The hash changes from round to round, so the number of
    rounds is logarithmic, chains included. A node's neighbourhood is only ever reduced to a minimum, before the
    shuffle, so hubs are no hot spots.
    """
    held: list[DataFrame] = []

    def settled(df: DataFrame, most: int) -> DataFrame:
        """A checkpoint in as many partitions as ``most`` rows need, cached as well: a cached table's size is known, while
        a checkpoint keeps the estimate of the plan behind it, and estimates of joins multiply from round to round
        until they hold up planning."""
        held.append(persist(checkpointed(df.coalesce(max(1, -(-most // ROWS))))))
        return held[-1]

    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    size = edges.count()
    moves: list[DataFrame] = []
    left = edges
    while size:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed + len(moves))).alias("h"), F.col(c).alias("id"))
        move = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("id"), F.least(rank("a"), F.col("near"))["id"].alias("to"))
        move = settled(move, 2 * size)
        move.count()
        moves.append(move)
        to_a, to_b = move.select(F.col("id").alias("a"), F.col("to").alias("na")), move.select(F.col("id").alias("b"), F.col("to").alias("nb"))
        left = settled(left.join(to_a, "a").join(to_b, "b").where("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), size)
        size = left.count()
    if not moves:
        return checkpointed(edges.select(F.col("a").alias("id"), F.col("a").alias("component")))
    where = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("id").alias("to"), F.col("to").alias("next"))
        where = where.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    where = settled(where, moves[0].count())
    where.count()
    least = where.groupBy("to").agg(F.min("id").alias("component"))
    out = checkpointed(where.join(least, "to").select("id", "component"))
    for df in held:
        df.unpersist()
    return out
