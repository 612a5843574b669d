"""Operator 11: the prefix trie of conversations, by Patricia construction.

Equal sequences of turns become one row with the number and the smallest id of its conversations. These rows are range-partitioned and
sorted; the common prefix of neighbours tells where paths part. A task walks its range once and holds only the path to the present row: it
makes a point where sequences part, end or end for good, and closes it when the order has left it. Closing a point adds to the one above:
conversations, leaves, and bytes below, once for every conversation and once for every node, whose difference is what sharing saves. Then the
nodes within the edge to a point are written from the point's figures and sums of bytes from the edge's end upwards.

Ranges share only the prefixes of the rows at their borders. These prefixes are points of their own in every range that has them; their parts
are added up afterwards by a key of the prefix, and nodes directly below them learn their parent's id then. So a first turn that a third of all
conversations begin with is cut by range like any other.

Order within a conversation is by turn, null first, then by a digest of role and text; null role or text count as empty. Rows without a
conversation id take no part; an empty table has no node. Turns are compared by 128-bit digests. One conversation travels as one row of 24 bytes a
turn; texts stay where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, share, written

#: Hash of no conversation ending at a node.
NOBODY = hashlib.sha256(b"").hexdigest()
#: Border prefixes up to this many are broadcast, more are joined by shuffle.
SMALL = 300_000


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, its ordered turns as structs of digest (binary) and bytes (of the text)."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Every conversation with its first ``shared`` (at most ``most``) turns taken from conversation ``base``, as far as that has them."""
    first = own.select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__first"))
    rows = own.withColumns({"__b": base, "__h": shared.cast("int")}).join(first, F.col("__b") == F.col("__base"), "left")
    rest = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("__first", F.lit(1), F.col("__h")), F.slice("turns", 1, 0)), rest).alias("turns"))


# --- Conversations of every sequence ------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id) to (seq, first, n, ids): runs of at most ``most`` ids, joined."""
    seq, ids, out = None, [], []

    def cut() -> None:
        if ids:
            out.append((seq, ids[0], len(ids), ",".join(map(str, ids))))
            ids.clear()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["seq", "first", "n", "ids"])

    for batch in batches:
        for s, i in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()):
            if s != seq or len(ids) >= most:
                cut()
                seq = s
            ids.append(i)
        if len(out) >= 1024:
            yield flush()
    cut()
    yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to (conv_id, n, ends): the smallest id, the number of ids and the hash of all of them, as a stream."""
    seq, first, n, state, out = None, 0, 0, None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "n", "ends"])

    for batch in batches:
        for s, f, k, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "first", "n", "ids"))):
            if s != seq:
                if state is not None:
                    out.append((first, n, state.hexdigest()))
                seq, first, n, state = s, f, 0, hashlib.sha256()
            elif n:
                state.update(b",")
            state.update(ids.encode())
            n += k
        if len(out) >= 4096:
            yield flush()
    if state is not None:
        out.append((first, n, state.hexdigest()))
    yield flush()


# --- The walk of a range -----------------------------------------------------------------------------------------------


@dataclass
class Point:
    """A branch, end or border point on the path to the present row. What is below is counted without the point's own turn."""

    depth: int
    first: bool  # holds the first row of the range
    n: int = 0
    conv: int | None = None
    leaves: int = 0
    shared: int = 0  # bytes below, once for every conversation
    once: int = 0  # bytes below, once for every node that this range is the first to have
    branches: int = 0  # rows that part from their predecessor here
    ends: str | None = None
    key: bytes | None = None
    waiting: list = field(default_factory=list)  # rows of nodes right below, until this point's conv is known

    def add_row(self, conv: int | None, n: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


FIELDS = [
    ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("own", pa.int64()), ("ends_sha256", pa.string()),
]
SCHEMA = "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, own bigint, ends_sha256 string"


class Walk:
    """One range of rows in order. ``left`` and ``right`` are the lengths of the prefixes that its first and last row share with the
    neighbouring ranges, -1 where there is none.

    ``out`` gets tuples in the order of FIELDS. Rows without a key are whole nodes. Rows with a key are a range's part of a border
    point: their n_children are one too few and their saved_tokens lack the point's own turn, of ``own`` bytes.
    """

    def __init__(self, left: int, right: int):
        self.left, self.right = left, right
        self.path = [Point(d, True) for d in range(max(0, left) + 1)]
        self.digests: list[bytes] | None = None
        self.sums: list[int] = [0]  # bytes of the first d turns of the present row
        self.out: list[tuple] = []

    def key(self, point: Point) -> bytes:
        if point.key is None:
            point.key = hashlib.md5(b"".join(self.digests[: point.depth])).digest()
        return point.key

    def border(self, point: Point, closing: bool) -> bool:
        return point.depth == 0 or point.first and point.depth <= self.left or closing and point.depth <= self.right

    def close(self, depth: int, closing: bool = False) -> None:
        """Close all points below ``depth`` on the path, and have a point at ``depth``."""
        while self.path[-1].depth > depth:
            p = self.path.pop()
            if self.path[-1].depth < depth:
                self.path.append(Point(depth, p.first))
            up = self.path[-1]
            if p.ends is not None and not p.branches and not (closing and p.depth == self.right):
                p.leaves += 1
            known = min(p.depth, max(up.depth, self.left)) if p.first else up.depth  # so many turns are nodes of earlier ranges
            up.add_row(p.conv, p.n)
            up.leaves += p.leaves
            up.shared += p.shared + p.n * (self.sums[p.depth] - self.sums[up.depth])
            up.once += p.once + self.sums[p.depth] - self.sums[known]
            self.write(p, up, closing)

    def write(self, p: Point, up: Point, closing: bool) -> None:
        """The rows of a closed point and of the nodes between it and the point above."""
        above = self.key(up) if self.border(up, closing) else None
        size = lambda d: self.sums[d] - self.sums[d - 1]
        part = self.border(p, closing)
        if part:
            self.out.append((self.key(p), above, p.conv, p.depth, None, p.n, p.branches - (p.ends is not None), p.leaves, p.shared - p.once, size(p.depth), p.ends))
        self.settle(p, part)
        if part:
            return
        saved, children, ends = p.shared - p.once, p.branches + 1 - (p.ends is not None), p.ends or NOBODY
        for d in range(p.depth, up.depth, -1):
            saved += (p.n - 1) * size(d)
            top = d == up.depth + 1
            row = (None, above if top else None, p.conv, d, None if top else p.conv, p.n, children, p.leaves, saved, None, ends)
            (up.waiting if top and above is None else self.out).append(row)
            children, ends = 1, NOBODY

    def settle(self, p: Point, part: bool) -> None:
        self.out += [(None, self.key(p) if part else None, *r[2:4], None if part else p.conv, *r[5:]) for r in p.waiting]
        p.waiting = []

    def take(self, digests: list[bytes], sizes: list[int], conv: int, n: int, ends: str) -> None:
        first = self.digests is None
        if not first:
            common = next((i for i, (a, b) in enumerate(zip(self.digests, digests)) if a != b), min(len(self.digests), len(digests)))
            self.close(common)
        if not first or self.left >= 0:
            self.path[-1].branches += 1
        self.digests, self.sums = digests, [0, *accumulate(sizes)]
        if len(digests) > self.path[-1].depth:
            self.path.append(Point(len(digests), first))
        self.path[-1].add_row(conv, n)
        self.path[-1].ends = ends

    def finish(self) -> None:
        if self.digests is None:
            return
        for depth in range(max(0, self.right), -1, -1):
            self.close(depth, True)
        root = self.path[0]
        if root.ends is not None and not root.branches and self.right < 0:
            root.leaves += 1
        self.out.append((self.key(root), None, root.conv, 0, None, root.n, root.branches - (root.ends is not None), root.leaves, root.shared - root.once, 0, root.ends))
        self.settle(root, True)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


# --- The operator ----------------------------------------------------------------------------------------------------------


def trie(conversations: DataFrame, per_range: int = 100_000) -> DataFrame:
    """The nodes of conversations (conv_id, turns as of ``sequences``): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. A range holds about ``per_range`` turns."""
    whole = F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")
    rows = written(conversations.select("conv_id", F.md5(whole.cast("binary")).alias("seq"), F.transform("turns", lambda x: x["digest"]).alias("digests"), F.transform("turns", lambda x: x["bytes"]).alias("sizes")))
    total, turns = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()
    parts = max(1, -(-(total + turns) // per_range))
    # a sequence of very many conversations is cut by id; its chunks, a thousandth of the ids, meet in one stream
    chunks = rows.select("seq", "conv_id").repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_chunks, "seq string, first bigint, n bigint, ids string")
    classes = chunks.repartition(parts, "seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed, "conv_id bigint, n bigint, ends string")
    distinct = rows.drop("seq").join(classes, "conv_id")
    placed = checkpointed(distinct.repartitionByRange(parts, "digests", "conv_id").sortWithinPartitions("digests").withColumn("part", F.spark_partition_id()))
    by = Window.orderBy("part")  # a row a range
    edges = placed.groupBy("part").agg(F.min("digests").alias("a"), F.max("digests").alias("z"))
    edges = edges.select("part", F.when(F.lag("z").over(by).isNull(), -1).otherwise(common_prefix(F.lag("z").over(by), F.col("a"))).alias("left"), F.when(F.lead("a").over(by).isNull(), -1).otherwise(common_prefix(F.col("z"), F.lead("a").over(by))).alias("right"))
    sent = share(rows, {r["part"]: (r["left"], r["right"]) for r in edges.collect()})  # two numbers a range

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Walk | None = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*own.out)) or [[] for _ in FIELDS]
            own.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS)], [f for f, _ in FIELDS])

        for batch in batches:
            for part, digests, sizes, conv, n, ends in zip(*(batch.column(c).to_pylist() for c in ("part", "digests", "sizes", "conv_id", "n", "ends"))):
                own = own or Walk(*sent()[part])
                own.take(digests, sizes, conv, n, ends)
                if len(own.out) > 10_000:
                    yield flush()
        if own:
            own.finish()
            yield flush()

    nodes = written(placed.mapInArrow(walk, SCHEMA))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    border = nodes.where("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), (F.sum("n_children") + 1).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        (F.sum("saved_tokens") + (F.sum("n_convs") - 1) * F.max("own")).alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(NOBODY)).alias("ends_sha256"),
    )
    border = checkpointed(border)
    ids = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    ids = F.broadcast(ids) if border.count() <= SMALL else ids
    inner = nodes.where("key is null and parent_key is null").select(*result)
    below = nodes.where("key is null and parent_key is not null").drop("parent_conv_id").join(ids, "parent_key").select(*result)
    return inner.unionByName(below).unionByName(border.join(ids, "parent_key", "left").select(*result))
