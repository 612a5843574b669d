"""Operator 9: exact n-gram Jaccard self-join by universe partitioning and pigeonhole.

A document's set is its distinct 5-word shingles (see ``words``). Two sets of x <= y elements with Jaccard similarity
of at least 3/4 differ in at most (x + y) // 7 elements, and y <= 4x/3.

*Size bands.* Band edges grow by 4/3, so the larger set of a linked pair is in the same band or the next. Each set
takes part in the scheme of its own band and in that of the band below, as a possible larger partner.

*Segments.* A scheme cuts the hash universe into m segments; a set's part of each segment is one signature. Every
differing element spoils at most one segment, so with the signatures of both sets in one global order, the first
H + 1 of each share one (H: the most elements that can differ in the scheme). Only these are indexed. The order is
the cost-based allocation: signatures that consist of frequent shingles alone, and those of empty segments, come last.
Where few elements can differ (small sets), whole segments with their one-deletion neighbourhoods are indexed instead,
as these are far more selective than the single shingles that remain there: two segments that differ in one element
meet in a neighbourhood, so segments with neighbourhoods count twice towards H + 1.

*Buckets.* Signatures travel packed, by bucket of the signature. The sets that share one are a group; equal groups count
once. Few members make all pairs; a larger group makes only pairs with its first member, and is kept for later rounds.
*Verification.* Parity bitmaps give a lower bound of the difference, which drops false candidates without their
sets. Exact verification of a forest of pairs joins most sets of a cluster; of the other candidates only pairs between
sets that are not connected by then are verified. Kept groups that are not connected get rounds of stars around their
best connected member; at last all their pairs that are still apart are verified. So no link that connects different
sets is lost, and no cluster makes all its pairs. Sets are compared by 64-bit shingle hashes.

Null, empty and blank texts have empty sets and no links. Documents with equal sets are one class. A repeated id is
taken as one more document; its component is the smallest of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix64, share
from .components import components
from .words import shingle_sets

#: Sets of up to this many elements use deletion neighbourhoods.
SMALL = 8
#: Groups of up to this many members make all pairs at once.
FEW = 4
#: Members of a part of a group, besides the first.
PART = 1000
#: Signatures of a bucket that are sorted at once.
AT_ONCE = 1 << 17
#: Rounds of stars in large groups before all pairs that are still apart are compared.
STARS = 3
#: Bits of a parity bitmap.
BITS = 1024
#: Ids of hot shingles sent to the tasks: they only order signatures, so the bound can't change a result.
MAX_HOT = 200_000
_SALT = np.uint64(0x9FB21C651E98DF25)


def band_edges(top: int) -> list[int]:
    """First sizes of the bands; band k holds sizes edges[k] to edges[k + 1] - 1."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, 4 * (edges[-1] - 1) // 3 + 1))
    return edges


class Signatures:
    """The indexed signatures of a set."""

    def __init__(self, hot: np.ndarray, level: np.ndarray):
        self.hot, self.level = hot, level  # sorted frequent shingles and how frequent (higher: more)
        self.edges = np.array(band_edges(1 << 26))

    def levels(self, tokens: np.ndarray) -> np.ndarray | None:
        if not len(self.hot):
            return None
        at = np.minimum(np.searchsorted(self.hot, tokens), len(self.hot) - 1)
        same = self.hot[at] == tokens
        return np.where(same, self.level[at], 0) if same.any() else None

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Signatures of a non-empty sorted set in its schemes."""
        x = len(tokens)
        band = int(np.searchsorted(self.edges, x, "right")) - 1
        mixed, levels = mix64(tokens ^ _SALT), self.levels(tokens)
        out = [self._scheme(tokens, mixed, levels, band, (x + 4 * x // 3) // 7)]
        if band and 4 * (int(self.edges[band]) - 1) >= 3 * x:
            out.append(self._scheme(tokens, mixed, levels, band - 1, (x + int(self.edges[band]) - 1) // 7))
        return np.unique(np.concatenate(out))

    def _scheme(self, tokens: np.ndarray, mixed: np.ndarray, levels: np.ndarray | None, band: int, differ: int) -> np.ndarray:
        low, high = int(self.edges[band]), int(self.edges[band + 1]) - 1
        salt = np.uint64((band * 0x9E3779B97F4A7C15) % (1 << 64))
        if high <= SMALL:
            return self._neighbourhoods(tokens, mixed, salt, (high + 4 * high // 3) // 7)
        # two elements a segment; one where sets are small and segments would often be empty
        m = high // 2 if low >= 100 else high if low >= 30 else 16 * high
        segment = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # follows the order of the tokens
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums = np.add.reduceat(mixed, first)
        sig = mix64(sums ^ mix64(segment[first] + salt))
        if levels is not None:
            level = np.minimum.reduceat(levels, first)
            if level.any():
                sig = sig[np.lexsort((sig, level))]
                need = differ + 1
                return self._with_empty(sig, segment[first], m, salt, need)
        if len(sig) > differ + 1:
            return np.partition(sig, differ)[: differ + 1]
        return self._with_empty(sig, segment[first], m, salt, differ + 1)

    @staticmethod
    def _with_empty(sig: np.ndarray, used: np.ndarray, m: int, salt: np.uint64, need: int) -> np.ndarray:
        """The first ``need`` of ordered signatures; empty segments follow all others."""
        if len(sig) >= need:
            return sig[:need]
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), used)
        return np.concatenate([sig, np.sort(mix64(mix64(empty + salt)))[: need - len(sig)]])

    @staticmethod
    def _neighbourhoods(tokens: np.ndarray, mixed: np.ndarray, salt: np.uint64, differ: int) -> np.ndarray:
        """Segments that count once (equal) or twice (one deletion), differ + 1 in all."""
        values = [2] * ((differ + 1) // 2) + [1] * ((differ + 1) % 2)
        segment = ((tokens >> np.uint64(32)) * np.uint64(len(values))) >> np.uint64(32)
        out = []
        for i, value in enumerate(values):
            own = mixed[segment == i]
            name = mix64(np.array([i], np.uint64) + salt)[0]
            total = np.add.reduce(own, dtype=np.uint64) if len(own) else np.uint64(0)
            out.append(np.array([total ^ name], np.uint64))
            if value == 2 and len(own):
                out.append((total - own) ^ name)
        return mix64(np.concatenate(out))


def bitmap(tokens: np.ndarray) -> list[int]:
    """Parity of the tokens that fall on each of BITS bits, as longs: sets that differ in d tokens differ in at most d."""
    odd = np.bincount((tokens >> np.uint64(20)) % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _profile(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each document (kind 0: id, size, two hashes of the set, bitmap) and for each shingle that several
    different sets of a batch share (kind 1: shingle, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            size, one, two, bits, seen = [], [], [], [], {}
            for s in shingle_sets(batch.column("__text")):
                size.append(len(s))
                one.append(int(np.add.reduce(mix64(s), dtype=np.uint64)) if len(s) else 0)
                two.append(int(np.add.reduce(mix64(s ^ _SALT), dtype=np.uint64)) if len(s) else 0)
                bits.append(bitmap(s))
                seen[(len(s), one[-1])] = s
            n = len(ids)
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), ids, pa.array(size, pa.int64()), signed(one), signed(two), pa.array(bits, pa.list_(pa.int64()))], names)
            token, count = np.unique(np.concatenate(list(seen.values())), return_counts=True) if n else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = count > 1
            k = int(often.sum())
            if k:
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), none, pa.array(count[often].astype(np.int64)), signed(token[often]), none, pa.nulls(k, pa.list_(pa.int64()))], names)

    names = ["kind", "doc_id", "n", "one", "two", "bits"]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, "kind int, doc_id bigint, n bigint, one bigint, two bigint, bits array<bigint>")


def _packed(docs: DataFrame, doc_id: str, text: str, hot, buckets: int) -> DataFrame:
    """(bucket, ids, scores, counts, sigs): the signatures of each batch, equal sets once, packed by bucket. The
    score is how many shingles of a set are rare: the fewer, the nearer it is to the centre of a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(*hot())
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            best: dict[tuple[int, int], int] = {}
            sigs, scores = [], np.zeros(len(ids), np.int64)
            for i, s in enumerate(shingle_sets(batch.column("__text"))):
                key = (len(s), int(np.add.reduce(mix64(s), dtype=np.uint64)) if len(s) else 0)
                if not len(s) or key in best and ids[best[key]] <= ids[i]:
                    sigs.append(None)
                    continue
                if key in best:
                    sigs.append(sigs[best[key]])
                    sigs[best[key]] = None
                else:
                    sigs.append(signatures.of(s))
                level = signatures.levels(s)
                scores[i] = len(s) if level is None else int((level == 0).sum())
                best[key] = i
            own = [i for i, s in enumerate(sigs) if s is not None]
            if not own:
                continue
            all_sigs = np.concatenate([sigs[i] for i in own])
            owner = np.repeat(np.array(own), [len(sigs[i]) for i in own])
            bucket = (all_sigs % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own_buckets, first = np.unique(bucket[order], return_index=True)
            edge = np.append(first, len(order))
            rows = {k: [] for k in ("bucket", "ids", "scores", "counts", "sigs")}
            for i, b in enumerate(own_buckets.tolist()):
                part = order[edge[i] : edge[i + 1]]
                docs_in, counts = np.unique(owner[part], return_counts=True)
                rows["bucket"].append(b)
                rows["ids"].append(ids[docs_in].astype(np.int64).tobytes())
                rows["scores"].append(scores[docs_in].astype(np.int32).tobytes())
                rows["counts"].append(counts.astype(np.int32).tobytes())
                rows["sigs"].append((all_sigs[part] >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("ids", "scores", "counts", "sigs"))], list(rows))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text")).where("doc_id is not null").mapInArrow(run, "bucket int, ids binary, scores binary, counts binary, sigs binary")


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The groups of one bucket: sets that share a signature, most central first, in parts that all start with the first,
    each with the members n of its whole group. Signatures with the same members make one group, named by its members.

    Ranges of signatures are sorted one after another: what a task holds beside a bucket's packed bytes is a range's."""
    packed: dict[str, list[bytes]] = {c: [] for c in ("ids", "scores", "counts", "sigs")}
    for pdf in batches:
        for c, parts in packed.items():
            parts.extend(pdf[c])
    cat = lambda c, t: np.frombuffer(b"".join(packed.pop(c)), t)
    ids, scores, counts, sig = cat("ids", np.int64), cat("scores", np.int32), cat("counts", np.int32), cat("sigs", np.uint32)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    ranges = max(1, -(-len(sig) // AT_ONCE))
    span = -(-(1 << 32) // ranges)
    for k in range(ranges):
        own = np.flatnonzero((sig >= k * span) & (sig < (k + 1) * span)) if ranges > 1 else np.arange(len(sig))
        yield _groups(ids[owner[own]], scores[owner[own]], sig[own])


def _groups(ids: np.ndarray, scores: np.ndarray, sig: np.ndarray) -> pd.DataFrame:
    """The groups of a range of signatures."""
    order = np.lexsort((ids, scores, sig))
    ids, sig = ids[order], sig[order]
    rows = []
    if len(sig):
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        length = np.diff(np.append(start, len(sig)))
        name = np.add.reduceat(mix64(ids.view(np.uint64)), start).view(np.int64)
        start, length, name = start[length > 1], length[length > 1], name[length > 1]
        _, one = np.unique(name, return_index=True)
        for s, n, g in zip(start[one].tolist(), length[one].tolist(), name[one].tolist()):
            for part in range(0, n - 1, PART):
                rows.append((g, part, n, np.concatenate([ids[s : s + 1], ids[s + 1 + part : min(s + 1 + part + PART, s + n)]])))
    return pd.DataFrame(rows, columns=["g", "part", "n", "members"])


def _may_link(na: str, nb: str, xa: str, xb: str) -> Column:
    """Whether sizes and bitmaps allow a link."""
    differ = " + ".join(f"bit_count({xa}[{i}] ^ {xb}[{i}])" for i in range(BITS // 64))
    return F.expr(f"least({na}, {nb}) * 4 >= greatest({na}, {nb}) * 3 and ({differ}) * 7 <= {na} + {nb}")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of similarity 3/4 or more, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sa, sb = sets.select(F.col("id").alias("a"), F.col("tokens").alias("sa")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", docs_per_bucket: int = 6000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    profile = checkpointed(_profile(docs, doc_id, text))
    rows = profile.where("kind = 0").select("doc_id", "n", "one", "two", "bits")
    counted = checkpointed(profile.where("kind = 1").groupBy("one").agg(F.sum("n").alias("n")))
    # the most frequent shingles, down to a count that keeps them within the bound
    steps = counted.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()  # a row an eighth of a doubling
    cut, total = 1 << 20, 0
    for r in steps:
        total += r["count"]
        if total > MAX_HOT:
            break
        cut = r["step"]
    hot_rows = counted.where(F.floor(F.log2("n") * 8) >= cut).toPandas()
    token = hot_rows["one"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    hot = share(docs, (token[order], np.log2(hot_rows["n"].to_numpy(float)).astype(np.int64)[order] if len(token) else np.zeros(0, np.int64)))
    classes = checkpointed(rows.where("n > 0 and doc_id is not null").groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")))
    n_classes = classes.count()
    buckets = max(4, -(-n_classes // docs_per_bucket))
    rep_of = rows.where("doc_id is not null").join(classes.drop("bits"), ["n", "one", "two"]).groupBy(F.col("doc_id").alias("id")).agg(F.min("rep").alias("rep"))
    rep_of = checkpointed(rep_of)
    met = checkpointed(_packed(docs, doc_id, text, hot, buckets).groupBy("bucket").applyInPandas(_meet, "g bigint, part int, n bigint, members array<bigint>").dropDuplicates(["g", "part"]))

    def as_reps(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of classes, smaller first."""
        ra, rb = rep_of.select(F.col("id").alias("a"), F.col("rep").alias("ra")), rep_of.select(F.col("id").alias("b"), F.col("rep").alias("rb"))
        out = pairs.select("a", "b").distinct().join(ra, "a").join(rb, "b").where("ra <> rb")
        return out.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    def possible(pairs: DataFrame) -> DataFrame:
        xa = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
        xb = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
        return pairs.join(xa, "a").join(xb, "b").where(_may_link("na", "nb", "xa", "xb")).select("a", "b")

    def set_table(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = [s.tobytes() for s in shingle_sets(batch.column("__text"))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens, pa.binary())], ["id", "tokens"])

        ids = checkpointed(ids)
        small = ids.count() <= 300_000
        own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("__text")).join(F.broadcast(ids) if small else ids, "id", "left_semi")
        # a repeated id may have several texts: only the set of the class counts
        made = own.mapInArrow(run, "id bigint, tokens binary")
        return checkpointed(made.join(classes.select(F.col("rep").alias("id"), "n"), "id").where("octet_length(tokens) = 8 * n").groupBy("id").agg(F.first("tokens").alias("tokens")))

    # all pairs of few members, else those with the first
    star = F.transform(F.slice("members", 2, PART), lambda y: F.struct(F.col("members")[0].alias("a"), y.alias("b")))
    every = F.flatten(F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, FEW), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = met.select(F.explode(F.when(F.col("n") <= FEW, every).otherwise(star)).alias("p"))
    first = checkpointed(possible(as_reps(pairs.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")))))
    sets = set_table(first.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # a forest of pairs first: each class with the smallest one that it meets
    forest = first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = checkpointed(_linked(forest, sets))
    where = components(links)

    def between(pairs: DataFrame, where: DataFrame) -> DataFrame:
        """Pairs that are not connected yet."""
        wa, wb = where.select(F.col("id").alias("a"), F.col("component").alias("ca")), where.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return pairs.join(wa, "a", "left").join(wb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    rest = between(first.join(forest, ["a", "b"], "left_anti"), where)
    links = checkpointed(links.unionByName(_linked(rest, sets)))
    where = components(links)
    # large groups: pairs of members that are still apart
    groups = met.where(F.col("n") > FEW).select("g", F.explode("members").alias("id")).join(rep_of, "id").select("g", "rep").distinct()

    def apart(groups: DataFrame, where: DataFrame) -> DataFrame:
        """The groups that are not connected: (g, rep, c), c the component."""
        own = groups.select("g", "rep").join(where.withColumnRenamed("id", "rep"), "rep", "left").select("g", "rep", F.coalesce("component", "rep").alias("c"))
        mixed = own.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("g")
        return checkpointed(own.join(mixed, "g"))

    def more_links(pairs: DataFrame) -> DataFrame:
        return checkpointed(_linked(pairs, set_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())))

    tried, left = first, apart(groups, where)
    for _ in range(STARS):
        # stars around the member with the most links: most of a cluster hangs on its centre
        ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
        centre = left.join(ends, "rep", "left").groupBy("g").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "rep", "c")).alias("o"))
        stars = left.join(centre, "g").where("c <> o.c").select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b")).distinct()
        stars = checkpointed(possible(stars.join(tried, ["a", "b"], "left_anti")))
        if stars.isEmpty():
            break
        tried = tried.unionByName(stars)
        links = checkpointed(links.unionByName(more_links(stars)))
        where = components(links)
        left = apart(left, where)
    if not left.isEmpty():
        left = left.join(classes.select("rep", "n", "bits"), "rep")
        one, two = (left.select("g", *(F.col(c).alias(c + s) for c in ("rep", "c", "n", "bits"))) for s in ("_a", "_b"))
        rest = one.join(two, "g").where("rep_a < rep_b and c_a <> c_b").where(_may_link("n_a", "n_b", "bits_a", "bits_b"))
        rest = rest.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
        rest = checkpointed(rest.join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links = links.unionByName(more_links(rest))
            where = components(links)
    linked = rep_of.join(where.select(F.col("id").alias("rep"), "component"), "rep", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("component_id"))
    # a class's smallest id may belong to a repeated id: the smallest id of the whole component counts
    return rows.join(linked, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

