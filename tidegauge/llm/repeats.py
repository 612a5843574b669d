"""Operator 3: removal of repeated byte strings, found with suffix arrays of shards.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the corpus is removed. Strings
don't cross documents and are judged on the input. Windows (places where a whole string starts) are brought together
before anything is compared:

1. *Anchors.* The smallest hash of the 32-byte strings inside a window is its anchor, the leftmost at a tie; windows
   with the same content have it at the same offset. Runs of windows with one anchor are split by the side of the
   anchor that has more room, and keyed by a hash of 200 or more bytes there, so equal windows have equal keys. A key
   that occurs once has no repeat.
2. *Equal runs.* Runs with the same key and the same bytes are repeats of each other as a whole. This takes care of
   copies: it is an aggregation that combines before the shuffle.
3. *Shards.* Where a key has runs of different content, one of each goes to a shard. There, runs are cut into slices of
   windows by their distance to the anchor. Slices whose common bytes (all but ``SLICE`` of a window's) occur once are
   dropped, and equal slices are kept once, as repeats. The suffix array of the rest (induced sorting) and its permuted
   common prefixes show which windows recur. Slices end in a separator, which no window covers, so matches don't cross.
4. *Hot keys.* A key with more bytes of different runs than ``hot_bytes`` would make one shard too large; its windows
   are compared by 128-bit fingerprints in an aggregation instead. No window is left out.

Passages of a number of words, of any length in bytes, are found the same way among codes of words (``repeated_words``).

Documents with equal texts are one class, and repeats as a whole if they have a window. Keys are recognised by 64-bit
hashes, equal texts by two, runs by key and content (128 bits). Null texts count as empty. A text shorter than
``length`` keeps all its bytes. Repeated rows come out as often as they go in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mix64, powers, prefix_hashes, slice_hashes
from .suffix_array import permuted_lcp, suffix_array
from .words import text_blocks, word_hashes

GRAM = 32
PLACE_BITS = np.uint64(28)
#: Bytes of a word's code.
CODE = 4
#: Windows of a slice.
SLICE = 50
#: Bytes of text handled at once; longer texts go in overlapping pieces.
BLOCK, PIECE = 1 << 20, 1 << 26


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, distance from the first window to the anchor, key, content) of all keyed runs."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    start = np.cumsum(size) - size
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = (slice_hashes(prefix, at, at + GRAM) & ~np.uint64((1 << int(PLACE_BITS)) - 1)) | at.astype(np.uint64)
    low = sliding_min(gram, length - GRAM + 1)
    piece = np.repeat(np.arange(len(pieces)), size)[: len(low)]
    valid = np.arange(len(low)) + length <= (start + size)[piece]
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    end = np.append(first[1:], len(low))
    first, end = first[valid[first]], end[valid[first]]
    if not len(first):
        return none
    anchor = (low[first] & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    half = length // 2
    cut = np.clip(anchor - half, first, end)  # windows from here on have the room on the right
    right = cut < end
    left = first < cut
    r_key = mix64(slice_hashes(prefix, anchor[right], anchor[right] + half) + np.uint64(1))
    l_key = mix64(slice_hashes(prefix, anchor[left] - half, anchor[left] + GRAM) + np.uint64(2))
    a, b = np.concatenate([cut[right], first[left]]), np.concatenate([end[right], cut[left]])
    content = slice_hashes(prefix, a, b - 1 + length)
    owner = piece[a]
    return owner, a - start[owner], b - a, np.concatenate([anchor[right], anchor[left]]) - a, np.concatenate([r_key, l_key]), content


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Blocks of (text number, offset, bytes)."""
    who, off, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), PIECE):
            p = t[o : o + PIECE + length - 1]
            if held and held + len(p) > BLOCK:
                yield who, off, parts
                who, off, parts, held = [], [], [], 0
            who.append(i)
            off.append(o)
            parts.append(p)
            held += len(p)
    if parts:
        yield who, off, parts


def _all_runs(classes: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            _, first = np.unique(cls, return_index=True)  # equal texts of a batch once
            raw = [batch.column("__text")[int(i)].as_py() for i in first]
            own = cls[first]
            for who, off, parts in _pieces(raw, length):
                piece, at, n, far, key, content = runs(parts, length)
                who_, off_ = np.array(who)[piece], np.array(off)[piece]
                yield pa.RecordBatch.from_arrays([pa.array(own[who_]), pa.array(at + off_), pa.array(n.astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))], ["cls", "at", "n", "far", "key", "content"])

    return classes.select("cls", F.col("__text").cast("binary").alias("__text")).where(F.octet_length("__text") >= length).mapInArrow(run, "cls bigint, at bigint, n int, far int, key bigint, content bigint")


def _with_bytes(wanted: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """The wanted runs (cls, at, n, ...) with their bytes."""
    ids = checkpointed(wanted.select("cls").distinct())
    ids = F.broadcast(ids) if ids.count() <= 300_000 else ids
    texts = classes.join(ids, "cls", "left_semi").groupBy("cls").agg(F.first("__text").alias("__text"))
    byte = F.col("__text").cast("binary")
    return wanted.join(texts, "cls").withColumn("bytes", F.substring(byte, F.col("at").cast("int") + 1, F.col("n") + length - 1)).drop("__text")


def repeated_in_shard(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of windows of one shard that recur in it."""
    parts = pdf["bytes"].tolist()
    size = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    start = np.cumsum(size) - size
    n, far, key = pdf["n"].to_numpy(np.int64), pdf["far"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64).view(np.uint64)
    # slices: windows whose distance to the anchor is in [SLICE * r, SLICE * (r + 1))
    high, low = far // SLICE, (far - n + 1) // SLICE
    count = high - low + 1
    run = np.repeat(np.arange(len(parts)), count)
    r = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    first = far[run] - np.minimum(far[run], SLICE * (r + 1) - 1)  # windows of the slice, counted within the run
    last = far[run] - np.maximum(far[run] - n[run] + 1, SLICE * r)
    prefix = prefix_hashes(data)
    common = start[run] + far[run] - SLICE * r
    name = key[run] ^ mix64(r.astype(np.uint64))
    probe = mix64(slice_hashes(prefix, common, common + length - SLICE + 1) ^ name)
    content = mix64(slice_hashes(prefix, start[run] + first, start[run] + last + length) ^ name ^ np.uint64(1))
    many = pdf["many"].to_numpy(bool)[run]
    # a slice that no other shares its common bytes with has no repeat here; nor is there one to find if all are known
    _, group, copies = np.unique(probe, return_inverse=True, return_counts=True)
    open_ones = np.bincount(group, weights=~many, minlength=len(copies))
    alive = (copies[group] > 1) & (open_ones[group] > 0)
    run, first, last, content, many = run[alive], first[alive], last[alive], content[alive], many[alive]
    _, at, group, copies = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
    equal = (copies > 1)[group] & ~many
    cls, base = pdf["cls"].to_numpy(), pdf["at"].to_numpy()
    found = [pd.DataFrame({"cls": cls[run[equal]], "at": base[run[equal]] + first[equal], "n": (last - first + 1)[equal].astype(np.int32)})]
    if len(at):
        # neighbouring slices of a run go as one text
        at = at[np.lexsort((first[at], run[at]))]
        opens = np.concatenate([[True], (run[at][1:] != run[at][:-1]) | (first[at][1:] != last[at][:-1] + 1)])
        a, b = at[opens], at[np.append(opens[1:], True)]
        found.append(_by_suffix_array(data, start[run[a]] + first[a], last[b] - first[a] + 1, length, cls[run[a]], base[run[a]] + first[a]))
    return pd.concat(found)


def _by_suffix_array(data: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int, cls: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Windows that recur among the given slices of data."""
    size = windows + length  # with a separator
    place = np.cumsum(size) - size
    source = np.minimum(np.repeat(start - place, size) + np.arange(size.sum()), len(data) - 1)
    text = data[source].astype(np.int32) + 2
    text[place + size - 1] = 1
    text = np.append(text, 0)
    phi, lcp = permuted_lcp(text, suffix_array(text), length)
    # a window's bytes hold no separator, so what precedes it in order with them is a window too
    own = np.arange(len(text) - 1) - np.repeat(place, size) < np.repeat(windows, size)
    hit = np.flatnonzero((lcp[:-1] >= length) & own)
    twice = np.zeros(len(text), bool)
    twice[hit] = twice[phi[hit]] = True
    return _window_runs(twice, place, cls, at)


def _window_runs(twice: np.ndarray, start: np.ndarray, cls: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    edge = np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(start, first, "right") - 1
    return pd.DataFrame({"cls": cls[owner], "at": at[owner] + first - start[owner], "n": (end - first).astype(np.int32)})


def gram_slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of slices of eight bytes and more from the mixed hashes of their 8-byte strings: independent of ``slice_hashes``, whose
    sums of bytes collide for some regular texts."""
    at = np.arange(max(0, len(data) - 7))
    symbol = slice_hashes(prefix_hashes(data), at, at + 8)
    up, down = powers(len(symbol) + 1)
    prefix = np.zeros(len(symbol) + 1, np.uint64)
    np.cumsum(symbol * up[: len(symbol)], out=prefix[1:])
    return mix64((prefix[end - 7] - prefix[start]) * down[start] + np.uint64(3))


def _windows_of_hot(hot: DataFrame, length: int) -> DataFrame:
    """Repeated windows of hot keys by fingerprints: (cls, at, n = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = np.frombuffer(batch.column("bytes")[i].as_py(), np.uint8)
                n = batch.column("n")[i].as_py()
                p = np.arange(n)
                one = slice_hashes(prefix_hashes(data), p, p + length)
                two = gram_slice_hashes(data, p, p + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("cls")[i].as_py(), np.int64)), pa.array(p + batch.column("at")[i].as_py()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["cls", "at", "one", "two"])

    windows = checkpointed(hot.select("cls", "at", "n", "bytes").mapInArrow(run, "cls bigint, at bigint, one bigint, two bigint"))
    place = F.struct("cls", "at")
    twice = windows.groupBy("one", "two").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    return windows.join(twice.select("one", "two"), ["one", "two"]).select("cls", "at", F.lit(1).alias("n"))


def repeated_runs(classes: DataFrame, length: int = 400, shard_bytes: int = 2_000_000, hot_bytes: int = 64_000_000) -> DataFrame:
    """(cls, at, n): runs of windows of distinct texts (cls, __text: string or binary) whose strings start elsewhere too."""
    rows = checkpointed(_all_runs(classes, length))
    place = F.struct("cls", "at")
    # a table of its own, so that the join has a shuffle on either side and the rows of a hot key can be split over tasks
    keys = checkpointed(rows.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("key"))
    rows = checkpointed(rows.join(keys, "key", "left_semi"))
    stats = rows.groupBy("key", "content").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.first("n").alias("n"), F.first("far").alias("far"))
    stats = checkpointed(stats.select("key", "content", "n", "far", (F.col("low") != F.col("high")).alias("many"), F.col("low.cls").alias("cls"), F.col("low.at").alias("at")))
    whole = rows.join(stats.where("many").select("key", "content"), ["key", "content"]).select("cls", "at", "n").distinct()
    mixed = stats.groupBy("key").agg(F.count(F.lit(1)).alias("contents"), F.bool_and("many").alias("all_many"), F.sum(F.col("n") + length).alias("bytes")).where("contents > 1 and not all_many").select("key", "bytes")
    wanted = checkpointed(stats.join(mixed, "key").select("key", "many", "cls", "at", "n", "far", (F.col("bytes") > hot_bytes).alias("hot")))
    total, any_hot = wanted.agg(F.sum(F.col("n") + length), F.max("hot")).first()
    out = whole
    if total:
        shards = max(1, -(-total // shard_bytes))
        filled = _with_bytes(wanted.where("not hot"), classes, length)
        sharded = filled.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        out = out.unionByName(sharded.groupBy("shard").applyInPandas(lambda pdf: repeated_in_shard(pdf, length), "cls bigint, at bigint, n int"))
    if any_hot:
        out = out.unionByName(_windows_of_hot(_with_bytes(wanted.where("hot"), classes, length), length))
    return out


def repeated_words(docs: DataFrame, words: int = 51, text: str = "text", **limits: int) -> DataFrame:
    """cls, n_repeated_words for every distinct text with such words (cls is its xxhash64): how many of its words lie in passages of
    ``words`` and more words that also start anywhere else, whatever the bytes of the passage and the white space and case in it.

    Words become codes of four bytes each, so that passages of words are byte strings for ``repeated_runs``. Two words share
    a code by chance once in 2**32. Texts that occur more than once are repeats as a whole.
    """
    size = CODE * words
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("cls", F.xxhash64("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 256):
                some = batch.slice(part, 256)
                texts = some.column("__text").to_pylist()
                for low, high in text_blocks(texts):
                    hashes, bounds = word_hashes(texts[low:high])
                    codes = mix64(hashes).astype("<u4")
                    long = np.flatnonzero(np.diff(bounds) >= words)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("cls").take(pa.array(long + low)), pa.array([codes[bounds[i] : bounds[i + 1]].tobytes() for i in long], pa.binary())], ["text_cls", "__text"]
                    )

    coded = checkpointed(source.mapInArrow(run, "text_cls bigint, __text binary").withColumn("cls", F.xxhash64("__text")))
    texts = coded.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.first(F.octet_length("__text")).alias("bytes"))
    runs_of = repeated_runs(coded.select("cls", "__text"), size, **limits).select("cls", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + size).alias("b"))
    # the union of the runs' bytes: what each run adds beyond the furthest end before it
    order = Window.partitionBy("cls").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    covered = runs_of.withColumn("done", F.coalesce(F.max("b").over(order), F.lit(0))).groupBy("cls").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "done"))).alias("covered"))
    counted = texts.join(covered, "cls", "left").select("cls", F.when(F.col("copies") > 1, F.col("bytes")).otherwise(F.coalesce("covered", F.lit(0))).alias("covered"))
    per_text = coded.select("cls", "text_cls").distinct().join(counted, "cls").where("covered > 0")
    return per_text.groupBy(F.col("text_cls").alias("cls")).agg(F.max(F.expr(f"covered div {CODE}")).alias("n_repeated_words"))


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, words: int = 0, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row, and on request kept (binary) and n_repeated_words: see ``repeated_words``."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    source = source.withColumn("cls", F.xxhash64("__text")).withColumn("check", F.xxhash64(F.lit(1), "__text"))
    found = repeated_runs(source.select("cls", "__text"), length, **limits)
    copies = source.groupBy("cls", "check").count().where("count > 1").select("cls", F.col("check").alias("copied")).dropDuplicates(["cls"])
    per_class = found.groupBy("cls").agg(F.collect_list(F.struct("at", "n")).alias("runs")).join(copies, "cls", "full")
    per_class = checkpointed(per_class)  # as above: the rows of a hot text can be split
    joined = source.join(per_class, "cls", "left").select("doc_id", "__text", "runs", F.coalesce(F.col("copied") == F.col("check"), F.lit(False)).alias("copied"), *(["cls"] if words else []))
    if words:
        repeated = checkpointed(repeated_words(source, words, "__text", **limits))
        joined = joined.join(repeated, "cls", "left").withColumn("n_repeated_words", F.coalesce("n_repeated_words", F.lit(0).cast("long")))
    fields = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text + ", n_repeated_words bigint" * bool(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, r, copied in zip(batch.column("__text"), batch.column("runs").to_pylist(), batch.column("copied").to_pylist()):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                if copied and len(raw) >= length:
                    spans = [[0, len(raw)]]
                else:
                    for x in sorted((x["at"], x["at"] + x["n"] - 1 + length) for x in r or ()):
                        if spans and x[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], x[1])
                        else:
                            spans.append(list(x))
                kept, last = [], 0
                for a, b in spans:
                    kept.append(raw[last:a])
                    last = b
                kept.append(raw[last:])
                left = b"".join(kept)
                rows.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            more = ["n_repeated_words"] if words else []
            columns = [batch.column("doc_id"), *(pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)), *(batch.column(c) for c in more)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text] + more)

    return joined.mapInArrow(run, fields)
