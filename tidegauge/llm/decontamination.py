"""Operator 6: benchmark decontamination by SimHash windows and exact weighted-shingle similarity.

For every benchmark item of w words, windows of w words (the whole text if it is shorter) are fingerprinted with a
64-bit SimHash of their shingles. Fingerprints and item fingerprints are cut into radius + 1 blocks; two of them
within the radius agree in a block, so looking up each block finds every item within the radius. Candidates are
verified by the weighted Jaccard similarity of shingle counts (sum of the smaller over sum of the larger counts).

Only windows that hold at least one shingle of an item of their size are fingerprinted; the others have similarity 0.
Words and shingles are as in ``words``: items of fewer than five words are one shingle, and match equal word
sequences. Null and empty texts and items match nothing. One row comes out for each row of documents and item with a
window of the least similarity or more: its best window, the first at a tie.

Items are broadcast in blocks of at most ``max_items``, each with one scan of the documents; there is no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share
from .words import SHINGLE, grams, text_blocks, word_hashes


def simhash(bit_sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from how many of n features set each of the 64 bits."""
    return np.packbits(2 * bit_sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_prefix(features: np.ndarray) -> np.ndarray:
    """Running sums of the bits of 64-bit features: row i holds those of the first i."""
    bits = np.unpackbits(np.ascontiguousarray(features).view(np.uint8), bitorder="little").reshape(-1, 64)
    out = np.zeros((len(features) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


class BlockIndex:
    """Multi-index of fingerprints: all within ``radius`` of a query share one of its radius + 1 blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.shift = edges[:-1].astype(np.uint64)
        self.mask = np.array([(1 << int(b - a)) - 1 for a, b in zip(edges[:-1], edges[1:])], np.uint64)
        self.order, self.keys = [], []
        for s, m in zip(self.shift, self.mask):
            key = (prints >> s) & m
            order = np.argsort(key, kind="stable")
            self.order.append(order)
            self.keys.append(key[order])

    def near(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, fingerprint number) of all pairs within the radius."""
        found = [np.zeros(0, np.int64)]
        for s, m, order, keys in zip(self.shift, self.mask, self.order, self.keys):
            key = (query >> s) & m
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.repeat(np.arange(len(query)), n) * len(self.prints) + order[at])
        pair = np.unique(np.concatenate(found))
        q, i = np.divmod(pair, max(1, len(self.prints)))
        near = np.bitwise_count(query[q] ^ self.prints[i]) <= self.radius
        return q[near], i[near]


class Detector:
    """Benchmark items prepared for scanning."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int, least: float):
        self.least = least
        words, bounds = word_hashes([t for _, t in items])
        kept = [(i, words[a:b]) for (i, _), a, b in zip(items, bounds[:-1], bounds[1:]) if b > a]
        self.ids = [i for i, _ in kept]
        self.size = np.array([len(w) for _, w in kept], np.int64)
        features = [grams(w, min(SHINGLE, len(w))) for _, w in kept]
        self.count = [Counter(f.tolist()) for f in features]
        prints = np.concatenate([simhash(bit_prefix(f)[-1:], np.array([len(f)])) for f in features]) if kept else np.zeros(0, np.uint64)
        self.by_size = {int(w): np.flatnonzero(self.size == w) for w in np.unique(self.size)}
        self.index = {w: BlockIndex(prints[own], radius) for w, own in self.by_size.items()}
        # which item sizes a shingle occurs in, by shingle length
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(SHINGLE, int(w)) for w in self.size}):
            pairs = sorted({(g, len(w)) for f, (_, w) in zip(features, kept) if min(SHINGLE, len(w)) == k for g in f.tolist()})
            gram = np.array([g for g, _ in pairs], np.uint64)
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if pairs else np.zeros(0, np.int64)
            self.known[k] = (gram[first], np.append(first, len(pairs)), np.array([w for _, w in pairs], np.int64))
        self.maybe = {k: self._bitmap(g) for k, (g, _, _) in self.known.items()}

    @staticmethod
    def _bitmap(gram: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[gram >> np.uint64(44)] = True
        return out

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text number, item id, first word, words, similarity)."""
        for low, high in text_blocks(texts):
            words, bounds = word_hashes(texts[low:high])
            for k, (known, first, sizes) in self.known.items():
                g = grams(words, k)
                hit = np.flatnonzero(self.maybe[k][g >> np.uint64(44)])
                at = np.minimum(np.searchsorted(known, g[hit]), len(known) - 1)
                good = known[at] == g[hit]
                hit, at = hit[good], at[good]
                doc = np.searchsorted(bounds, hit, "right") - 1
                inside = hit + k <= bounds[doc + 1]
                hit, at, doc = hit[inside], at[inside], doc[inside]
                cut = np.flatnonzero(np.diff(doc, prepend=-1))
                for a, b in zip(cut, np.append(cut[1:], len(doc))):
                    d = int(doc[a])
                    own = g[bounds[d] : bounds[d + 1] - k + 1]
                    for item, start, n, sim in self._text(own, k, hit[a:b] - bounds[d], at[a:b], first, sizes):
                        yield low + d, self.ids[item], start, n, sim

    def _text(self, own: np.ndarray, k: int, hit: np.ndarray, at: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        total = len(own) + k - 1  # words of the text
        by_size: dict[int, list[int]] = {}
        for h, x in zip(hit.tolist(), at.tolist()):
            for w in sizes[first[x] : first[x + 1]].tolist():
                by_size.setdefault(w, []).append(h)
        sums = bit_prefix(own)
        best: dict[int, tuple[float, int, int]] = {}
        for w, hits in by_size.items():
            n = min(w, total)
            span = n - k + 1  # shingles of a window
            delta = np.zeros(len(own) + 2, np.int32)
            h = np.array(hits)
            np.add.at(delta, np.maximum(0, h - span + 1), 1)
            np.add.at(delta, np.minimum(h, total - n) + 1, -1)
            start = np.flatnonzero(np.cumsum(delta)[: total - n + 1] > 0)
            prints = simhash(sums[start + span] - sums[start], np.full(len(start), span))
            q, i = self.index[w].near(prints)
            for s, item in zip(start[q].tolist(), self.by_size[w][i].tolist()):
                sim = self._similarity(own[s : s + span], item)
                if sim >= self.least and (item not in best or sim > best[item][0]):
                    best[item] = (sim, s, n)
        for item, (sim, s, n) in sorted(best.items()):
            yield item, s, n, sim

    def _similarity(self, window: np.ndarray, item: int) -> float:
        mine, other = Counter(window.tolist()), self.count[item]
        both = sum(min(c, other[g]) for g, c in mine.items() if g in other)
        return both / (len(window) + sum(other.values()) - both)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, radius: int = 23, max_items: int = 20_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity of the best window of each contaminated document and item."""
    items = benchmark.where(F.col(item_id).isNotNull()).groupBy(F.col(item_id).alias("i"), F.col(item_text).alias("t")).count().select("i", "t")
    blocks = max(1, -(-items.count() // max_items))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, start_word int, n_words int, similarity double"
    parts = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        shared = share(docs, (sorted(((r["i"], r["t"]) for r in own), key=repr), radius, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            detector = Detector(*shared())
            for batch in batches:
                found = list(detector.scan(batch.column("__text").to_pylist()))
                rows = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), *(pa.array([x[j] for x in found], t) for j, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.float64())))], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        parts.append(source.mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
