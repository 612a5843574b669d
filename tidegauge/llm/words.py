"""Words and 5-word shingles of whole texts as 64-bit hashes, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, over the UTF-8 bytes. A shingle is the hash of five consecutive
words; a text with one to four words has one shingle, its whole sequence. Null texts count as empty and have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import BYTE_MIX, mix64, powers

SHINGLE = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
#: Bytes of text handled at once.
BLOCK = 500_000


def text_blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters, or one longer text."""
    low = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield low, i
            low, held = i, 0
        held += n
    if low < len(texts):
        yield low, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of the first word of every text (and of the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    start = 1 + np.cumsum(size + 1) - size - 1
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, end = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_MIX[data] * up[: len(data)], out=prefix[1:])
    words = mix64((prefix[end] - prefix[first]) * down[first] + (end - first).astype(np.uint64))
    return words, np.append(np.searchsorted(first, start), len(first))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words (k at most 5), regardless of text bounds."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += words[i : i + n] * _PLACE[i]
    return mix64(out)


def shingles(words: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The shingles of every text in order, repeated ones too."""
    all_grams = grams(words, SHINGLE)
    for low, high in zip(bounds[:-1], bounds[1:]):
        n = high - low
        if n >= SHINGLE:
            yield all_grams[low : high - SHINGLE + 1]
        elif n:
            yield grams(words[low:high], int(n))
        else:
            yield all_grams[:0]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text of an Arrow column, some texts at a time."""
    for part in range(0, len(column), 256):
        texts = column.slice(part, 256).to_pylist()
        for low, high in text_blocks(texts):
            words, bounds = word_hashes(texts[low:high])
            for s in shingles(words, bounds):
                if len(s) > 1:
                    s = np.sort(s)
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
                yield s
