"""Operator 1: SentencePiece (BPE with byte fallback) encoding and decoding by a merge-type prefix table.

For every prefix of a piece of text there is exactly one token that can end its encoding. The table stores it:
an automaton gives all vocabulary pieces that end at a position, longest first, and the first one whose left
neighbour (the unique last token of the shorter prefix) is pair-compatible with it is the one. The ids are then
read backwards from the end. Two tokens are pair-compatible when encoding their joined text gives the same two
tokens again.

The text is cut before each run of spaces, across which no piece reaches (checked when the model is loaded; if a
model has such a piece, its whole text is one unit). Distinct units are encoded once and remembered. Runs of
several spaces have tied merge scores, so their merges are replayed leftmost first and remembered by length.

Null and empty texts give no ids and the empty text. Characters without a piece become byte pieces. Rows are
independent: no shuffle, no driver work beyond reading the model file, which is broadcast (one fixed file).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import process_store

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct units and pairs that a task remembers. Units have two generations: a full young one becomes the old
#: one, and units used again move back, so frequent ones stay. A Python worker forgets them after the task.
MEMO_UNITS = 100_000
MEMO_PAIRS = 300_000
#: Rows of a result batch.
ROWS = 256


class PrefixTableCodec:
    """Encoder and decoder for one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        if [lib.normalize(x) for x in ("a  b ", "éＡ")] != [f"{SPACE}a{SPACE}{SPACE}b{SPACE}", f"{SPACE}éＡ"]:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        self.bytes_of: list[bytes] = []
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i):
                self.bytes_of.append(b"")
            elif lib.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                self.rank[piece] = -lib.get_score(i)
                self.id[piece] = i
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.automaton = ahocorasick.Automaton()
        self.piece = {i: p for p, i in self.id.items()}
        self.split: dict[str, tuple[str, str]] = {}
        for p, i in self.id.items():
            if len(p) == 1 or p.strip(SPACE) and self.merge(p) == [p]:  # others can never be made by merges
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        made = lambda p: self.rank[p] if len(p) > 1 else float("-inf")
        self.ordered = all(max(made(a), made(b)) < self.rank[p] for p, (a, b) in self.split.items())
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        """Give back what was remembered."""
        self.pairs, self.units, self.old = {}, {}, {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: best score first, leftmost among equals. For pairs, for space runs and as a check."""
        part = list(text)
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        heap = [(self.rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= len(part) or part[i] + part[j] != joined or len(part[i]) >= len(joined):
                continue
            if len(joined) == len(text):
                self.split[text] = part[i], part[j]
            part[i], part[j] = joined, ""
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(part) and (both := part[left] + part[right]) in self.rank:
                    heapq.heappush(heap, (self.rank[both], left, both))
        return [p for p in part if p]

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.piece[left], self.piece[right]
        if not self.ordered or SPACE * 2 in a + b:
            return self.merge(a + b) == [a, b]
        # Merges are undone, latest first. What lies beside the border must not have merged before one side was used up by
        # the merge undone last; among equal scores the left one is first.
        x, y, limit, first, rank, split = a, b, float("inf"), False, self.rank, self.split
        while True:
            r = rank.get(x + y)
            if r is not None and (r < limit or first and r == limit):
                return False
            of_x = rank[x] if len(x) > 1 else -1.0
            of_y = rank[y] if len(y) > 1 else -1.0
            if of_x > of_y:
                x, limit, first = split[x][1], of_x, False
            elif len(y) > 1:
                y, limit, first = split[y][0], of_y, True
            else:
                return True

    def table(self, text: str) -> list[int]:
        """Ids of a text without tied merges: the prefix table, then the ids backwards."""
        n, pairs = len(text), self.pairs
        last = [-1] * n  # the unique last token of text[:i + 1]
        size = [1] * n
        done = -1
        for end, (length, token) in self.automaton.iter(text):
            if end == done:
                continue
            start = end - length
            if start >= 0 and (prev := last[start]) >= 0:
                key = prev << 32 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= MEMO_PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self.compatible(prev, token)
                if not ok:
                    continue
            last[end], size[end], done = token, length, end
        ids: list[int] = []
        i = n - 1
        while i >= 0:
            if last[i] >= 0:
                ids.append(last[i])
                i -= size[i]
            else:
                ids.extend(self.byte_id[b] for b in reversed(text[i].encode()))
                i -= 1
        ids.reverse()
        return ids

    def spaces(self, n: int) -> list[int]:
        if n not in self.runs:
            self.runs[n] = [self.id[p] for p in self.merge(SPACE * n)]
        return self.runs[n]

    def unit(self, text: str) -> tuple[int, ...]:
        run = len(text) - len(text.lstrip(SPACE))
        if run < 2:
            return tuple(self.table(text))
        if run == len(text):
            return tuple(self.spaces(run))
        ids = self.table(text[run - 1 :])
        if ids[0] == self.id.get(SPACE):  # the last space joined no letter, so it belongs to the run
            return (*self.spaces(run), *ids[1:])
        return (*self.spaces(run - 1), *ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        units = self.units
        out: list[int] = []
        for u in UNIT.findall(marked) if self.splits else [marked]:
            ids = units.get(u)
            if ids is None:
                ids = self.old.get(u)
                if ids is None:
                    ids = self.unit(u)
                if len(u) <= 64:
                    if len(units) >= MEMO_UNITS:
                        self.old, self.units = units, {}
                        units = self.units
                    units[u] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no UTF-8 character become U+FFFD; the dummy prefix goes with the first piece."""
        table = self.bytes_of
        raw = b"".join([table[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._lossy(raw)
        return text[1:] if ids and self.piece.get(ids[0], "").startswith(SPACE) else text

    @staticmethod
    def _lossy(raw: bytes) -> str:
        """One U+FFFD for every byte that belongs to no valid character."""
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def codec_of(model: bytes) -> PrefixTableCodec:
    """The codec of a model, built once for each Python process."""
    key = ("codec", hashlib.sha256(model).digest())
    store = process_store()
    if key not in store:
        store[key] = PrefixTableCodec(model)
    return store[key]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the columns of ``keep`` and n_tokens, ids (array<int>), decoded, ids_sha256, decoded_sha256; without ids and
    decoded when ``with_ids`` is false. Other columns are dropped, so extra columns can't clash.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(*keep, docs[text].alias("__text"))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        names = list(map(str, range(len(codec.bytes_of))))
        try:
            yield from encoded(codec, names, batches)
        finally:
            codec.forget()
            pa.default_memory_pool().release_unused()

    def encoded(codec: PrefixTableCodec, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some rows at a time: the ids of a whole batch as Python numbers would take many times its size
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            count, sha, back, all_ids, texts = [], [], [], [], []
            for value in batch.column("__text"):
                ids = codec.encode(value.as_py())
                decoded = codec.decode(ids)
                count.append(len(ids))
                sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
                    texts.append(decoded)
            arrays = [batch.column(c) for c in keep] + [pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])

    return source.mapInArrow(run, schema)
