"""Operator 7: language identification by prediction by partial matching (PPM).

For each language a context tree holds the counts of bytes after contexts of 0 to 3 bytes. The code length of a byte
is taken from its longest known context; a byte unseen there pays the escape (distinct followers against all
followers, method C) and is coded in the next shorter context, at last as one of 256. The counts are frozen after
training, so the code length of a byte depends only on it and the three bytes before it, and is read from tables.
A text's language is the one with the shortest code; the score is that language's posterior probability under equal
priors.

Texts are lower-cased. A text that is null or has no letter is ``und`` with score 0; so is every text when nothing
was learned. Equal code lengths go to the smaller language name.

Training counts come from a bounded sample of labelled rows: about ``train_docs`` whole documents a language, chosen
by a hash of the id. The tables are broadcast; the sample bounds them. Prediction is row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share

ORDER = 3
PAD = b"\n" * ORDER
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(data: np.ndarray, n: int, end: np.ndarray | slice = slice(None)) -> np.ndarray:
    """For each byte from the ORDER-th on, the number made of the n bytes that end with it."""
    out = np.zeros(len(data) - ORDER, np.uint32)
    for k in range(n):
        at = ORDER - n + 1 + k
        out = (out << np.uint32(8)) | data[at : at + len(out)]
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The padded lower-case bytes of the texts one after another, where each starts, and how many bytes it has."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    start = np.cumsum(size + ORDER) - size - ORDER
    return np.frombuffer(PAD.join([b"", *raw]) if raw else b"", np.uint8), start, size


def bodies(start: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Which of the windows of joined texts end in a text's own bytes (not in padding)."""
    mark = np.zeros(total + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + size, -1)
    return np.cumsum(mark[:-1]) > 0


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, n, gram, count) for the bytes of each batch."""
    for batch in batches:
        rows = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("__text").to_pylist()}).dropna()
        for lang, group in rows.groupby("lang"):
            data, start, size = joined(group["text"].tolist())
            if not size.sum():
                continue
            own = bodies(start, size, len(data) - ORDER)
            for n in range(1, ORDER + 2):
                gram, count = np.unique(windows(data, n)[own], return_counts=True)
                k = len(gram)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(np.full(k, n, np.int32)), pa.array(gram.astype(np.int64)), pa.array(count.astype(np.int64))], ["lang", "n", "gram", "count"])


@dataclass
class PpmModel:
    """Frozen tables. cost[n]: for every known n-gram, bits of its last byte after the others, by language; escape[n]:
    for every known context of n bytes, bits for leaving it (0 where a language doesn't know it)."""

    langs: list[str]
    cost_keys: dict[int, np.ndarray]
    cost: dict[int, np.ndarray]
    escape_keys: dict[int, np.ndarray]
    escape: dict[int, np.ndarray]

    @staticmethod
    def fit(counts: pd.DataFrame) -> PpmModel:
        langs = sorted(counts["lang"].unique())
        model = PpmModel(langs, {}, {}, {}, {})
        number = {x: i for i, x in enumerate(langs)}
        col = counts["lang"].map(number).to_numpy() if len(counts) else np.zeros(0, int)
        for n in range(1, ORDER + 2):
            mine = counts["n"].to_numpy() == n
            gram, lang, count = counts["gram"].to_numpy()[mine].astype(np.uint32), col[mine], counts["count"].to_numpy()[mine].astype(float)
            keys, at = np.unique(gram, return_inverse=True)
            seen = np.zeros((len(keys), len(langs)))
            np.add.at(seen, (at, lang), count)
            ctx, where = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, distinct = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
            np.add.at(total, where, seen)
            np.add.at(distinct, where, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
                own = np.where(seen > 0, np.log2((total + distinct)[where] / seen), np.inf)
            model.escape_keys[n - 1], model.escape[n - 1] = ctx, escape
            shorter = model.bits(keys & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)
            model.cost_keys[n], model.cost[n] = keys, np.where(seen > 0, own, escape[where] + shorter).astype(np.float32)
        return model

    def bits(self, gram: np.ndarray, n: int) -> np.ndarray:
        """Code lengths of the last byte of n-grams after their other bytes: a row for each, a column for each language."""
        if n == 0:
            return np.full((len(gram), len(self.langs)), 8.0, np.float32)
        keys = self.cost_keys[n]
        at = np.minimum(np.searchsorted(keys, gram), max(0, len(keys) - 1))
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        known = keys[at] == gram if len(keys) else np.zeros(len(gram), bool)
        out[known] = self.cost[n][at[known]]
        rest = gram[~known]
        if len(rest):
            out[~known] = self.shorter(rest, n)
        return out

    def shorter(self, gram: np.ndarray, n: int) -> np.ndarray:
        """Bits for n-grams that no language knows: leave the context, then the next shorter one."""
        out = self.bits(gram & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)
        ctx, keys = gram >> np.uint32(8), self.escape_keys[n - 1]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, ctx), len(keys) - 1)
            known = keys[at] == ctx
            out[known] += self.escape[n - 1][at[known]]
        return out

    def slots(self) -> tuple[np.ndarray, int]:
        """A hash table from longest grams to rows of cost; a gram that lost its slot to another is found by search."""
        keys = self.cost_keys[ORDER + 1]
        shift = 32 - max(10, int(len(keys)).bit_length() + 2)
        slot = np.full(1 << (32 - shift), 0, np.int32)
        slot[(keys * np.uint32(2654435761)) >> np.uint32(shift)] = np.arange(len(keys), dtype=np.int32)
        return slot, shift


class Predictor:
    #: Bytes handled at once, for bounded memory.
    BLOCK = 1 << 19

    def __init__(self, model: PpmModel):
        self.model, (self.slot, self.shift) = model, model.slots()

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of every text under every language, and its bytes."""
        data, start, size = joined(texts)
        out = np.zeros((len(texts), len(self.model.langs)))
        if not len(texts) or not size.sum():
            return out, size
        doc = np.repeat(np.arange(len(texts)), size + ORDER)[: len(data) - ORDER] if len(data) > ORDER else np.zeros(0, int)
        own = bodies(start, size, len(data) - ORDER)
        keys, cost = self.model.cost_keys[ORDER + 1], self.model.cost[ORDER + 1]
        for low in range(0, len(own), self.BLOCK):
            high = min(len(own), low + self.BLOCK)
            mine = own[low:high]
            gram = windows(data[low : high + ORDER], ORDER + 1)[mine]
            at = self.slot[(gram * np.uint32(2654435761)) >> np.uint32(self.shift)]
            bits = cost[at]
            other = np.flatnonzero(keys[at] != gram)
            if len(other):
                bits[other] = self.model.bits(gram[other], ORDER + 1)
            d = doc[low:high][mine]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            out[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64) if len(first) else 0
        return out, size

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of every text of an Arrow column, some texts at a time."""
        langs, label, score = self.model.langs, [UNKNOWN] * len(column), [0.0] * len(column)
        for part in range(0, len(column) if langs else 0, 256):
            texts = column.slice(part, 256).to_pylist()
            good = [i for i, t in enumerate(texts) if t and has_letter(t)]
            if not good:
                continue
            bits, _ = self.totals([texts[i] for i in good])
            best = bits.argmin(axis=1)
            gap = bits - bits[np.arange(len(good)), best][:, None]
            sure = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
            for i, k, s in zip(good, best, sure):
                label[part + i], score[part + i] = langs[k], float(s)
        return label, score


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_docs: int = 3000) -> PpmModel:
    """Fit on labelled rows: about ``train_docs`` documents of each language, whole texts."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).count().collect()}
    space = 1 << 30
    share = F.create_map(*(F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(space, int(space * train_docs / n) + 1)))) if sizes else None
    if share is None:
        return PpmModel.fit(pd.DataFrame({"lang": [], "n": [], "gram": [], "count": []}))
    sample = rows.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(space)) < share[F.col(lang)])
    sample = sample.select(F.col(lang).alias("lang"), F.col(text).alias("__text"))
    counts = sample.mapInArrow(gram_counts, "lang string, n int, gram bigint, count bigint").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    return PpmModel.fit(counts.toPandas())


def predict(docs: DataFrame, model: PpmModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``keep`` and the language and its score, by ``names``, for every row."""
    shared = share(docs, model)
    source = text if text in keep else "__text"
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared())
        for batch in batches:
            label, score = predictor.predict(batch.column(source))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(label, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    return docs.select(*keep, *([] if text in keep else [docs[text].alias("__text")])).mapInArrow(run, ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` double"]))
