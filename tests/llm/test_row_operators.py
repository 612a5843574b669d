"""Operators that work row by row: tokens, secrets, language, quality, benchmark leaks."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, language_id, quality, queries, secrets
from tidegauge.llm.common import fold_of, table, train_fold
from tidegauge.llm.sentencepiece_codec import PrefixTableCodec, encode_decode

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "日本語 é​😀 ▁x"), (5, "again"), (6, "x" * 50_000)]


def frame(spark, rows=ODD):
    """Texts with extra columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, 0.5, "z") for i, t in rows], "doc_id bigint, text string, score double, n_tokens string")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    raw = open(queries.tokenizer_path(), "rb").read()
    return PrefixTableCodec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)


def test_codec_equals_library(model):
    codec, lib = model
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab the ▁\n\t  é😀​\x00<s>0x41inger日本́") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * k + t + " " * (k % 7) for k in range(60) for t in ("", "a", "\n", "日")]
    for t in texts:
        ids = codec.encode(t)
        assert ids == lib.encode(t)
        assert codec.decode(ids) == lib.decode(ids)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == lib.decode(ids)


def test_pairs_are_decided_without_merging(model, monkeypatch):
    codec, _ = model
    rng = random.Random(5)
    ids = [codec.id[p] for p in codec.split if "▁▁" not in p] + [i for p, i in codec.id.items() if len(p) == 1 and p != "▁"]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)]
    # both sides of every cut of a piece, whose letters merge across it
    pairs += [(codec.id[p[:i]], codec.id[p[i:]]) for p in rng.sample(sorted(codec.split), 2000) for i in range(1, len(p)) if p[:i] in codec.split and p[i:] in codec.split]
    pairs = [(a, b) for a, b in pairs if "▁▁" not in codec.piece[a] + codec.piece[b]]
    want = [codec.merge(codec.piece[a] + codec.piece[b]) == [codec.piece[a], codec.piece[b]] for a, b in pairs]
    assert True in want and False in want
    monkeypatch.setattr(codec, "merge", None)
    assert [codec.compatible(a, b) for a, b in pairs] == want


def test_encode_decode_rows(spark, model):
    _, lib = model
    got = encode_decode(frame(spark), queries.tokenizer_path()).collect()
    assert len(got) == len(ODD)
    for r in got:
        texts = [t or "" for i, t in ODD if i == r["doc_id"]]
        assert r["ids"] in [lib.encode(t) for t in texts] and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(r["ids"]).encode()).hexdigest()
    assert encode_decode(frame(spark, ODD).limit(0), queries.tokenizer_path()).count() == 0


BASE = [(re.compile(secrets.BASE[0].pattern, re.ASCII), 2, 8), (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(BASE) for m in p.finditer(text) if len(m.group(g)) >= n)


def test_secrets_equal_regular_expressions(spark):
    scanner = secrets.CombinedAutomaton(secrets.BASE).scanner()
    rng = random.Random(3)
    parts = ["password", "PassWD", "secret", "ToKen", "api_key", "apikey", "AKIA", "ABCD1234EFGH", "abcdef01" * 4, "=", ":", " ", "  ", '"', "'", "é", "\n", "x", "ab", "cdefghij", "-", "."]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert scanner.spans(t) == brute_spans(t)
    got = {r["doc_id"]: r["found"] for r in secrets.scan(frame(spark, [(1, None), (2, ""), (3, "é token = abcdefgh1"), (4, "ghp_" + "A1" * 20)])).collect()}
    assert not got[1] and not got[2]
    assert [(x["kind"], x["start"], x["end"]) for x in got[3]] == [("assign", 2, 19)]
    assert [x["kind"] for x in got[4]] == ["hub_token"]


def test_ppm_code_lengths_by_hand():
    texts = ["abab", "abac"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"]), pa.array(texts)], ["lang", "__text"])
    import pandas as pd

    counts = pd.concat(b.to_pandas() for b in language_id.gram_counts([batch])).groupby(["lang", "n", "gram"], as_index=False)["count"].sum()
    model = language_id.PpmModel.fit(counts)

    def cost(lang, text):
        """The same code lengths from counts of strings."""
        padded = "\n" * 3 + texts[model.langs.index(lang)]
        seen = Counter(padded[max(0, i - n) : i + 1][-(n + 1) :] for i in range(3, len(padded)) for n in range(4))
        total, padded = 0.0, "\n" * 3 + text
        for i in range(3, len(padded)):
            for n in (3, 2, 1, 0):
                ctx = padded[i - n : i]
                after = {g[-1]: c for g, c in seen.items() if len(g) == n + 1 and g[:-1] == ctx}
                if after.get(padded[i]):
                    total += np.log2((sum(after.values()) + len(after)) / after[padded[i]])
                    break
                if after:
                    total += np.log2((sum(after.values()) + len(after)) / len(after))
            else:
                total += 8
        return total

    probe = ["abab", "abac", "cab", "zzabz", "a"]
    bits, _ = language_id.Predictor(model).totals(probe)
    assert np.allclose(bits, [[cost(x, t) for x in model.langs] for t in probe], atol=1e-3)


def test_language_id_on_held_out(spark):
    docs = table(spark, DATA, "documents")
    out = language_id.predict(docs, language_id.train(docs.where(train_fold() != 1)), keep=("doc_id", "lang")).where(train_fold() == 1)
    n, ok = out.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert ok >= 0.95 * n
    model = language_id.train(docs)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(frame(spark, ODD[:4] + [(9, "123 !!")]), model).collect()}
    assert set(odd.values()) == {("und", 0.0)}
    none = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).select("lang_pred").distinct().collect()} == {"und"}


def test_quality_on_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels.where(train_fold() != 1))
    got = quality.score(docs, model).join(labels.where(train_fold() == 1), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in got]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in quality.score(frame(spark), model).collect())
    empty = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(frame(spark), empty).collect()} == {0.5}


def test_isotonic():
    x = np.arange(6.0)
    assert quality.isotonic(x, np.array([0.1, 0.3, 0.2, 0.2, 0.9, 0.8]), np.array([1.0, 1, 1, 2, 1, 1])).tolist() == pytest.approx([0.1, 0.225, 0.225, 0.225, 0.85, 0.85])


def brute_leaks(docs, items, least=0.75):
    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        for j, b in items:
            v = (b or "").encode().lower().split()
            if not v or not w:
                continue
            k = min(5, len(v))
            c = Counter(tuple(v[x : x + k]) for x in range(len(v) - k + 1))
            n = min(len(v), len(w))
            for s in range(len(w) - n + 1):
                m = Counter(tuple(w[x : x + k]) for x in range(s, s + n - k + 1))
                sim = sum((m & c).values()) / max(1, sum((m | c).values()))
                if sim >= least and sim > out.get((i, j), (0,))[0]:
                    out[i, j] = (sim, s, n)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [(j, " ".join(rng.choices(words, k=n))) for j, n in enumerate([3, 6, 12, 30, 30, 1])] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(0, 60))
        v = rng.choice(items[1:5])[1].split()
        if i % 3:
            for _ in range(i % 4):
                v[rng.randrange(len(v))] = "changed"
            t[len(t) // 2 : len(t) // 2] = v
        docs.append((i, " ".join(t)))
    docs += [(100, None), (101, "")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (100, 3):
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"], r["n_words"]) for r in decontamination.contaminated(frame(spark, docs), b, max_items=most).collect()}
        want = brute_leaks(docs, items)
        assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-12 for k in got)


def test_block_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 50).astype(np.uint64)
    query = prints ^ np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 25)), replace=False)) for _ in range(50)], np.uint64)
    q, i = decontamination.BlockIndex(prints, 19).near(query)
    want = {(a, b) for a in range(50) for b in range(50) if bin(int(query[a]) ^ int(prints[b])).count("1") <= 19}
    assert set(zip(q.tolist(), i.tolist())) == want


def test_fold():
    assert {fold_of(i) for i in range(50)} == {0, 1, 2}
