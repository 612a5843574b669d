"""Prefix trie, toxicity and hard negatives, against brute force and planted texts."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import conversation_trie, hard_negatives, queries, toxicity
from tidegauge.llm.common import table

DATA = "/root/testdata/sf0.001"


# --- Operator 11 -------------------------------------------------------------------------------------------------------


def brute_trie(sequences):
    """The nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[q] for q in children[p]]
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        ends = ",".join(map(str, sorted(c for c in members[p] if len(sequences[c]) == len(p))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(b[5] for b in below) or 1, own + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_convs string, depth int")


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda k: k[:2])] for c, v in own.items()}
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + s[h:]
    return out


@pytest.mark.parametrize("per_range", [3, 40, 100_000])
def test_trie_equals_brute_force(spark, per_range):
    rng = random.Random(per_range)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "é b", None, ""])) for c in range(120) for t in rng.sample([None, *range(12)], rng.randint(1, 9))]
    rows += [(c, t, "user", "same first" if t == 0 else f"{c % 3} {t}") for c in range(200, 330) for t in range(1 + c % 4)]  # a first turn of most conversations
    rows += [(c, 0, "user", "copy") for c in range(400, 460)]
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(300)] + [(501, t, "user", f"turn {t % 7}") for t in range(280)]
    rows += [(None, 1, "user", "nobody's"), (600, 5, None, None)]
    own = conversation_trie.sequences(turns_frame(spark, rows))
    c = F.col("conv_id")
    built = conversation_trie.rebuilt(own, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8)
    got = sorted((tuple(r) for r in conversation_trie.trie(built, per_range).collect()), key=lambda r: (r[1], r[0]))
    assert got == brute_trie(brute_rebuilt(rows))
    plain = conversation_trie.trie(own, per_range)
    whole = {k: v for k, v in brute_rebuilt(rows).items()}
    assert plain.agg(F.max("n_convs")).first()[0] == len(whole)


def test_trie_of_little(spark):
    own = conversation_trie.sequences(turns_frame(spark, []))
    assert conversation_trie.trie(own).count() == 0
    turnless = spark.createDataFrame([(4, []), (2, [])], "conv_id bigint, turns array<struct<digest:binary,bytes:bigint>>")
    assert [tuple(r) for r in conversation_trie.trie(turnless).collect()] == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]
    long = conversation_trie.sequences(turns_frame(spark, [(1, 0, "user", "x" * 200_000), (2, 0, "user", "x" * 200_000), (2, 0, "user", "x" * 200_000)]))
    got = sorted((r["depth"], r["n_convs"], r["saved_tokens"]) for r in conversation_trie.trie(long).collect())
    assert got == [(0, 2, 200_000), (1, 2, 200_000), (2, 1, 0)]  # a repeated row is a turn of its own


def test_trie_query(spark):
    got = sorted((tuple(r) for r in queries.op11_conversation_trie(spark, DATA).collect()), key=lambda r: (r[1], r[0]))
    rows = [tuple(r) for r in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute_trie(brute_rebuilt(rows))


# --- Operator 12 -------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    got = queries.op12_toxicity(spark, "/root/testdata/sf0.1")
    rows = got.join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    toxic, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.01 * len(clean)
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_learns_pairs(spark):
    """Neither word alone is toxic, both together are: no additive weights can tell."""
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(plain, 20) + ["insult"] * a + ["grouped"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    docs_df, labels_df = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs_df, labels_df.where("doc_id < 900"), rounds=6)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs_df.where("doc_id >= 900"), model).collect()}
    assert np.mean([got[i] == bool(y) for i, y in labels if i >= 900]) > 0.97


def test_toxicity_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "日本語 é"), (4, "idiot " * 60_000), (4, "again"), (None, "idiot idiot")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in odd], "doc_id bigint, text string, score double, toxic int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(4, 1), (4, 0), (1, None), (None, 0)], "doc_id bigint, toxic int")
    assert min(r["score"] for r in toxicity.score(docs, toxicity.train(docs, one)).collect()) > 0.99  # the mean label
    both = spark.createDataFrame([(4, 1), (3, 0), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, both)).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, both)).count() == 0


# --- Operator 13 -------------------------------------------------------------------------------------------------------


def brute_negatives(rows, positives=5, negatives=5):
    first = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = (y, [math.floor(256 * c) for c in v])
        first[i] = min(first.get(i, x), x)
    lengths = defaultdict(int)
    for _, v in first.values():
        lengths[len(v)] += 1
    d = max(lengths, key=lambda k: (lengths[k], k)) if lengths else 0
    first = {i: (y, v) for i, (y, v) in first.items() if len(v) == d}
    out = []
    for a, (y, v) in first.items():
        if a % 100:
            continue
        scores = [(-sum(p * q for p, q in zip(v, w)), i, z == y) for i, (z, w) in first.items() if i != a]
        for s, p, _ in sorted(x for x in scores if x[2])[:positives]:
            fit = sorted((t, i) for t, i, own in scores if not own and 80 * -s <= 100 * -t <= 100 * -s)[:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def negatives_frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id bigint, embedding array<float>, label int, rank double")


@pytest.mark.parametrize("scale,per_piece,start", [(1.0, 50, 40), (1.0, 20_000, 4096), (7e4, 100, 60)])
def test_negatives_equal_brute_force(spark, scale, per_piece, start, monkeypatch):
    rng = np.random.default_rng(int(scale) + per_piece)
    centres = rng.normal(size=(4, 6)) * 2
    rows = [(i, [float(np.float32(c)) for c in (centres[i % 4] + rng.normal(size=6)) * scale], int(rng.integers(0, 3))) for i in range(700)]
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(150)]  # one very common vector: ties, and anchors among it
    rows += [(3000, None, 1), (3100, [1.0] * 6, None), (3200, [1.0, None] * 3, 1), (3300, [float("nan")] * 6, 1), (3400, [float("inf")] * 6, 1), (3500, [], 1), (3600, [1.0, 2.0], 1)]
    rows += [(3700, [0.0] * 6, 1), (3800, [-c for c in rows[0][1]], 2), (0, rows[0][1], rows[0][2]), (200, rows[5][1], 0), (None, rows[0][1], 1)]
    search = hard_negatives.search
    monkeypatch.setattr(hard_negatives, "search", lambda *a: search(*a, start=start, per_block=7))
    got = hard_negatives.mine(negatives_frame(spark, rows), F.col("vec_id") % 100 == 0, per_piece=per_piece, pivots=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_negatives_of_little(spark):
    every = F.col("vec_id") % 100 == 0
    assert hard_negatives.mine(negatives_frame(spark, []), every).count() == 0
    assert hard_negatives.mine(negatives_frame(spark, [(100, [1.0, 2.0], 1)]), every).count() == 0
    rows = [(100, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2)]
    assert [tuple(r) for r in hard_negatives.mine(negatives_frame(spark, rows), every).collect()] == brute_negatives(rows)


def test_negatives_query(spark):
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, DATA).collect())
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table(spark, DATA, "embeddings").collect()]
    assert got == brute_negatives(rows)
