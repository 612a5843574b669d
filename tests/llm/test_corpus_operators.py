"""Operators that compare rows with each other, against brute force."""

import hashlib
import random
import time
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import jaccard_join, line_dedup, neighbours, repeats, sharding
from tidegauge.llm.common import checkpointed, shared_folder
from tidegauge.llm.components import components
from tidegauge.llm.suffix_array import permuted_lcp, suffix_array
from tidegauge.llm.words import shingle_sets

WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows, extra="n_bytes int, component_id string"):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], f"doc_id bigint, text string, {extra}")


def family(rng, n, length=60, edits=3):
    base = rng.choices(WORDS, k=length)
    out = [" ".join(base)]
    for _ in range(n - 1):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(length)] = rng.choice(WORDS)
        out.append(" ".join(t))
    return out


def union_find(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = union_find(300, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_join(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], union_find(len(sets), pairs)


@pytest.mark.parametrize("few", [4, 1])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "PART", 10)
    rng = random.Random(few)
    texts = [None, "", "  \n", "one", "One", "a b c d", "a b c d e", "a b c d e f"] + family(rng, 60, 60, 6) + family(rng, 30, 14, 1) + family(rng, 20, 9, 1) + family(rng, 12, 300, 12)
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(40)] + texts[8:30]
    passage = " ".join(WORDS[:70])
    texts += [passage + " " + " ".join(rng.choices(WORDS, k=rng.randint(5, 60))) for _ in range(30)]
    rng.shuffle(texts)
    out = jaccard_join.jaccard_components(frame(spark, list(enumerate(texts))), docs_per_bucket=20).orderBy("doc_id").collect()
    n, c = brute_join(texts)
    assert [r["n_shingles"] for r in out] == n and [r["component_id"] for r in out] == c


def one_meeting(rng, n):
    """n texts of seven shingles, the last of nine: all have the three of segment 1 in common, the rest in segment 0. The last
    two hold each other but meet nowhere else, as two elements of segment 0 differ."""

    def grown(text, k, segment):
        while True:
            more = text + rng.choices(WORDS, k=k)
            made = next(iter(shingle_sets(pa.array([" ".join(more)]))))
            had = next(iter(shingle_sets(pa.array([" ".join(text)])))) if len(text) >= 5 else []
            if all(int(t) >> 63 == segment for t in np.setdiff1d(made, had)):
                return more

    head = grown([], 7, 1)
    texts = [grown(head, 4, 0) for _ in range(n - 1)]
    return [" ".join(t) for t in texts + [grown(texts[-1], 2, 0)]]


def test_jaccard_join_keeps_links_of_the_last_part(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAX_HOT", 0)  # without frequent shingles, members of a group go by size and id
    rng, want = random.Random(9), []
    texts = []
    for n in (1002, 1003, 1004):
        texts += one_meeting(rng, n)
        want.append((len(texts) - 1, len(texts) - 2))
    out = jaccard_join.jaccard_components(frame(spark, list(enumerate(texts)))).where("doc_id <> component_id").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == want


def test_checkpoints_leave_no_shuffle_files(spark):
    local = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {p for p in local.rglob("shuffle_*")}
    before = files()
    out = checkpointed(spark.range(20_000).withColumn("h", F.xxhash64("id")).repartition(3, "h"))
    for _ in range(50):  # they are removed in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert out.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_jaccard_join_edges(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    out = jaccard_join.jaccard_components(frame(spark, [(7, "a b c"), (7, "a b c"), (3, "a b c"), (None, "a b c")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in out if r["doc_id"]) == [(3, 3), (7, 3), (7, 3)] and len(out) == 4


def test_a_bucket_is_sorted_in_ranges_of_signatures():
    rng = np.random.default_rng(5)
    docs, each = 150_000, 6
    sig = rng.integers(0, 1 << 32, docs * each, dtype=np.uint64).astype(np.uint32)
    shared = rng.random(docs * each) < 0.02
    sig[shared] = rng.choice(sig, 4000)[rng.integers(0, 4000, shared.sum())]
    ids, score = np.arange(docs, dtype=np.int64), rng.integers(0, 50, docs).astype(np.int32)
    owner = np.repeat(ids, each)
    want: dict[int, list[int]] = {}
    for i in np.flatnonzero(np.isin(sig, np.unique(sig, return_index=False)[np.unique(sig, return_counts=True)[1] > 1])):
        want.setdefault(int(sig[i]), []).append(int(owner[i]))
    want = {tuple(sorted(v, key=lambda x: (score[x], x))) for v in want.values()}
    cut = docs // 3 * each
    parts = [(ids[a // each : b // each].tobytes(), score[a // each : b // each].tobytes(), np.full((b - a) // each, each, np.int32).tobytes(), sig[a:b].tobytes()) for a, b in ((0, cut), (cut, len(sig)))]
    batches = [pd.DataFrame([p], columns=["ids", "scores", "counts", "sigs"]) for p in parts]
    tracemalloc.start()
    got, peak = set(), 0
    for out in jaccard_join._meet(iter(batches)):
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        got |= {tuple(m.tolist()) for m in out["members"]}
        del out
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert got == want
    assert peak < 45 * len(sig)  # 74 bytes a signature where a bucket is sorted at once, 21 in ranges
    assert list(jaccard_join._meet(iter([pd.DataFrame(columns=["ids", "scores", "counts", "sigs"])])))[0].empty


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for t in range(200):
        x = np.append(rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 60))), 0)
        if t % 3 == 0:
            x = np.append(np.tile(rng.integers(1, 4, int(rng.integers(1, 4))), 10), 0)
        sa = suffix_array(x)
        assert list(sa) == sorted(range(len(x)), key=lambda i: tuple(x[i:]))
        phi, lcp = permuted_lcp(x, sa, 100)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
                n += 1
            assert phi[b] == a and lcp[b] == n


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        mark = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [64_000_000, 500])
def test_repeats_equal_brute_force(spark, hot):
    rng = random.Random(hot)
    passages = [" ".join(rng.choices(WORDS, k=n)) for n in (40, 60, 90)]
    texts = [None, "", "short", "ab" * 300, "é" * 200, passages[0]]
    for _ in range(50):
        t = " ".join(rng.choices(WORDS, k=rng.randint(0, 120)))
        for _ in range(rng.randint(0, 3)):
            p, k = rng.choice(passages), rng.randrange(len(t) + 1)
            p = p[rng.randrange(60) :]
            t = t[:k] + p + t[k:]
        texts.append(t)
    texts += texts[6:12]
    got = repeats.remove_repeats(frame(spark, list(enumerate(texts))), length=120, shard_bytes=3000, hot_bytes=hot, with_text=True).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute_repeats(texts, 120)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def brute_repeated_words(texts, words):
    split = [(t or "").lower().split() for t in texts]
    starts = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    return [len({i + k for i in range(len(w) - words + 1) if starts[tuple(w[i : i + words])] > 1 for k in range(words)}) for w in split]


def test_repeated_passages_of_words(spark):
    rng = random.Random(8)
    short = " ".join(rng.choices(["a", "of", "the", "is", "und", "le"], k=52))  # far below 400 bytes
    passage = rng.choices(WORDS, k=70)
    texts = [None, "", "few words", short + " end", "Begin " + short.upper().replace(" ", "\n"), " ".join(passage[:50])]
    for n in range(12):
        own = lambda: " ".join(f"{rng.choice(WORDS)}{n}{rng.random()}" for _ in range(30))
        texts.append(f"{own()} {' '.join(passage[n % 4 : n % 4 + 40 + 2 * n])}  {own()}")
    texts += texts[6:9]
    want = brute_repeated_words(texts, 51)
    assert want[3] > 0 and want[4] > 0 and 0 in want[6:]
    for hot in (64_000_000, 100):
        got = repeats.remove_repeats(frame(spark, list(enumerate(texts))), words=51, shard_bytes=3000, hot_bytes=hot).orderBy("doc_id").collect()
        assert [r["n_repeated_words"] for r in got] == want
    assert repeats.remove_repeats(frame(spark, []), words=51).count() == 0


def test_sharding(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 300) + str(rng.randrange(500)) for _ in range(1500)] + ["hot" * 200] * 60 + [None, None, ""]
    out = sharding.shard_by_bytes(frame(spark, list(enumerate(texts)), "size int, shard string"), shards=8, groups_per_bucket=100, max_large=50).toPandas()
    assert len(out) == len(texts)
    at = {r.doc_id: r for r in out.itertuples()}
    groups = defaultdict(set)
    for i, t in enumerate(texts):
        assert at[i].size == len((t or "").encode()) + 16
        groups[t or ""].add(at[i].shard)
    assert all(len(s) == 1 for s in groups.values())
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    total = out.groupby("shard")["size"].sum().sort_values()
    # the hot group is larger than a fair share; the others are level
    assert len(total) == 8 and total.iloc[-2] - total.iloc[0] < 0.02 * total.mean()
    assert sharding.shard_by_bytes(frame(spark, [])).count() == 0


def test_differencing_beats_dealing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 300).astype(float)
    part = sharding.differencing(sizes, 7)
    sums = np.bincount(part, weights=sizes, minlength=7)
    assert sums.max() - sums.min() <= 5


def test_neighbours_equal_brute_force_when_all_is_visited(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).round(2)
    x[40:80] = x[40]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(300, None, 0), (400, [0.0] * 6, 0), (500, [1.0, None] + [0.0] * 4, 0), (600, [float("nan")] * 6, 0), (700, [1.0] * 5, 0), (800, [float("inf")] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    out = neighbours.neighbours(df, F.col("vec_id") % 20 == 0, k=10).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    for q in got:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        near = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert [i for i, _ in got[q]] == near and np.allclose([s for _, s in got[q]], d[near])
    assert neighbours.neighbours(df.where("vec_id >= 400"), F.lit(True)).count() == 0
    few = neighbours.neighbours(df.where("vec_id < 4"), F.lit(True)).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {3} and len(few) == 4


def test_recall_with_partial_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = neighbours.neighbours(df, F.col("vec_id") % 100 == 0, search=12_000).collect()
    hit = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len({r["vec_id"] for r in out if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 300


def test_lines(spark):
    rng = random.Random(6)
    long_line = " ".join(rng.choices(WORDS, k=80)).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij"))
    near = long_line.replace("word", "Word", 1) + "!!"
    edited = long_line.replace(long_line.split()[3], long_line.split()[3] + "x", 1)
    rows = [(1, f"Same line here.\nother one\n{long_line}"), (2, "same LINE here\n123\n\nfresh text"), (3, near + "\n123"), (4, None), (5, ""), (6, "fresh text"), (7, edited), (7, edited)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, n_lines string, place int")
    out = line_dedup.dedup_lines(df).collect()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in out}
    assert got[1] == (rows[0][1], 3, 3)
    assert got[2] == ("123\n\nfresh text", 4, 3)
    assert got[3] == ("123", 2, 1) and got[6] == ("", 1, 0)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 1)
    assert len(out) == len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed_line(rng, words, vocabulary, how):
    out = list(words)
    if how == "one":
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    elif how == "many":
        for j in rng.sample(range(len(out)), max(1, len(out) // 5)):
            out[j] = rng.choice(vocabulary)
    elif how == "moved":
        out.insert(rng.randrange(len(out)), out.pop(rng.randrange(len(out))))
    else:
        for j in rng.sample(range(len(out)), max(1, len(out) // 5)):
            at = rng.randrange(len(out[j]))
            out[j] = out[j][:at] + rng.choice(LETTERS) + out[j][at + 1 :]
    return out


def test_near_lines_recall_and_clean_lines(spark):
    """Of all pairs with edit similarity 0.75 or more at least nine in ten are found at every length, and no others."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices(LETTERS, k=rng.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], []
    for words in (4, 8, 12, 20, 40, 80):
        for how in ("one", "many", "moved", "typos"):
            for _ in range(15):
                a = rng.choices(vocabulary, k=words)
                b = changed_line(rng, a, vocabulary, how)
                a, b = " ".join(a), " ".join(b)
                if a != b and 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.75:
                    pairs.append((words, len(rows)))
                    rows += [a, b]
    clean = [" ".join(rng.choices(vocabulary, k=rng.choice((6, 15, 30)))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(rows + clean)), "doc_id bigint, text string")
    kept = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(df).collect()}
    found, made = Counter(), Counter()
    for words, at in pairs:
        made[words] += 1
        found[words] += kept[at] == 1 and kept[at + 1] == 0
    assert all(found[w] >= 0.9 * made[w] for w in made if w >= 8), (found, made)
    assert found[4] >= 0.8 * made[4]
    assert all(kept[len(rows) + i] == 1 for i in range(len(clean)))


def test_one_line_of_a_large_group_stays(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices(LETTERS, k=rng.randint(3, 9))) for _ in range(3000)]
    base = rng.sample(vocabulary, 30)
    rows = [" ".join(changed_line(rng, base, vocabulary, "one")) for _ in range(200)]
    # lines that share their frequent words with hundreds of others and are near one other
    frequent = vocabulary[:6]
    for _ in range(150):
        own = rng.sample(vocabulary, 4)
        rows += [" ".join(frequent + own), " ".join(frequent[:5] + own)]
    kept = [r["n_kept"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert kept[0] == 1 and sum(kept[:200]) <= 10
    second = kept[201::2]
    assert sum(second) <= 0.1 * len(second)


def test_all_close_lines_of_a_group_are_compared(spark, monkeypatch):
    """However many lines share a single block, every similar pair within the radius is linked."""
    monkeypatch.setattr(line_dedup, "PART", 50, raising=False)
    monkeypatch.setattr(line_dedup, "_keyed", lambda prints: prints.where("kind = 0").select(F.lit(2).cast("long").alias("key"), "id", "sim"))
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices(LETTERS, k=6)) for _ in range(4000)]
    rows = []
    for _ in range(120):
        a = rng.sample(vocabulary, 14)
        b = list(a)
        for j in rng.sample(range(14), 3):
            b[j] = rng.choice(vocabulary)
        rows += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").withColumn("rid", F.xxhash64("doc_id", "text"))
    prints = line_dedup.fingerprints(docs).persist()
    of = {r["place"]["doc_id"]: (r["id"], r["sim"]) for r in prints.where("kind = 0").collect()}
    where = {r["id"]: r["component"] for r in line_dedup._candidates_linked(prints, docs, 0.75).collect()}
    near = [i for i in range(0, len(rows), 2) if ((of[i][1] ^ of[i + 1][1]) & (1 << 64) - 1).bit_count() <= 19 and edit_distance(rows[i], rows[i + 1]) <= 0.25 * len(rows[i])]
    assert len(near) > 60
    assert [i for i in near if of[i][0] not in where or where[of[i][0]] != where.get(of[i + 1][0])] == []


def test_parts_of_a_large_group_meet_from_one_end(spark, monkeypatch):
    """All pairs of a group are made, and two parts meet as one end each: both came as both ends, which made four times the comparisons."""
    monkeypatch.setattr(line_dedup, "PART", 9)
    monkeypatch.setattr(line_dedup, "_close", lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 64)
    monkeypatch.setattr(line_dedup, "_possible", lambda kind, least: F.col("id").isNotNull())
    monkeypatch.setattr(line_dedup, "_within", lambda x, y, least: F.col(x).isNotNull())
    plans, keep = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    rng = random.Random(9)
    rows = [" ".join("".join(rng.choices(LETTERS, k=6)) for _ in range(n)) for n in [9] * 20 + [20] * 20]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").withColumn("rid", F.xxhash64("doc_id", "text"))
    prints = line_dedup.fingerprints(docs).persist()
    ids = sorted(r["id"] for r in prints.where("kind = 0").collect())
    groups = {2: ids, 4: ids[:6]}
    large = prints.where("kind = 0").select(F.explode(F.array(F.lit(2).cast("long"), F.lit(4).cast("long"))).alias("key"), "id", "sim").where(F.col("key").isin(2) | F.col("id").isin(groups[4]))
    where = spark.createDataFrame([(ids[0], ids[0]), (ids[1], ids[0])], "id bigint, component bigint")
    got = [(r["a"], r["b"]) for r in line_dedup._rest(large, where, prints, docs, 0.75).collect()]
    assert sorted(got) == sorted((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (a, b) != (ids[0], ids[1]))
    joins = [line for plan in plans for line in plan.splitlines() if "Join Inner" in line and "bit_count" in line]
    assert joins and not any("op#" in line for line in joins)


def test_short_lines_of_a_group_are_verified_where_they_meet(spark, monkeypatch):
    """Unlike short lines with close fingerprints make no pairs for the second verification, and no table stays in the shared folder."""
    monkeypatch.setattr(line_dedup, "_keyed", lambda prints: prints.where("kind = 0").select(F.lit(2).cast("long").alias("key"), "id", "sim"))
    verified, counts = line_dedup._verified, []

    def counted(pairs, *rest):
        pairs = pairs.persist()
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices(LETTERS, k=6)) for _ in range(3000)]
    rows = [" ".join(vocabulary[:4] + rng.sample(vocabulary[4:], 4)) for _ in range(120)]
    rows.append(rows[7][:-1] + ("a" if rows[7][-1] != "a" else "b"))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    kept = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert kept == {i: int(i < 120) for i in range(121)}
    assert counts[0] > 100 and counts[1] == 0
    assert set(folder.glob("table-*")) == before


def test_lines_of_all_lengths(spark, monkeypatch):
    """Long lines are compared by words, very long ones by pairs of words; clashing columns; a digit counts."""
    monkeypatch.setattr(line_dedup, "BY_CHARACTER", 200)
    monkeypatch.setattr(line_dedup, "BY_WORD", 300)
    rng = random.Random(2)
    rows = []
    for n in (60, 250, 500, 3000):
        words = [rng.choice(WORDS) + rng.choice("abc") for _ in range(n)]
        for t in (words, words[: n // 2] + ["new", "words"] + words[n // 2 :], rng.sample(words, n)):
            rows.append(" ".join(t))
    rows += ["item 1", "item 9876543", "x" * 5000, "一二三四五六七八九十" * 3, "一二三四五六七八九十" * 3 + "百"]
    df = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in enumerate(rows)], "doc_id bigint, text string, rid int, at string, stay int")
    out = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [r["n_kept"] for r in out] == [1, 0, 1] * 4 + [1, 1, 1, 1, 0] and all((r["rid"], r["at"], r["stay"]) == (1, "a", 2) for r in out)


def test_lines_of_any_length_are_verified_by_edit_distance(spark, monkeypatch):
    """Beyond a number of words only the share of common word pairs counted, beyond a number of characters no typos did."""
    monkeypatch.setattr(line_dedup, "BY_CHARACTER", 200)
    monkeypatch.setattr(line_dedup, "BY_WORD", 300)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(LETTERS, k=6)) for _ in range(4000)]
    rows, pairs = [], []
    for n, step, typo in ((60, 6, False), (60, 3, True), (60, 3, False), (400, 6, False), (400, 3, True), (400, 3, False)):
        a = rng.sample(vocabulary, n)
        b = [w if i % step else w[:-1] + ("a" if w[-1] != "a" else "b") if typo else rng.choice(vocabulary) for i, w in enumerate(a)]
        pairs.append((len(rows), edit_distance(" ".join(a), " ".join(b)) <= 0.25 * 7 * n))
        rows += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").withColumn("rid", F.xxhash64("doc_id", "text"))
    prints = line_dedup.fingerprints(docs).persist()
    of = {r["place"]["doc_id"]: r["id"] for r in prints.where("kind = 0").collect()}
    at = {(min(of[i], of[i + 1]), max(of[i], of[i + 1])): similar for i, similar in pairs}
    got = {(r["a"], r["b"]) for r in line_dedup._verified(spark.createDataFrame(list(at), "a bigint, b bigint"), prints, docs, 0.75).collect()}
    assert [similar for _, similar in pairs] == [True, True, False] * 2
    assert got == {p for p, similar in at.items() if similar}
