"""Queries whose cost grew faster than needed, or whose result was of a sample: their plans and results."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import boosting, distance, encode
from tidegauge.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_hashed_query_makes_no_dense_rows(spark, monkeypatch):
    def refused(self):
        raise AssertionError("a dense row of all buckets")

    monkeypatch.setattr(encode.Encoder, "hashed", refused)
    assert sum(r["n_rows"] for r in catalog.hashed_features(spark, DATA).collect()) == catalog.read(spark, DATA, "events").count()


def test_dense_hashing_counts_tokens(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("b", "a")], "p string, q string")
    enc = encode.Encoder.fit(rows, encode.FeatureTypes(high=["p", "q"]), 16)
    got = rows.select(enc.hashed().alias("h"), enc.hash_places().alias("at")).collect()
    assert all(r["h"] == [float(list(r["at"]).count(b)) for b in range(16)] for r in got)


@pytest.mark.parametrize("per_part", [10_000, 20])
def test_boosting_keeps_equal_rows_once(spark, monkeypatch, per_part):
    """The same rows three times over give the model of the rows with three times the weights, and take no more places in memory."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (300, 2)).astype(float)
    y = ((x[:, 0] > x[:, 1]) ^ (rng.random(300) < 0.2)).astype(int)
    held, take = [], boosting.settled
    monkeypatch.setattr(boosting, "settled", lambda df: held.append(take(df)) or held[-1])
    data = [([float(v) for v in r], int(t)) for r, t in zip(x, y)]
    s = boosting.Settings(rounds=4, rate=0.3, leaves=5, least_rows=1)
    probe = spark.createDataFrame([(r,) for r, _ in data], "features array<double>")
    fits = [boosting.fit(spark.createDataFrame(data * k, "features array<double>, label int"), "classification", settings, per_part=per_part) for k, settings in ((1, s), (3, replace(s, l2=3 * s.l2, least_rows=3)))]
    one, three = (np.array([r["scores"] for r in boosting.predict(probe, m, "classification").collect()]) for m in fits)
    assert np.allclose(one, three, atol=1e-9)
    sizes = [sum(len(r["y"]) // 8 for r in df.select("y").collect()) for df in held if "margin" in df.columns]
    assert set(sizes) == {len({(*r, t) for r, t in zip(map(tuple, x), y)})}


def test_energy_of_whole_tables_beyond_a_sample(spark, tmp_path):
    """More than 1000 rows a side: the reference was a sample of 1000 rows before."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 8)).astype("float32")
    x[2500:] += 0.2
    x[10] = x[11] = x[3000]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["window_index"]: r["score"] for r in catalog.energy_distance(spark, str(tmp_path)).collect()}
    x = x.astype(float)
    mean = lambda a, b: np.mean([np.sqrt(((b - r) ** 2).sum(axis=1)).mean() for r in a])
    ref = x[:2400]
    for w, at in enumerate((2400, 2900, 3400)):
        cur = x[at : at + 500] if w < 2 else x[at:]
        want = np.sqrt(max(2 * mean(ref, cur) - mean(ref, ref) - mean(cur, cur), 0))
        assert abs(got[w] - want) < 2e-6
    assert len(got) == 3


def test_pairs_of_blocks_are_never_shuffled(spark, monkeypatch):
    """Every pair of blocks of the energy distance went through an exchange, with both blocks: disk grew with the square of the rows."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(distance, "SIDE", 20)
    x, y = rng.normal(size=(110, 3)), rng.normal(size=(70, 3)) + 0.3
    held, take = [], distance.settled
    monkeypatch.setattr(distance, "settled", lambda df: held.append(df) or take(df))
    rows = lambda z, at: [(i // 40 + at, i, [float(v) for v in r]) for i, r in enumerate(z)]
    ref, cur = (spark.createDataFrame(rows(z, 7), "window_index bigint, srn bigint, features array<double>") for z in (x, y))
    got = {r["window_index"]: r["score"] for r in distance.energy_whole(ref.drop("window_index"), cur).collect()}
    mean = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).mean()
    want = {7: y[:40], 8: y[40:]}
    assert got.keys() == want.keys() and all(abs(got[w] - np.sqrt(2 * mean(x, c) - mean(x, x) - mean(c, c))) < 1e-9 for w, c in want.items())
    pairs = [df._jdf.queryExecution().optimizedPlan().toString() for df in held if "kind" in df.columns]
    assert pairs and not any("Repartition" in p for p in pairs)


def test_windows_in_pairs_are_spread_over_tasks(spark):
    """Small windows all came to one task, since their bytes are few, and pairs of reference rows were compared anew for every window."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=(16, 30, 2))
    x[5] = x[6]
    ref = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "srn bigint, features array<double>")
    cur = spark.createDataFrame([(w, i, [float(v) for v in r]) for w, rows in enumerate(y) for i, r in enumerate(rows)], "window_index bigint, srn bigint, features array<double>")
    calls = spark.sparkContext.accumulator(0)

    def known(z):
        calls.add(1)
        return z

    got = distance.by_window(ref, cur, lambda a, b: float(a.sum() + b.sum()), known).withColumn("task", F.spark_partition_id()).collect()
    assert {r["window_index"] for r in got} == set(range(16)) and len({r["task"] for r in got}) > 3
    assert calls.value == len({r["task"] for r in got}) < 16
    d = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=2)
    mean = lambda a, b: np.sqrt(d(a, b)).mean()
    energy, mmd = ({r["window_index"]: r["score"] for r in f(ref, cur).collect()} for f in (distance.energy, distance.mmd))
    for w, z in enumerate(y):
        both = np.concatenate([x, z])
        pairs = d(both, both)[np.triu_indices(len(both), 1)]
        g = 1 / (2 * np.median(pairs[pairs > 0]))
        k = lambda a, b: np.exp(-g * d(a, b)).mean()  # noqa: B023, E731
        assert abs(energy[w] - np.sqrt(2 * mean(x, z) - mean(x, x) - mean(z, z))) < 1e-9
        assert abs(mmd[w] - np.sqrt(max(k(x, x) + k(z, z) - 2 * k(x, z), 0))) < 1e-9


def test_quantiles_on_directions_equal_numpy_without_a_row_a_value(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(distance, "BINS", 256)
    monkeypatch.setattr(distance, "projected", lambda *a: 1 / 0)  # a row for every projected value
    at = distance.quantile_grid(33)
    for x in (np.exp(4 * rng.normal(size=(3000, 2))), rng.integers(0, 3, (300, 2)).astype(float)):
        df = spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>")
        theta = np.array([[1.0, 0.6], [0.0, -0.8]])
        assert np.allclose(distance.direction_quantiles(df, theta, at, 50), np.quantile(x @ theta, at, axis=0), rtol=1e-12, atol=1e-12)


def test_places_of_values_equal_a_search():
    """Counting projected values took a binary search of all edges for every value."""
    rng = np.random.default_rng(2)
    for edges in (np.linspace(-3, 4, 1025), np.sort(rng.normal(size=300)), np.array([1.0]), np.array([0.0, 1e-320]), np.unique(np.r_[np.linspace(0, 1, 9), 0.5 + np.arange(64) * 2.0**-52, 1e9])):
        z = np.concatenate([rng.normal(size=4000), edges, np.nextafter(edges, np.inf), np.nextafter(edges, -np.inf), rng.choice([-1e300, 1e300, 0.5], 9)])
        for cells in (4, 64, 2048):
            assert (distance.Places(edges, cells)(z) == np.searchsorted(edges, z, "left")).all()
    places = distance.Places(np.linspace(0, 1, 4097), 8192)
    places.edges = places.edges.view(type("Unsearched", (np.ndarray,), {"searchsorted": lambda *a: 1 / 0}))
    assert (places(np.linspace(0.0001, 0.9, 50)) == np.ceil(np.linspace(0.0001, 0.9, 50) * 4096)).all()


def test_transport_rounds_are_products(monkeypatch):
    """The log domain only takes over where a kernel leaves the range of doubles; both give the same cost."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(120, 3)), rng.normal(size=(80, 3)) + 0.1
    took, log = [], distance.log_sinkhorn_cost
    monkeypatch.setattr(distance, "log_sinkhorn_cost", lambda *a: took.append(1) or log(*a))
    assert abs(distance.sinkhorn_cost(x, y, 5.0, 0.05) - log(distance.squares(x, y) / 5.0, 0.05, 300)) < 1e-12 and not took
    y[:5] += 80.0
    assert np.isfinite(distance.sinkhorn_cost(x, y, 5.0, 0.05)) and took


def test_item_values_are_counted_once(spark, monkeypatch):
    """KS and PSI of line items take counts of values from one pass, instead of a row a cell that every branch makes anew."""
    passes, take = [], encode.Encoder.transform
    monkeypatch.setattr(encode.Encoder, "transform", lambda self, *a, **b: passes.append(1) or take(self, *a, **b))
    ref, cur = catalog.item_samples(spark, DATA)
    assert "r" in ref.columns and "c" in cur.columns and len(passes) == 1
    assert ref.agg(F.sum("r")).first()[0] == 4 * int(catalog.read(spark, DATA, "lineitem").count() * 0.6)
    assert "transform" not in ref._jdf.queryExecution().optimizedPlan().toString() and "explode" not in cur._jdf.queryExecution().optimizedPlan().toString()
