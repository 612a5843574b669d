import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import distance, encode


def long(spark, arrays, window=None):
    rows = [(window or 0, f, float(v)) for f, a in enumerate(arrays) for v in a]
    return spark.createDataFrame(rows, "window_index bigint, feature_id int, value double")


def brute_ks(a, b):
    x = np.unique(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), x, "right") / len(a) - np.searchsorted(np.sort(b), x, "right") / len(b)).max()


def brute_psi(ref, cur, bins=10):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    if len(edges) >= 3:
        inner = edges[1:-1]
    elif set(ref) <= {0, 1} and set(cur) <= {0, 1}:
        inner = np.array([0.5])
    else:
        lo, hi = min(ref.min(), cur.min()), max(ref.max(), cur.max())
        if lo == hi:
            return 0.0
        inner = np.linspace(lo, hi, bins + 1)[1:-1]
    p, q = (np.maximum(np.bincount(np.searchsorted(inner, x, "right"), minlength=len(inner) + 1) / len(x), 1e-6) for x in (ref, cur))
    return float(((q - p) * np.log(q / p)).sum())


def samples(seed=3):
    rng = np.random.default_rng(seed)
    ref = [rng.normal(size=301), rng.integers(0, 2, 301).astype(float), np.zeros(301), np.where(rng.random(301) < 0.03, 5.0, 1.0), rng.integers(0, 6, 301).astype(float)]
    cur = [rng.normal(0.4, 1, 150), rng.integers(0, 2, 150).astype(float), np.where(rng.random(150) < 0.1, 1.0, 0.0), np.full(150, 1.0), rng.integers(1, 9, 150).astype(float)]
    return ref, cur


def test_ks_equals_brute_force(spark):
    ref, cur = samples()
    got = {r["feature_id"]: r["ks"] for r in distance.ks(long(spark, ref).drop("window_index"), long(spark, cur)).collect()}
    assert all(abs(got[i] - brute_ks(a, b)) < 1e-12 for i, (a, b) in enumerate(zip(ref, cur)))


def test_psi_equals_brute_force_with_fallbacks(spark):
    ref, cur = samples()
    got = {r["feature_id"]: r["psi"] for r in distance.psi(long(spark, ref).drop("window_index"), long(spark, cur)).collect()}
    assert all(abs(got[i] - brute_psi(a, b)) < 1e-9 for i, (a, b) in enumerate(zip(ref, cur)))


def rows(spark, x, window=0):
    return spark.createDataFrame([(window, i, [float(v) for v in r]) for i, r in enumerate(x)], "window_index bigint, srn bigint, features array<double>")


def test_sliced_energy_mmd_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(80, 4)), rng.normal(0.8, 1, size=(60, 4))
    theta = encode.directions(4, 16)
    z = lambda m: encode.projected(rows(spark, m), ["window_index"], theta)
    got = distance.sliced_wasserstein(z(x).drop("window_index"), z(y), 32).first()["score"]
    grid = np.linspace(0, 1, 32)
    assert abs(got - np.sqrt(((np.quantile(x @ theta, grid, axis=0) - np.quantile(y @ theta, grid, axis=0)) ** 2).mean())) < 1e-9
    d = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(-1)
    ref, cur = rows(spark, x).drop("window_index"), rows(spark, y)
    e = np.sqrt(2 * np.sqrt(d(x, y)).mean() - np.sqrt(d(x, x)).mean() - np.sqrt(d(y, y)).mean())
    assert abs(distance.energy(ref, cur).first()["score"] - e) < 1e-9
    both = np.concatenate([x, y])
    p = d(both, both)[np.triu_indices(len(both), 1)]
    g = 1 / (2 * np.median(p[p > 0]))
    k = lambda a, b: np.exp(-g * d(a, b)).mean()
    assert abs(distance.mmd(ref, cur).first()["score"] - np.sqrt(k(x, x) + k(y, y) - 2 * k(x, y))) < 1e-9


def test_sliced_subsamples_score_every_window(spark):
    rng = np.random.default_rng(6)
    x, windows = rng.normal(size=(90, 3)), [rng.normal(k, 1, size=(n, 3)) for k, n in ((0, 40), (1, 40), (0.5, 70))]
    ref = spark.createDataFrame([(i, k, float(v)) for i, r in enumerate(x) for k, v in enumerate(r)], "rn bigint, proj_id int, z double")
    cur = spark.createDataFrame([(w, i, k, float(v)) for w, y in enumerate(windows) for i, r in enumerate(y) for k, v in enumerate(r)], "window_index bigint, rn bigint, proj_id int, z double")
    got = {r["window_index"]: r["score"] for r in distance.sliced_subsamples(ref, cur, 90, {w: len(y) for w, y in enumerate(windows)}, size=50).collect()}
    assert len(got) == 3
    for w, y in enumerate(windows):
        draw, m, s = np.random.default_rng(42), min(len(y), 50), []
        for _ in range(5):
            a, b = x[draw.choice(90, size=m, replace=False)], y[draw.choice(len(y), size=m, replace=False)]
            s.append(np.sqrt(((np.sort(a, axis=0) - np.sort(b, axis=0)) ** 2).mean()))
        assert abs(got[w] - np.mean(s)) < 1e-9


def test_subsamples_project_drawn_rows_alone(spark):
    rng = np.random.default_rng(8)
    x, y, theta = rng.normal(size=(90, 3)), rng.normal(1, 1, size=(70, 3)), encode.directions(3, 4)
    ref = rows(spark, x).select(F.col("srn").alias("rn"), "features")
    cur = rows(spark, y).select(F.lit(0).cast("long").alias("window_index"), F.col("srn").alias("rn"), "features")
    got = distance.sliced_subsamples(ref, cur, 90, {0: 70}, size=50, theta=theta).first()["score"]
    draw, s = np.random.default_rng(42), []
    for _ in range(5):
        a, b = x[draw.choice(90, size=50, replace=False)] @ theta, y[draw.choice(70, size=50, replace=False)] @ theta
        s.append(np.sqrt(((np.sort(a, axis=0) - np.sort(b, axis=0)) ** 2).mean()))
    assert abs(got - np.mean(s)) < 1e-9


def test_shift_scores_higher_and_classifier_tells(spark):
    rng = np.random.default_rng(7)
    ref, near, far = rng.normal(size=(200, 3)), rng.normal(size=(200, 3)), rng.normal(1.25, 1, size=(200, 3))
    theta = encode.directions(3, 32)
    z = lambda m: encode.projected(rows(spark, m), ["window_index"], theta)
    s = [distance.sliced_wasserstein(z(ref).drop("window_index"), z(m), 64).first()["score"] for m in (near, far)]
    assert s[1] > 2 * s[0]
    base = rows(spark, ref).select("srn", "features")
    assert distance.c2st(base, rows(spark, far).select("srn", "features"), folds=2) > 0.85
    t = [distance.sinkhorn(base, rows(spark, m)).first()["score"] for m in (near, far)]
    assert t[1] > 2 * t[0]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.5, 1), (0, 0.5, 0), (0, 0.9, 1), (0, 0.1, 0), (1, 0.3, 1)], "k int, score double, label int")
    assert {r["k"]: r["auc"] for r in distance.auc(df, ["k"]).collect()} == {0: 0.875, 1: None}


def test_method_names():
    assert distance.parse_method("sliced_k64_q128") == ("sliced", {"projections": 64, "grid": 128})
    assert distance.parse_method("top7_psi") == ("psi", {"top": 7})
    assert distance.parse_method("robust_psi") == ("psi", {"top": 5})
    with pytest.raises(ValueError):
        distance.parse_method("nothing")


def test_pca_is_centred(spark):
    rng = np.random.default_rng(1)
    df = rows(spark, rng.normal(3, 1, size=(50, 3)) * [5, 1, 0.1])
    out = encode.pca(df, 2)(df).agg(F.avg(F.col("features")[0]).alias("m"), F.max(F.size("features")).alias("d")).first()
    assert abs(out["m"]) < 1e-9 and out["d"] == 2
