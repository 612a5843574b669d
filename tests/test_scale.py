"""Operators that replace whole-group or driver-side forms: exact quantiles, blocked products, prepared and rolling references, boosting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import boosting, distance, encode, ordering, quality
from tidegauge.operators.quantiles import exact_quantiles
from tidegauge.plans import experiment, scoring
from tidegauge.sources import datasets


def rows(spark, x, window=None):
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(data, "srn bigint, features array<double>")
    return df if window is None else df.withColumn("window_index", F.lit(window).cast("long"))


def union(frames):
    return distance.union_all(frames)


# --- Exact quantiles ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [5, 60, 100_000])
def test_quantiles_equal_numpy(spark, small):
    rng = np.random.default_rng(small)
    groups = {"even": rng.normal(size=900), "ties": rng.integers(0, 4, 700).astype(float), "point": np.full(300, 2.5), "far": np.r_[rng.normal(size=400), 1e300, -1e300], "one": np.array([7.0]), "huge": np.r_[1.7e308, -1.7e308, rng.normal(size=200)]}
    at = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    data = [(g, float(v), i) for g, x in groups.items() for i, v in enumerate(x)] + [("even", None, 0), ("none", None, 0)]
    got = {r["g"]: r["q"] for r in exact_quantiles(spark.createDataFrame(data, "g string, z double, i int"), ["g"], "z", at, small=small).collect()}
    assert got.pop("none", None) is None and set(got) == set(groups)
    for g, x in groups.items():
        s = np.sort(x)
        p = np.array(at) * (len(s) - 1)
        lo, hi = np.floor(p).astype(int), np.ceil(p).astype(int)
        want = np.where(lo == hi, s[lo], (hi - p) * s[lo] + (p - lo) * s[hi])
        assert np.allclose(got[g], want, rtol=1e-12, atol=1e-12), g


def test_quantiles_with_weights_and_without_keys(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 200)], "z double, r int")
    x = np.repeat([1.0, 2.0, 5.0], [3, 1, 200])
    for small in (2, 1000):
        assert np.allclose(exact_quantiles(df, [], "z", [0.0, 0.01, 0.5], weight="r", small=small).first()["q"], np.quantile(x, [0.0, 0.01, 0.5]))


def test_quantiles_of_ten_million_distinct_values(spark):
    n = 10_000_000
    shuffled = spark.range(n).select(((F.col("id") * 7_368_787) % n).cast("double").alias("z"))  # a permutation: the factor is prime to n
    got = exact_quantiles(shuffled, [], "z", [0.0, 0.25, 0.5, 0.999, 1.0])
    assert np.allclose(got.first()["q"], np.array([0.0, 0.25, 0.5, 0.999, 1.0]) * (n - 1), rtol=0, atol=1e-6)


def test_median_of_training_rows_uses_no_percentile(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("x"))
    enc = encode.Encoder.fit(df, encode.FeatureTypes(numeric=["x"]))
    assert enc.median["x"] == np.median([i for i in range(1000) if i % 10])


# --- Products ------------------------------------------------------------------------------------------------------------


def test_wide_projection_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(40, 300))
    theta = encode.directions(300, 128)
    got = np.zeros((40, 128))
    for r in encode.projected(rows(spark, x), ["srn"], theta).collect():
        got[r["srn"], r["proj_id"]] = r["z"]
    assert np.allclose(got, x @ theta)


def test_wide_components_explain_as_much(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 2000)) * 3 + rng.normal(size=(300, 2000))
    df = rows(spark, x)
    exact = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:5]
    out = np.array([r["features"] for r in encode.pca(df, 5)(df).select("features").collect()])
    assert abs((out**2).sum() / (exact**2).sum() - 1) < 0.01
    narrow = rows(spark, x[:, :40])
    both = [np.abs(np.array([r["features"] for r in encode.pca(narrow, 3, wide=w)(narrow).orderBy("srn").collect()])) for w in (10, 1024)]
    assert np.allclose(*both, atol=1e-3)


def test_sparse_features_count_and_score_like_dense_ones(spark):
    rng = np.random.default_rng(11)
    data = [(i // 60, i % 60, float(rng.normal()), f"k{rng.integers(0, 40)}", ["u", "v"][i % 2]) for i in range(240)]
    raw = spark.createDataFrame(data, "window_index bigint, srn bigint, x double, many string, few string")
    enc = encode.Encoder.fit(raw, encode.FeatureTypes(["x"], ["few"], ["many"]), buckets=16)
    sparse = enc.transform(raw, ["window_index", "srn"])
    dense = encode.dense(sparse)
    assert encode.is_sparse(sparse) and encode.dimension(sparse) == 19 and dense.select(F.min(F.size("features"))).first()[0] == 19
    assert sparse.agg(F.max(F.size("features.values"))).first()[0] <= 3
    counts = lambda df: {(r[0], r[1], round(r[2], 9)): r[3] for r in encode.value_counts(df, ["window_index"], "c").collect()}
    assert counts(sparse) == counts(dense)
    got = [scores(scoring.score_windows(df.where("window_index = 0").drop("window_index"), df.where("window_index > 0"), METHODS, CONFIG)) for df in (sparse, dense)]
    assert set(got[0]) == set(got[1]) and all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])
    labelled = [df.withColumn("label", (F.col("srn") % 3 == 0).cast("int")) for df in (sparse, dense)]
    for name in ("linear", "hist_gbdt"):
        two = [np.array([r["score"] for r in quality.fit_model(df, name, "classification")(df).orderBy("window_index", "srn").collect()]) for df in labelled]
        assert np.allclose(*two, atol=1e-6), name


def test_ordered_target_statistics(spark):
    rows_ = [(i, ["a", "b", None][i % 3], i % 2 if i != 7 else None) for i in range(30)]
    out, table = encode.ordered_target(spark.createDataFrame(rows_, "rn int, k string, y int"), "k", "y", "rn", "m", 2.0)
    mean = np.mean([y for _, _, y in rows_ if y is not None])
    for r in out.collect():
        before = [y for i, k, y in rows_ if k == r["k"] and i < r["rn"] and y is not None]
        assert abs(r["m"] - (sum(before) + 2 * mean) / (len(before) + 2)) < 1e-12
    assert {r["k"] for r in table.collect()} == {"a", "b", "__missing__"} and set(out.columns) == {"rn", "k", "y", "m"}


# --- References ----------------------------------------------------------------------------------------------------------


METHODS = ("mean_ks", "max_ks", "mean_psi", "top2_psi", "sliced_k8_q32", "mmd_rbf", "energy", "c2st", "sinkhorn")
CONFIG = experiment.Config(max_pairs=60, energy_rows=50, c2st_rows=100)


def scores(df):
    return {(r["window_index"], r["method"]): r["score"] for r in df.collect()}


def test_rolling_references_equal_one_by_one(spark):
    rng = np.random.default_rng(3)
    refs = [np.column_stack([rng.normal(k / 3, 1, size=(90 + 10 * k, 2)), rng.integers(0, 2, 90 + 10 * k)]) for k in range(3)]
    cur = [np.column_stack([rng.normal(0.4, 1, size=(80, 2)), rng.integers(0, 2, 80)]) for _ in range(3)]
    got = scores(scoring.score_windows(union([rows(spark, x, k) for k, x in enumerate(refs)]), union([rows(spark, x, k) for k, x in enumerate(cur)]), METHODS, CONFIG))
    assert len(got) == 3 * len(METHODS)
    for k in range(3):
        one = scores(scoring.score_windows(rows(spark, refs[k]), rows(spark, cur[k], k), METHODS, CONFIG))
        assert all(abs(got[key] - v) < 1e-9 for key, v in one.items()), k


def test_large_windows_take_the_other_way(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 3)), [rng.normal(0.5, 1, size=(n, 3)) for n in (40, 120)]
    theta, cur = encode.directions(3, 6), union([rows(spark, v, k) for k, v in enumerate(y)])
    ref = distance.sliced_reference(rows(spark, x), theta, 16)
    own = union([rows(spark, x, k) for k in range(2)])
    got = [{r[0]: r[1] for r in distance.sliced_windows(r, cur, theta, 16).collect()} for r in (ref, own)]
    monkeypatch.setattr(distance, "WHOLE", 100)
    got += [{r[0]: r[1] for r in distance.sliced_windows(r, cur, theta, 16).collect()} for r in (ref, own)]
    assert all(set(g) == {0, 1} and all(abs(g[k] - got[0][k]) < 1e-9 for k in g) for g in got)


def test_stored_reference_needs_no_training_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows(spark, rng.normal(size=(200, 3))).write.parquet(str(tmp_path / "training"))
    base = spark.read.parquet(str(tmp_path / "training"))
    cur = union([rows(spark, rng.normal(0.3, 1, size=(70, 3)), k) for k in range(2)])
    scoring.prepare(base, METHODS, CONFIG).store(str(tmp_path / "ready"))
    ready = scoring.Prepared.load(spark, str(tmp_path / "ready"))
    want, got = scores(scoring.score_windows(base, cur, METHODS, CONFIG)), scores(scoring.score_windows(ready, cur, METHODS, CONFIG))
    assert set(want) == set(got) and all(abs(want[k] - got[k]) < 1e-9 for k in want)
    read = distance.psi(ready.counts, encode.long_form(cur, ["window_index"]), 10, ready.edges).inputFiles()
    assert read and all("/ready/" in f for f in read)


def test_classifier_score_equals_plain_folds(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(70, 3)), rng.normal(0.7, 1, size=(50, 3))
    got = distance.c2st_windows(rows(spark, x), rows(spark, y, 4), folds=5).first()
    assert got["window_index"] == 4
    # plain gradient steps to the same optimum, on the folds that the seed gives
    draw = np.random.default_rng(42)
    fold = np.concatenate([draw.permutation(np.arange(n) % 5) for n in (70, 50)])
    both, label = np.concatenate([x, y]), np.repeat([0, 1], [70, 50])
    w = 120 / (2 * np.where(label == 0, 70, 50))
    aucs = []
    for f in range(5):
        a, t, v = both[fold != f], label[fold != f], w[fold != f]
        b, c = np.zeros(3), 0.0
        for _ in range(6000):
            e = v * (1 / (1 + np.exp(-(a @ b + c))) - t)
            b, c = b - 0.01 * (a.T @ e + b), c - 0.01 * e.sum()
        s, t = both[fold == f] @ b + c, label[fold == f]
        aucs.append(np.mean([float(p > q) + 0.5 * (p == q) for p in s[t == 1] for q in s[t == 0]]))
    assert abs(got["score"] - np.mean(aucs)) < 1e-9


# --- Order ---------------------------------------------------------------------------------------------------------------


def test_equal_times_keep_the_order_of_the_input(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part-{f}.csv").write_text("t,x,y\n" + "".join(f"{i // 40},{(f * 1000 + i) * 7919 % 3001},{i % 3}\n" for i in range(200)))
    data = datasets.load_csv(spark, str(tmp_path), "y", "t")
    assert data.features == ["x"] and data.order == ["t", "source_order"]
    got = [r["x"] for r in ordering.with_ordinal(data.frame, *data.order).orderBy("rn").collect()]
    assert got == [(f * 1000 + i) * 7919 % 3001 for t in range(5) for f in range(3) for i in range(40 * t, 40 * t + 40)]
    data.frame.drop("source_order").repartition(3).write.parquet(str(tmp_path / "p"))
    files = sorted((tmp_path / "p").glob("*.parquet"))
    kept = [r["x"] for f in files for r in spark.read.parquet(str(f)).collect() if r["t"] == 2]
    data = datasets.load_parquet(spark, str(tmp_path / "p"), "y", "t")
    assert [r["x"] for r in ordering.with_ordinal(data.frame, *data.order).orderBy("rn").where("t = 2").collect()] == kept


# --- Boosting --------------------------------------------------------------------------------------------------------------


def plain_boosting(x, y, rounds, rate, leaves, l2, least, classes):
    """Best-first trees over the same bins, a row at a time: margins of the training rows."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 256)[1:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    k = 1 if classes == 2 else classes
    share = np.bincount(y, minlength=classes) / len(y)
    margin = np.repeat((np.log(share) if k > 1 else np.array([np.log(share[1] / share[0])]))[None], len(y), 0)
    for _ in range(rounds):
        if k == 1:
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(k)), p * (1 - p)
        for c in range(k):
            score = lambda r: g[r, c].sum() ** 2 / (h[r, c].sum() + l2)  # noqa: B023,E731

            def best(r):
                found = (1e-12, None)
                for j in range(bins.shape[1]):
                    for cut in range(bins[r, j].min(), bins[r, j].max()):
                        a, b = r[bins[r, j] <= cut], r[bins[r, j] > cut]
                        if min(len(a), len(b)) >= least:
                            gain = score(a) + score(b) - score(r)  # noqa: B023
                            if gain > found[0] + 1e-12:
                                found = (gain, (a, b))
                return found

            ends = [(best(np.arange(len(y))), np.arange(len(y)))]
            while len(ends) < leaves:
                i = max(range(len(ends)), key=lambda i: ends[i][0][0])
                (_, parts), _ = ends[i]
                if parts is None:
                    break
                ends[i : i + 1] = [(best(q), q) for q in parts]
            for _, r in ends:
                margin[r, c] -= rate * g[r, c].sum() / (h[r, c].sum() + l2)
    return margin


def log_loss(scored, y):
    return -np.mean([np.log(p[t]) for p, t in zip(scored, y)])


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_equals_plain(spark, classes):
    rng = np.random.default_rng(classes)
    x = np.round(rng.normal(size=(160, 3)), 1)
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (classes == 3) * (x[:, 2] > 0.5)
    df = rows(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "srn bigint, label int"), "srn")
    s = boosting.Settings(rounds=5, rate=0.3, leaves=5, least_rows=8)
    margin = plain_boosting(x, y, 5, 0.3, 5, s.l2, 8, classes)
    want = boosting.softmax(np.column_stack([np.zeros(len(margin)), margin]) if classes == 2 else margin)
    for per_part in (10_000, 60):  # inside one task, and by jobs over three parts
        model = boosting.fit(df, "classification", s, per_part=per_part)
        got = np.array([r["scores"] for r in boosting.predict(df, model, "classification").orderBy("srn").collect()])
        assert abs(log_loss(got, y) - log_loss(want, y)) < 1e-6


def test_boosting_over_parts_equals_one_task(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4))
    y = np.sin(x[:, 0] * 2) + x[:, 1] ** 2 + rng.normal(0, 0.1, 400)
    df = rows(spark, x).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "srn bigint, label double"), "srn")
    for growth in ("level", "symmetric"):
        s = boosting.Settings(rounds=4, rate=0.3, growth=growth, leaves=16, depth=3, row_share=0.8, column_share=0.75, refresh=2)
        got = [np.array([r["predicted"] for r in boosting.predict(df, boosting.fit(df, "regression", s, per_part=p), "regression").orderBy("srn").collect()]) for p in (10_000, 150)]
        assert np.allclose(*got, atol=1e-9) and np.mean((got[0] - y) ** 2) < 0.8 * np.var(y)


def test_names_of_models_differ(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    df = rows(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "srn bigint, label int"), "srn")
    import dataclasses

    presets = {k: dataclasses.replace(s, rounds=min(40, s.rounds)) for k, s in boosting.PRESETS.items()}
    assert {k: s.rounds for k, s in boosting.PRESETS.items()} == {"hist_gbdt": 300, "gbdt": 300, "lightgbm": 500, "xgboost": 500, "catboost": 500}
    monkeypatch.setattr(boosting, "PRESETS", presets)
    got = {m: [r["score"] for r in quality.fit_model(df, m, "classification")(df).orderBy("srn").collect()] for m in presets}
    assert got["hist_gbdt"] == got["gbdt"]
    names = ["hist_gbdt", "lightgbm", "xgboost", "catboost"]
    assert all(not np.allclose(got[a], got[b], atol=1e-4) for i, a in enumerate(names) for b in names[i + 1 :])
    assert all(np.mean((np.array(got[m]) >= 0.5) == y) > 0.9 for m in names)
    for m in names:
        forest = boosting.fit(df, "classification", presets[m])
        shapes = [t.inner for trees in forest.trees for t in trees]
        if m == "catboost":
            assert all(len({t[n] for n in t if n.bit_length() == d}) <= 1 for t in shapes for d in range(1, 7))
        elif m == "xgboost":
            assert max((max(t, default=1).bit_length() for t in shapes)) <= 6


def test_experiment_with_classes_of_texts(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 2))
    names = np.array(["low", "mid", "top"])[np.digitize(x[:, 0], [-0.5, 0.5])]
    df = spark.createDataFrame([(i, *map(float, v), str(n)) for i, (v, n) in enumerate(zip(x, names))], "t int, a double, b double, y string")
    config = experiment.Config(window_size=50, methods=("mean_ks",), model="linear", draws=5)
    for rows_, least in ((df, 0.8), (df.withColumn("y", F.when(F.col("y") == "low", "no").otherwise("yes")), 0.9)):
        got = experiment.run(rows_, ["t"], ["a", "b"], "y", "classification", config).window_scores.collect()
        assert len(got) == 4 and all(r["quality"] > least for r in got)
        assert {r["primary_metric"] for r in got} == {"roc_auc_ovr" if rows_ is df else "roc_auc"}
    one = spark.createDataFrame([(0, [0.2, 0.5, 0.3], 1), (0, [0.6, 0.3, 0.1], 2), (0, [0.1, 0.1, 0.8], 2), (0, [0.9, 0.1, 0.0], 0), (0, [1.0, 0.0, 0.0], None)], "w int, scores array<double>, label int")
    r = quality.multiclass_metrics(one, ["w"]).first()
    assert r["accuracy"] == 0.75 and abs(r["logloss"] + np.mean(np.log([0.5, 0.1, 0.8, 0.9]))) < 1e-12


def test_kendall_equals_all_pairs(spark):
    from tidegauge.functions import rankstats

    rng = np.random.default_rng(13)
    for n in (3, 50, 300):
        x, y = rng.integers(0, n // 2 + 1, n).astype(float), rng.integers(0, n // 3 + 2, n).astype(float)
        x[:2] = y[:2] = 0, 1  # neither is constant
        dx, dy = (np.sign(v[:, None] - v[None, :])[np.triu_indices(n, 1)] for v in (x, y))
        assert abs(rankstats.kendall_tau(x, y) - (dx * dy).sum() / np.sqrt(np.abs(dx).sum() * np.abs(dy).sum())) < 1e-12
    assert rankstats.kendall_tau(np.ones(5), np.arange(5.0)) is None and rankstats.kendall_tau(np.arange(2.0), np.arange(2.0)) is None
    df = spark.createDataFrame([("a", i, float(i), float(-i)) for i in range(4)] + [("b", 0, 1.0, 2.0), ("a", 9, None, 1.0)], "k string, w int, x double, y double")
    assert {r["k"]: r["kendall_tau"] for r in rankstats.kendall(df, ["k"], "w", "x", "y").collect()} == {"a": -1.0, "b": None}


def test_stream_with_a_sketch_for_state(spark):
    from tidegauge.streaming import calendar

    exact, sketch = ({r["start"]: r for r in calendar.replay(spark, "/root/testdata/sf0.001", "events.parquet", "ts", "value", accuracy=a).collect()} for a in (None, 10_000))
    assert exact and set(exact) == set(sketch)
    assert all(exact[k]["n_rows"] == sketch[k]["n_rows"] and (exact[k]["n_rows"] < 30 or abs(exact[k]["score"] - sketch[k]["score"]) < 0.5 * exact[k]["score"] + 5) for k in exact)


# --- Dataset files -----------------------------------------------------------------------------------------------------------


def test_dataset_files_of_other_programs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("when;n;kind;y\n2024-01-02 03:00:00;5;x;1.5\n2024-01-01 03:00:00;NA;y;2.5\n")
    spec = {"type": "csv", "path": str(tmp_path / "a.csv"), "target_col": "y", "time_col": "when", "task_type": "regression", "read_csv_kwargs": {"sep": ";", "na_values": "NA", "parse_dates": ["when"], "dtype": {"kind": "str"}, "usecols": ["when", "n", "y"], "low_memory": False}}
    data = datasets.load_spec(spark, spec)
    assert data.features == ["n"] and data.frame.schema["when"].dataType.typeName() == "timestamp" and data.frame.where("n is null").count() == 1
    with pytest.raises(ValueError):
        datasets.load_spec(spark, spec | {"read_csv_kwargs": {"skipfooter": 3}})
    root = tmp_path / "some_arrays"
    (root / "split-default").mkdir(parents=True)
    np.save(root / "X_num.npy", np.arange(6, dtype=np.float32))  # one dimension
    np.save(root / "X_cat.npy", np.array([[1, 2]] * 6))
    np.save(root / "Y.npy", np.array([0, 1] * 3))
    for part, at in {"train": [0, 1], "val": [2, 3], "test": [4, 5]}.items():
        np.save(root / "split-default" / f"{part}_idx.npy", np.array(at))
    for kind in ("classification", "class", "multiclass"):
        (root / "info.json").write_text(f'{{"task_type": "{kind}"}}')
        data = datasets.load_spec(spark, {"type": "tabred", "path": str(root), "split": "default", "name": "n"})
        assert (data.task, data.name, data.features) == ("classification", "n", ["num_0", "cat_0", "cat_1"])
    assert data.frame.schema["cat_0"].dataType.typeName() == "string" and data.frame.count() == 6
    np.save(root / "X_meta.npy", np.array([["a"], [None]] * 3, dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        datasets.load_arrays(spark, str(root))


def test_window_mode_and_names_of_other_programs(spark):
    from tidegauge.sources import config as conf

    got = conf.experiment_config({"window_mode": "time", "window_time_freq": "M", "methods": ["own_k16", "mean_ks"], "method_names": {"own_k16": "sliced_k16"}})
    assert (got.window_mode, got.freq, got.methods) == ("time", "M", ("sliced_k16", "mean_ks"))
    _, drift = conf.drift_config({"synthetic_drift": {"scenarios": ["concept_like_shift", "mixed_shift"]}})
    assert drift.scenarios == ("concept_like_shift", "mixed_shift")
    with pytest.raises(ValueError):
        conf.drift_config({"synthetic_drift": {"scenarios": ["mixed"]}})
