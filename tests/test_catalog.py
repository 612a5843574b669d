import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from tidegauge.plans import catalog, experiment
from tidegauge.sources import config as conf
from tidegauge.sources import datasets

DATA = "/root/testdata/sf0.001"
SOME = ["split_events", "count_windows_dropped_tail", "calendar_windows", "one_hot", "hashed_features", "ks_events", "psi_fallbacks", "policy_summary", "detection_summary", "drift_quality_correlations", "wilcoxon_signed_rank", "friedman_test", "report_ablation"]


def rows(df):
    df = df[sorted(df.columns)]
    # whole numbers with nulls among them come as floats from one side
    one = lambda x: "null" if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and np.isnan(x) else round(float(x), 5) + 0.0 if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted((tuple(one(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    mine, other = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(other.columns) and rows(mine) == rows(other)


def test_entry_and_registry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_experiment_with_recent_reference_and_retraining(spark, tmp_path):
    data = datasets.generate(spark, 1500, 5, 2, seed=4)
    config = experiment.Config(window_size=100, reference="recent", representation="pca", pca_components=2, methods=("mean_ks", "top2_psi"), retraining=True, periods=(2,), histories=("all",))
    result = experiment.run(data.frame, ["time"], data.features, data.target, data.task, config)
    assert result.window_scores.select("reference_mode", "drift_representation").distinct().collect() == [("recent", "pca")]
    assert {"no_retraining", "periodic_p2", "oracle_every_window"} <= {r["policy"] for r in result.retraining_summary.collect()}
    assert "window_scores" in conf.write_result(result, str(tmp_path))
    assert conf.read_results(spark, [str(tmp_path), str(tmp_path / "none")], "window_scores").count() == result.window_scores.count()


def test_sources(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("t,x,y\n1,2.5,yes\n2,3.5,no\n")
    got = datasets.load_csv(spark, str(tmp_path / "a b.csv"), "y", "t")
    assert (got.name, got.task, got.features) == ("a_b", "classification", ["x"])
    with pytest.raises(ValueError):
        datasets.load_csv(spark, str(tmp_path / "a b.csv"), "missing", "t")
    root = tmp_path / "arrays"
    (root / "split-default").mkdir(parents=True)
    order = np.random.default_rng(2).permutation(37)
    parts = {"train": order[:20], "val": order[20:26], "test": order[26:]}
    np.save(root / "X_num.npy", np.sqrt(np.arange(37.0))[:, None])
    np.save(root / "X_cat.npy", np.array([["even" if i % 2 == 0 else "odd", f"k{i % 5}"] for i in range(37)]))
    np.save(root / "Y.npy", np.arange(37) / 4)
    assert datasets.missing_files(str(root)) == ["info.json", *(f"split-default/{p}_idx.npy" for p in ("train", "val", "test"))]
    (root / "info.json").write_text('{"task_type": "regression"}')
    for part, at in parts.items():
        np.save(root / "split-default" / f"{part}_idx.npy", at)
    assert not datasets.missing_files(str(root))
    data = datasets.load_arrays(spark, str(root))
    out = data.frame.orderBy("time").collect()
    assert data.task == "regression" and [r["target"] for r in out] == (order / 4).tolist() and np.allclose([r["num_0"] for r in out], np.sqrt(order))
    assert [r["cat_1"] for r in out] == [f"k{i % 5}" for i in order] and [r["split"] for r in out] == ["train"] * 20 + ["validation"] * 6 + ["test"] * 11


def test_config_mapping(tmp_path):
    got = conf.experiment_config({"window_size": 50, "methods": ["energy"], "retraining": {"enabled": True, "periods": [2]}, "other": 1})
    assert (got.window_size, got.methods, got.retraining, got.periods) == (50, ("energy",), True, (2,))
    (tmp_path / "c.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        conf.load_yaml(str(tmp_path / "c.yaml"))


@pytest.fixture(scope="module")
def embeddings(tmp_path_factory):
    """2,600 vectors of 12 components; only component 10 of the last 500 moves."""
    x = np.random.default_rng(11).normal(size=(2600, 12))
    x[2100:, 10] += 3
    folder = tmp_path_factory.mktemp("embeddings")
    pd.DataFrame({"vec_id": np.arange(2600), "embedding": x.tolist(), "label": 0}).to_parquet(folder / "embeddings.parquet")
    return str(folder), x


def test_vector_queries_see_all_rows_and_components(spark, embeddings):
    folder, x = embeddings
    ref, windows = x[:1560], [x[1560:2060], x[2060:2600]]
    ref = ref[np.sort(np.random.default_rng(42).choice(1560, size=1000, replace=False))]
    d = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(-1)
    score = lambda name: [r["score"] for r in catalog.QUERIES[name](spark, folder).orderBy("window_index").collect()]
    want = [np.sqrt(2 * np.sqrt(d(ref, w)).mean() - np.sqrt(d(ref, ref)).mean() - np.sqrt(d(w, w)).mean()) for w in windows]
    assert np.allclose(score("energy_distance_whole"), want, atol=2e-6)
    want = []
    for w in windows:
        both = np.concatenate([ref, w])
        p = d(both, both)[np.triu_indices(len(both), 1)]
        g = 1 / (2 * np.median(p[p > 0]))
        k = lambda a, b: np.exp(-g * d(a, b)).mean()  # noqa: B023, E731
        want.append(np.sqrt(k(ref, ref) + k(w, w) - 2 * k(ref, w)))
    assert np.allclose(score("mmd_rbf_whole"), want, atol=2e-6)
    calm, moved = score("sinkhorn_divergence")
    assert moved > 1.25 * calm


def test_classifier_scores_every_window(spark, embeddings):
    calm, moved = (r["score"] for r in catalog.QUERIES["classifier_two_sample"](spark, embeddings[0]).orderBy("window_index").collect())
    assert abs(calm - 0.5) < 0.1 and moved > 0.8


def test_report_from_a_run_with_an_official_split_and_calendar_windows(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidegauge.plans import report

    data = datasets.generate(spark, 1200, 4, 1, seed=6)
    rows = data.frame.withColumn("time", F.expr("timestamp_seconds(time * 86400)"))
    named = rows.withColumn("part", F.when(F.unix_timestamp("time") / 86400 % 10 < 5, "Train").when(F.unix_timestamp("time") / 86400 % 10 < 7, "valid").otherwise("test"))
    features = [f for f in data.features if f != "time"]
    config = experiment.Config(window_mode="calendar", freq="Q", methods=("mean_ks", "max_ks", "top2_psi"), draws=20, least_windows=3)
    result = experiment.run(named, ["time"], features, data.target, data.task, config, split="part", dataset="made")
    sizes = result.window_scores.where("method = 'mean_ks'").groupBy("stream").agg(F.sum("window_size").alias("n"), F.count("*").alias("windows")).collect()
    assert {r["stream"]: r["n"] for r in sizes} == {"validation": 240, "test": 360} and all(r["windows"] >= 12 for r in sizes)
    conf.write_result(result, str(tmp_path / "a"))
    made = report.tables(lambda name: conf.read_results(spark, [str(tmp_path / "a")], name), "mean_ks")
    assert set(made) == {"downstream_quality", "correlations", "correlation_summary", "friedman", "psi_diagnostics_summary", "runtime_summary", "dataset_summary"}
    assert all(df.count() > 0 for df in made.values())
    assert {"spearman_ci_low", "dataset_model"} <= set(made["correlations"].columns)
    with pytest.raises(ValueError):
        experiment.run(named, ["time"], features, data.target, data.task, experiment.Config(least_windows=99), split="part")


def test_local_rows_and_small_groups(spark):
    from pyspark.sql import functions as F

    from tidegauge.functions import rankstats
    from tidegauge.operators import inject

    df = spark.range(100).select(F.lit(0).alias("window_index"), F.when(F.col("id") < 5, 9.0).otherwise(0.0).alias("x"))
    assert inject.local_rows(df, "x", 5.0, 0.5, 1).where("__local").count() == 50
    few = inject.local_rows(df, "x", 5.0, 0.03, 1).where("__local")
    assert few.count() == 3 and few.where("x = 9").count() == 3
    two = spark.createDataFrame([("m", 0, 1.0, 2.0), ("m", 1, 2.0, 3.0)], "method string, window_index int, score double, quality_drop double")
    assert rankstats.correlation_table(two).first()["kendall_tau"] is None
    pairs = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("a", 1, 1.5), ("b", 1, 3.0)], "method string, pair int, value double")
    assert rankstats.wilcoxon(pairs, "a").first()["p_value"] is None
