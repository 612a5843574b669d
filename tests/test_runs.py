"""Configurations, command line, batches, ablations and drift injection, on small made tables."""

import numpy as np
import pytest

from tidegauge import cli
from tidegauge.operators import encode, ordering
from tidegauge.plans import experiment, report, runs
from tidegauge.sources import config as conf
from tidegauge.sources import datasets

QUICK = experiment.Config(window_size=60, methods=("mean_ks", "max_psi"), draws=10)


@pytest.fixture(autouse=True)
def keep_session(spark):
    """Commands take the running session."""


@pytest.fixture(scope="module")
def made(spark):
    data = datasets.generate(spark, 900, 4, 1, seed=9)
    data.frame.cache().count()
    return data


def test_names_of_settings():
    got = conf.experiment_config({"train_frac": 0.5, "reference_mode": "recent", "mmd_max_samples": 7, "min_test_windows": 30, "n_jobs": -1})
    assert (got.train, got.reference, got.max_pairs, got.least_windows, got.retraining) == (0.5, "recent", 7, 0, False)
    got = conf.experiment_config({"min_test_windows": 30, "enforce_min_test_windows": True, "retraining": {"periods": [4, 8], "oracle_min_quality_drop": 0.1}})
    assert (got.least_windows, got.retraining, got.periods, got.least_drop) == (30, True, (4, 8), 0.1)
    values = {"experiment": {"window_size": 70, "seed": 3}, "synthetic_drift": {"window_size": 80, "drift_start_window": 2, "scenarios": ["mixed_shift", "mean_shift"], "missing_probability": 0.5}}
    config, drift = conf.drift_config(values)
    assert (config.window_size, config.seed, drift.start, drift.scenarios, drift.missing) == (80, 3, 2, ("mixed_shift", "mean_shift"), 0.5)
    grid = conf.ablation_config({"ablation": {"window_sizes": [10], "run_threshold": False}})
    assert [k for k, _, _ in grid.runs(QUICK)].count("window_size") == 1 and all(k != "threshold_quantile" for k, _, _ in grid.runs(QUICK))
    assert conf.models({"experiment": {"models": "linear"}}) == ["linear"] and conf.models({"experiment": {"model_names": ["a", "b"]}}) == ["a", "b"]
    assert conf.models({}) == ["linear"]


def test_output_folders():
    assert conf.output_dir({"output": "x"}) == "x" and conf.output_dir({}, "y") == "y"
    assert conf.drift_output_dir({"output_dir": "a/b"}) == "a/b_synthetic_drift" and conf.drift_output_dir({"synthetic_drift_output_dir": "z"}) == "z"
    assert conf.batch_dir({"output_dir": "results/q"}, "c/one.yaml", "out", "m", True) == "out/one__m"
    assert conf.batch_dir({"output_dir": "/abs/q"}, "c/one.yaml", "out", "m", False) == "/abs/q"
    assert conf.batch_dir({"output_dir": "s3a://b/q"}, "c/one.yaml", "out", "m", False) == "s3a://b/q"


def test_spec_names(spark):
    data = datasets.load_spec(spark, {"type": "synthetic", "name": "n", "task_type": "regression", "n_samples": 50, "n_numeric": 1, "n_categorical": 0, "drift_start_frac": 1.1, "seed": 1})
    assert (data.name, data.task, data.frame.count(), data.features) == ("n", "regression", 50, ["x_num_0"])


def test_feature_sample(spark):
    rows = spark.createDataFrame([([float(i) for i in range(9)],)], "features array<double>")
    long = encode.long_form(rows, [])
    some = [r["feature_id"] for r in ordering.sample_features(long, 9, 4, 5).orderBy("feature_id").collect()]
    assert some == sorted(np.random.default_rng(5).choice(9, size=4, replace=False).tolist())
    assert ordering.sample_features(long, 9, None, 5).count() == ordering.sample_features(long, 9, 9, 5).count() == 9


def test_run_times_and_summary(made):
    result = experiment.run(made.frame, ["time"], made.features, made.target, made.task, QUICK, dataset="d")
    times = result.window_scores.select("runtime_seconds").collect()
    assert times and all(r[0] > 0 for r in times)
    one = result.dataset_summary.first()
    assert (one["dataset"], one["n_rows"], one["n_features"]) == ("d", 900, 5)
    got = report.runtime_summary(result.window_scores, ["dataset", "model", "method"]).collect()
    assert {r["method"] for r in got} == {"mean_ks", "max_psi"} and all(r["runtime_median"] > 0 for r in got)


def test_ablation(made):
    grid = runs.Ablation(window_sizes=(60,), threshold_quantiles=(0.9,), run_projection_count=False, run_reference_mode=False, run_representation=False)
    config = experiment.Config(window_size=90, methods=("mean_ks",), draws=5, periods=(2,), histories=("all",))
    got = runs.ablate(made.frame, ["time"], made.features, made.target, made.task, config, grid, dataset="d")
    assert set(got) == {"ablation_correlations", "ablation_runtimes", "ablation_retraining", "ablation_runs"}
    kinds = [(r["ablation_type"], r["ablation_value"]) for r in got["ablation_runs"].orderBy("run_id").collect()]
    assert kinds == [("window_size", "60"), ("threshold_quantile", "0.9")]
    assert {r["ablation_type"] for r in got["ablation_retraining"].collect()} == {"threshold_quantile"}
    both = report.ablation_summary(got["ablation_correlations"], got["ablation_runtimes"]).collect()
    assert len(both) == 2 and all(r["runtime_median"] > 0 and r["n_runs"] == 1 for r in both)


def test_drift_command_and_report(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(
        "dataset: {type: synthetic, n_samples: 900, n_numeric: 3, n_categorical: 1, drift_start_frac: 1.1}\n"
        "experiment: {window_size: 60, seed: 5}\n"
        f"output_dir: {tmp_path}/out\n"
        "synthetic_drift: {drift_start_window: 1, methods: [mean_ks], scenarios: [mean_shift, local_subpopulation_shift], mean_delta: 5.0, numeric_fraction: 1.0}\n"
    )
    assert cli.main(["drift", str(tmp_path / "c.yaml")]) == 0
    summary = {r["scenario"]: r for r in spark.read.parquet(f"{tmp_path}/out_synthetic_drift/drift_summary").collect()}
    assert set(summary) == {"mean_shift", "local_subpopulation_shift"} and summary["mean_shift"]["auroc"] == 1.0
    assert cli.main(["report", f"{tmp_path}/out_synthetic_drift", "--output", f"{tmp_path}/report"]) == 0
    assert spark.read.parquet(f"{tmp_path}/report/drift_detection_summary").count() == 1


def test_batch_resumes_and_excludes(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("dataset: {type: synthetic, name: made, n_samples: 700, n_numeric: 2, n_categorical: 1}\nexperiment: {window_size: 70, methods: [mean_ks], draws: 5, model_names: [linear, nonsense]}\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    command = ["batch", str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), "--output", str(tmp_path / "out")]
    assert cli.main(command) == 0
    read = lambda: {(r["config_path"][-6:], r["model"]): r for r in spark.read.parquet(f"{tmp_path}/out/run_manifest").collect()}
    first = read()
    ok, bad, unread = first["a.yaml", "linear"], first["a.yaml", "nonsense"], first["b.yaml", ""]
    assert (ok["status"], ok["dataset"], ok["n_samples"], ok["reason"], len(ok["config_sha256"])) == ("completed", "made", 700, "", 64)
    assert bad["status"] == "excluded" and "nonsense" in bad["reason"] and bad["traceback"] and unread["status"] == "excluded"
    assert spark.read.parquet(f"{tmp_path}/out/dataset_exclusions").count() == 2 and spark.read.parquet(f"{tmp_path}/out/environment_manifest").count() == 1
    assert cli.main([*command, "--fail-fast"]) == 0
    again = read()
    assert again["a.yaml", "linear"]["reason"] == "already completed" and len(again) == 2


def test_synthetic_and_csv_commands(spark, tmp_path):
    assert cli.main(["make-synthetic", "--n-samples", "600", "--output", str(tmp_path / "csv")]) == 0
    assert cli.main(["run-csv", "--path", str(tmp_path / "csv"), "--target", "target", "--time", "time", "--window-size", "60", "--methods", "mean_ks", "--ks-features", "3", "--output", str(tmp_path / "run")]) == 0
    assert conf.completed(spark, str(tmp_path / "run"), ("mean_ks",)) == ("csv", 600)
    assert spark.read.parquet(str(tmp_path / "run" / "retraining_summary")).count() > 0
    assert conf.completed(spark, str(tmp_path / "run"), ("max_psi",)) is None
