"""Run configurations from YAML and result tables on disk."""

from __future__ import annotations

import dataclasses
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import inject
from tidegauge.plans.experiment import Config, Result
from tidegauge.plans.runs import Ablation, Drift

#: Names of settings in configuration files, and ours where they differ.
SETTINGS = {
    "train_frac": "train",
    "val_frac": "validation",
    "window_time_freq": "freq",
    "min_window_size": "least_window",
    "reference_mode": "reference",
    "recent_reference_windows": "recent_windows",
    "drift_representation": "representation",
    "model_name": "model",
    "max_onehot_cardinality": "max_onehot",
    "hash_features": "buckets",
    "ks_max_features": "ks_features",
    "psi_max_features": "psi_features",
    "psi_n_bins": "psi_bins",
    "mmd_max_samples": "max_pairs",
    "energy_max_samples": "energy_rows",
    "c2st_max_samples": "c2st_rows",
    "c2st_n_splits": "c2st_folds",
    "run_retraining": "retraining",
    "retraining_periods": "periods",
    "retraining_history_modes": "histories",
    "rolling_history_windows": "rolling_windows",
    "oracle_min_quality_drop": "least_drop",
}
#: The same for a retraining section and for drift injection.
RETRAINING = {"enabled": "retraining", "history_modes": "histories"}
DRIFT = {
    "drift_start_window": "start",
    "numeric_fraction": "numeric_share",
    "categorical_fraction": "categorical_share",
    "mean_delta": "delta",
    "variance_multiplier": "scale",
    "correlation_angle_degrees": "degrees",
    "missing_probability": "missing",
    "local_fraction": "local",
}


def load_yaml(path: str) -> dict:
    import yaml

    got = yaml.safe_load(Path(path).read_text())
    if not isinstance(got, dict):
        raise ValueError("a configuration is a mapping")
    return got


def _made(kind: type, values: dict, names: dict):
    """A dataclass from the keys that it knows, under our names or those of ``names``; lists become tuples."""
    known = {f.name for f in dataclasses.fields(kind)}
    named = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return kind(**{k: v for k, v in named.items() if k in known})


def experiment_config(values: dict) -> Config:
    """Known keys of a mapping; a ``retraining`` section is flattened, lists become tuples, other keys are ignored.

    min_test_windows counts only with enforce_min_test_windows, and a retraining section without ``enabled`` retrains.
    ``method_names`` maps other names of drift methods to ours, for files written for another program.
    """
    values = dict(values)
    section = values.get("retraining")
    if isinstance(section, dict):
        del values["retraining"]
        section = {SETTINGS.get(k, RETRAINING.get(k, k)): v for k, v in section.items()}
        values = ({"retraining": True} | section if section else {}) | values
    names = values.pop("method_names", None) or {}
    if "methods" in values:
        values["methods"] = [names.get(m, m) for m in values["methods"]]
    if values.get("enforce_min_test_windows"):
        values.setdefault("least_windows", values.get("min_test_windows", 20))
    return _made(Config, values, SETTINGS)


def drift_config(values: dict) -> tuple[Config, Drift]:
    """The ``synthetic_drift`` section of a configuration, which inherits from ``experiment`` what it doesn't set itself."""
    own, shared = dict(values.get("synthetic_drift") or {}), dict(values.get("experiment") or {})
    unknown = [s for s in own.get("scenarios", []) if s not in inject.SCENARIOS]
    if unknown:
        raise ValueError(f"unknown scenarios: {unknown}")
    return experiment_config({**shared, **own}), _made(Drift, own, DRIFT)


def ablation_config(values: dict) -> Ablation:
    """The ``ablation`` section of a configuration."""
    return _made(Ablation, dict(values.get("ablation") or {}), {})


def models(values: dict) -> list[str]:
    """Model names of an experiment: model_names or models (a list or one name), else its one model."""
    section = values.get("experiment", values)
    got = section.get("model_names", section.get("models")) or [experiment_config(section).model]
    return [got] if isinstance(got, str) else [str(m) for m in got]


def output_dir(values: dict, default: str = "results/config_run") -> str:
    return str(values.get("output_dir") or values.get("output") or default)


def drift_output_dir(values: dict) -> str:
    """synthetic_drift_output_dir, else the output folder's name with a suffix."""
    return str(values.get("synthetic_drift_output_dir") or f"{output_dir(values).rstrip('/')}_synthetic_drift")


def batch_dir(values: dict, path: str, batch: str, model: str, several: bool) -> str:
    """Where a run of a batch goes: an absolute configured folder, else a folder of the batch named like the file; a
    suffix tells several models apart. Addresses with a scheme are absolute."""
    base = output_dir(values, "")
    if not (base.startswith("/") or "://" in base):
        base = f"{batch.rstrip('/')}/{Path(path).stem}"
    return f"{base}__{model}" if several else base


def write_result(result: Result, folder: str) -> list[str]:
    """Each table that is there as Parquet under its name."""
    written = []
    for f in dataclasses.fields(Result):
        df = getattr(result, f.name)
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{f.name}")
            written.append(f.name)
    return written


def write_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return list(tables)


def completed(spark: SparkSession, folder: str, methods: tuple[str, ...]) -> tuple[str, int] | None:
    """(dataset, rows) of a folder that holds a whole result, else None. Tables that end in an unreadable state don't count."""
    needed = ["window_scores", "correlations", "thresholds", "dataset_summary"]
    needed += ["psi_diagnostics"] if any(m.endswith("_psi") for m in methods) else []
    try:
        found = {name: spark.read.parquet(f"{folder}/{name}") for name in needed}
    except AnalysisException:
        return None
    one = found["dataset_summary"].first()
    return (one["dataset"], one["n_rows"]) if one else None


def read_results(spark: SparkSession, folders: list[str], name: str) -> DataFrame | None:
    """One table of several results, with result_dir; None if no folder has it."""
    out = None
    for folder in folders:
        try:
            df = spark.read.parquet(f"{folder}/{name}").withColumn("result_dir", F.lit(folder))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
