"""Many runs: ablations, drift injection experiments and batches of configurations."""

from __future__ import annotations

import dataclasses
import json
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import distance, encode, inject, ordering, policy
from tidegauge.plans import experiment
from tidegauge.plans.scoring import prepare
from tidegauge.plans.report import runtime_summary


@dataclasses.dataclass(frozen=True)
class Ablation:
    """Which settings are varied, and over which values."""

    projection_counts: tuple[int, ...] = (16, 32, 64, 128, 256)
    window_sizes: tuple[int, ...] = (500, 1000, 2000, 5000)
    threshold_quantiles: tuple[float, ...] = (0.9, 0.95, 0.975)
    reference_modes: tuple[str, ...] = ("train", "recent")
    representation_modes: tuple[str, ...] = ("raw", "pca", "model_output")
    run_projection_count: bool = True
    run_window_size: bool = True
    run_threshold: bool = True
    run_reference_mode: bool = True
    run_representation: bool = True

    def runs(self, base: experiment.Config) -> list[tuple[str, str, experiment.Config]]:
        """(type, value, configuration). One run scores all projection counts; only the threshold family retrains."""
        once = dataclasses.replace(base, retraining=False)
        out = []
        if self.run_projection_count:
            out.append(("projection_count", ",".join(map(str, self.projection_counts)), dataclasses.replace(once, methods=tuple(f"sliced_k{k}" for k in self.projection_counts))))
        if self.run_window_size:
            out += [("window_size", str(v), dataclasses.replace(once, window_size=v, least_windows=0)) for v in self.window_sizes]
        if self.run_threshold:
            out += [("threshold_quantile", str(v), dataclasses.replace(base, threshold_quantile=v, retraining=True)) for v in self.threshold_quantiles]
        if self.run_reference_mode:
            out += [("reference_mode", v, dataclasses.replace(once, reference=v)) for v in self.reference_modes]
        if self.run_representation:
            out += [("drift_representation", v, dataclasses.replace(once, representation=v)) for v in self.representation_modes]
        return out


def ablate(rows: DataFrame, order: list[str], features: list[str], target: str, task: str, base: experiment.Config, grid: Ablation = Ablation(), split: str | None = None, dataset: str = "") -> dict[str, DataFrame]:
    """Tables of all runs, each row with run_id, ablation_type and ablation_value: ablation_correlations, ablation_runtimes,
    ablation_retraining (if a run retrains) and ablation_runs, the configuration of each run."""
    tables: dict[str, list[DataFrame]] = {"ablation_correlations": [], "ablation_runtimes": [], "ablation_retraining": []}
    index = []
    for i, (kind, value, config) in enumerate(grid.runs(base)):
        got = experiment.run(rows, order, features, target, task, config, split, dataset)
        labels = {"run_id": F.lit(i), "ablation_type": F.lit(kind), "ablation_value": F.lit(value)}
        made = {"ablation_correlations": got.correlations, "ablation_runtimes": runtime_summary(got.window_scores, ["dataset", "model", "method"]), "ablation_retraining": got.retraining_summary}
        for name, df in made.items():
            if df is not None:
                tables[name].append(df.withColumns(labels))
        index.append((i, kind, value, dataset, json.dumps(dataclasses.asdict(config), sort_keys=True)))
    out = {name: distance.union_all(frames) for name, frames in tables.items() if frames}
    return out | {"ablation_runs": rows.sparkSession.createDataFrame(index, "run_id int, ablation_type string, ablation_value string, dataset string, config string")}


@dataclasses.dataclass(frozen=True)
class Drift:
    """Which scenarios are injected from which window on, and how strongly."""

    scenarios: tuple[str, ...] = inject.SCENARIOS
    start: int = 4
    numeric_share: float = 0.3
    categorical_share: float = 0.5
    delta: float = 0.75
    scale: float = 1.5
    degrees: float = 40.0
    missing: float = 0.2
    local: float = 0.25


def injection_experiment(rows: DataFrame, order: list[str], numeric: list[str], categorical: list[str], config: experiment.Config, drift: Drift = Drift(), split: str | None = None, dataset: str = "") -> tuple[DataFrame, DataFrame]:
    """(windows, summary): every scenario injected into the test windows from ``drift.start`` on, encoded and scored."""
    data = ordering.settled(experiment.split_and_windows(rows, order, config, split))
    train = data.where("split = 'train'")
    stats, shares = inject.injection_stats(train, numeric), {c: inject.category_shares(train, c) for c in categorical}
    enc = encode.Encoder.fit(train, encode.feature_types(train, numeric + categorical, config.max_onehot), config.buckets)
    code = lambda df: enc.transform(df, ["window_index", "srn"])
    base = ordering.settled(code(train).select("srn", "features"))
    base = prepare(base, config.methods, config)
    clean = experiment.score_windows(base, ordering.settled(code(data.where("split = 'validation'"))), config.methods, config)
    limits = ordering.settled(policy.thresholds(clean, config.threshold_quantile))
    strength = {f.name: getattr(drift, f.name) for f in dataclasses.fields(Drift) if f.name not in ("scenarios", "start")}
    out = []
    for i, name in enumerate(drift.scenarios):
        changed = inject.inject(data.where("split = 'test'"), name, numeric, categorical, stats, shares, drift.start, config.seed + 1009 * i, **strength)
        out.append(experiment.score_windows(base, ordering.settled(code(changed)), config.methods, config).withColumn("scenario", F.lit(name)))
    windows = ordering.settled(policy.triggered(distance.union_all(out), limits).withColumn("dataset", F.lit(dataset)))
    return windows, inject.detection_summary(windows, drift.start, ["dataset", "scenario", "method"])


#: Columns of a batch manifest.
MANIFEST = "config_path string, config_sha256 string, status string, dataset string, model string, output_dir string, n_samples bigint, reason string, traceback string"


def run_batch(spark: SparkSession, jobs: list[tuple[dict, Callable[[], tuple[str, int]]]], done: Callable[[dict], tuple[str, int] | None] = lambda _: None, fail_fast: bool = False) -> DataFrame:
    """The manifest of jobs run one after another: a row each, with the facts given for it, status, reason and traceback.

    A job returns its dataset's name and number of rows; ``done`` returns the same for a job that is complete already.
    A failed job is excluded with its reason; with ``fail_fast`` it is the last one.
    """
    rows = []
    for facts, job in jobs:
        row = {"config_sha256": "", "dataset": "", "model": "", "output_dir": "", "n_samples": None, "reason": "", "traceback": ""} | facts
        try:
            before = done(facts)
            row["dataset"], row["n_samples"] = before or job()
            row |= {"status": "completed", "reason": "already completed" if before else ""}
        except Exception as e:
            row |= {"status": "excluded", "reason": f"{type(e).__name__}: {e}"[:2000], "traceback": traceback.format_exc()[-4000:]}
        rows.append(row)
        if fail_fast and row["status"] == "excluded":
            break
    names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], MANIFEST)
