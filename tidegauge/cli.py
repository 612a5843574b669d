"""Command line: run configurations and build reports."""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import logging
import os
import platform
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

import tidegauge
from tidegauge.plans import experiment, report, runs
from tidegauge.sources import config as conf
from tidegauge.sources import datasets

LOG = logging.getLogger("tidegauge")
MODELS = ("linear", "hist_gbdt", "gbdt", "lightgbm", "xgboost", "catboost")
TASKS = ("classification", "regression")
#: Bounds of the scores that a command may set over its configuration.
BOUNDS = ("ks_features", "psi_features", "psi_bins", "max_pairs", "energy_rows", "c2st_rows", "c2st_folds")


def setup_logging(level: str | None = None, file: str | None = None) -> None:
    """Level and file as given, else from TIDEGAUGE_LOG_LEVEL and TIDEGAUGE_LOG_FILE."""
    file = file or os.environ.get("TIDEGAUGE_LOG_FILE")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        handlers.append(logging.FileHandler(file))
    logging.basicConfig(level=level or os.environ.get("TIDEGAUGE_LOG_LEVEL", "INFO"), format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=handlers, force=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegauge")
    p.add_argument("--log-level")
    p.add_argument("--log-file")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, output: str | None = None, bounds: bool = False, run: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--output", default=output)
        if bounds:
            for b in BOUNDS:
                c.add_argument("--" + b.replace("_", "-"), type=int)
        if run:
            c.add_argument("--task", choices=TASKS)
            c.add_argument("--model", choices=MODELS, default="linear")
            c.add_argument("--methods", nargs="+", default=list(experiment.Config.methods))
            c.add_argument("--seed", type=int, default=42)
        return c

    for name, text in (("run", "run a configuration"), ("drift", "inject drift as a configuration says"), ("ablate", "vary a configuration")):
        command(name, text, bounds=True).add_argument("config")
    c = command("batch", "run configurations, each for all of its models", output="results/batch", bounds=True)
    c.add_argument("config", nargs="+")
    c.add_argument("--fail-fast", action="store_true", help="stop after the first failure")
    c.add_argument("--rerun-completed", action="store_true", help="run again what has whole results")
    c = command("run-synthetic", "run on generated rows", output="results/synthetic", bounds=True, run=True)
    c.add_argument("--n-samples", type=int, default=12_000)
    c.add_argument("--window-size", type=int, default=500)
    c = command("make-synthetic", "write generated rows as CSV", output="data/synthetic_temporal")
    c.add_argument("--n-samples", type=int, default=12_000)
    c.add_argument("--task", choices=TASKS, default="classification")
    c.add_argument("--seed", type=int, default=42)
    c = command("run-csv", "run on a CSV file", output="results/csv_run", bounds=True, run=True)
    for name in ("--path", "--target", "--time"):
        c.add_argument(name, required=True)
    c.add_argument("--name")
    c.add_argument("--split-col")
    c.add_argument("--window-size", type=int, default=1000)
    c = command("report", "build tables from results", output="results/report")
    c.add_argument("results", nargs="+")
    c.add_argument("--reference", default="sliced", help="the method that others are tested against")
    sub.add_parser("validate", help="look for missing array files").add_argument("folders", nargs="+")
    return p


def _bounded(config: experiment.Config, args: argparse.Namespace) -> experiment.Config:
    return dataclasses.replace(config, **{b: getattr(args, b) for b in BOUNDS if getattr(args, b, None) is not None})


def run_one(data: datasets.Dataset, config: experiment.Config, output: str) -> list[str]:
    result = experiment.run(data.frame, data.order, data.features, data.target, data.task, config, data.split, data.name)
    return conf.write_result(result, output)


def run_batch(spark: SparkSession, args: argparse.Namespace) -> None:
    """Every configuration with each of its models. Writes run_manifest, dataset_exclusions and environment_manifest."""
    jobs, methods = [], {}
    for path in args.config:
        facts = {"config_path": path}
        try:
            raw = Path(path).read_bytes()
            values = conf.load_yaml(path)
            names, config = conf.models(values), _bounded(conf.experiment_config(values.get("experiment", values)), args)
        except Exception as e:  # a configuration that can't be read is excluded like one that can't be run
            jobs.append((facts, lambda e=e: _raise(e)))
            continue
        facts["config_sha256"] = hashlib.sha256(raw).hexdigest()
        for model in names:
            folder = conf.batch_dir(values, path, args.output, model, len(names) > 1)
            methods[folder] = config.methods

            def job(values=values, config=dataclasses.replace(config, model=model), folder=folder) -> tuple[str, int]:
                data = datasets.load_spec(spark, values["dataset"])
                run_one(data, config, folder)
                return conf.completed(spark, folder, config.methods)

            jobs.append((facts | {"model": model, "output_dir": folder}, job))
    done = lambda f: None if args.rerun_completed or not f.get("output_dir") else conf.completed(spark, f["output_dir"], methods[f["output_dir"]])
    manifest = runs.run_batch(spark, jobs, done, args.fail_fast)
    environment = spark.createDataFrame([(tidegauge.__version__, platform.python_version(), spark.version, platform.platform())], "version string, python string, spark string, platform string")
    conf.write_tables({"run_manifest": manifest, "dataset_exclusions": manifest.where("status <> 'completed'"), "environment_manifest": environment}, args.output)


def _raise(e: Exception) -> None:
    raise e


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    setup_logging(args.log_level, args.log_file)
    if args.command == "validate":
        bad = {f: m for f in args.folders if (m := datasets.missing_files(f))}
        for f in args.folders:
            LOG.info("%s: %s", f, "missing " + ", ".join(bad[f]) if f in bad else "complete")
        return int(bool(bad))
    spark = SparkSession.builder.appName("tidegauge").getOrCreate()
    if args.command == "batch":
        run_batch(spark, args)
    elif args.command == "report":
        conf.write_tables(report.tables(lambda name: conf.read_results(spark, args.results, name), args.reference), args.output)
    elif args.command == "make-synthetic":
        data = datasets.generate(spark, args.n_samples, task=args.task, seed=args.seed)
        data.frame.write.mode("overwrite").option("header", "true").csv(args.output)
    elif args.command in ("run-synthetic", "run-csv"):
        config = experiment.Config(window_size=args.window_size, model=args.model, methods=tuple(args.methods), seed=args.seed, retraining=True)
        if args.command == "run-csv":
            data = datasets.load_csv(spark, args.path, args.target, args.time, args.task, args.name, args.split_col)
        else:
            data = datasets.generate(spark, args.n_samples, task=args.task or TASKS[0], seed=args.seed)
        LOG.info("wrote %s", run_one(data, _bounded(config, args), args.output))
    else:
        values = conf.load_yaml(args.config)
        data = datasets.load_spec(spark, values["dataset"])
        config = _bounded(conf.experiment_config(values.get("experiment", values)), args)
        if args.command == "run":
            LOG.info("wrote %s", run_one(data, config, args.output or conf.output_dir(values)))
        elif args.command == "ablate":
            made = runs.ablate(data.frame, data.order, data.features, data.target, data.task, config, conf.ablation_config(values), data.split, data.name)
            conf.write_tables(made, args.output or f"{conf.output_dir(values)}_ablation")
        else:
            config, drift = conf.drift_config(values)
            numeric = [c for c in data.features if isinstance(data.frame.schema[c].dataType, T.NumericType)]
            windows, summary = runs.injection_experiment(data.frame, data.order, numeric, [c for c in data.features if c not in numeric], _bounded(config, args), drift, data.split, data.name)
            conf.write_tables({"drift_windows": windows, "drift_summary": summary}, args.output or conf.drift_output_dir(values))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
