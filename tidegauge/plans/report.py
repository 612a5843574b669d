"""Report tables from result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.rankstats import benjamini_hochberg, friedman, wilcoxon


def dataset_summary(rows: DataFrame, name: str, features: list[str], time: str, split: str = "split") -> DataFrame:
    """One row: counts by split, mean share of missing values, and the range of time."""
    missing = sum((F.avg(F.col(c).isNull().cast("double")) for c in features), F.lit(0.0)) / max(1, len(features))
    part = lambda s: F.count(F.when(F.col(split) == s, 1)).alias(f"n_{s}")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *(part(s) for s in ("train", "validation", "test")), missing.alias("missing_rate"), F.min(time).alias("time_min"), F.max(time).alias("time_max")).withColumns({"dataset": F.lit(name), "n_features": F.lit(len(features))})


def correlation_summary(correlations: DataFrame, reference: str, pair: str = "dataset_model") -> DataFrame:
    """Medians, mean rank, wins and signed-rank tests against a reference method."""
    rank = F.rank().over(Window.partitionBy(pair).orderBy(F.desc_nulls_last("spearman")))
    ranked = correlations.withColumn("rank", F.when(F.col("spearman").isNotNull(), rank))
    out = ranked.groupBy("method").agg(*(F.median(c).alias(f"median_{c}") for c in ("spearman", "spearman_ci_low", "spearman_ci_high")), F.avg("rank").alias("mean_rank"), F.count(F.when(F.col("rank") == 1, 1)).alias("wins"), F.count_distinct(pair).alias("n_pairs"))
    tests = benjamini_hochberg(wilcoxon(correlations, reference, "method", pair, "spearman")).select("method", "p_value", "p_adjusted", "rejected")
    return out.join(tests, "method", "left").orderBy(F.desc("median_spearman"), F.desc("wins"))


def tables(read: Callable[[str], DataFrame | None], reference: str = "sliced") -> dict[str, DataFrame]:
    """Every report table whose result tables are there; ``read`` gives a result table by name, or None."""
    made = {
        "downstream_quality": ("window_scores", lambda df: downstream_quality(df.where("stream = 'test'"), ["result_dir", "dataset", "model"])),
        "correlations": ("correlations", lambda df: df),
        "correlation_summary": ("correlations", lambda df: correlation_summary(df, reference)),
        "runtime_summary": ("window_scores", lambda df: runtime_summary(df, ["dataset", "model", "method"])),
        "friedman": ("correlations", lambda df: friedman(df, "method", "dataset_model", "spearman")),
        "psi_diagnostics_summary": ("psi_diagnostics", lambda df: psi_diagnostics_summary(df, ["dataset", "model"])),
        "retraining_summary": ("retraining_summary", retraining_summary),
        "drift_detection_summary": ("drift_summary", detection_summary),
        "ablation_summary": ("ablation_correlations", lambda df: ablation_summary(df, read("ablation_runtimes"))),
        "dataset_summary": ("dataset_summary", lambda df: df),
    }
    out = {}
    for name, (source, make) in made.items():
        df = read(source)
        if df is not None:
            out[name] = make(df)
    return out


def downstream_quality(windows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last window of each run."""
    one = windows.dropDuplicates([*keys, "window_index"])
    return one.groupBy(*keys).agg(F.min_by("quality", "window_index").alias("test_initial_window_quality"), F.max_by("quality", "window_index").alias("test_final_window_quality"), F.max_by("quality_drop", "window_index").alias("quality_drop_final"))


def detection_summary(summary: DataFrame) -> DataFrame:
    return summary.groupBy("method").agg(F.avg("auroc").alias("mean_auroc"), F.avg("auprc").alias("mean_auprc"), F.median("detection_delay_windows").alias("median_detection_delay"), F.avg("false_alarm_rate").alias("mean_false_alarm_rate"), F.count_distinct("scenario").alias("n_scenarios")).orderBy(F.desc("mean_auroc"), F.desc("mean_auprc"))


def retraining_summary(summary: DataFrame) -> DataFrame:
    return summary.groupBy("policy", "history_mode").agg(F.median("cumulative_regret").alias("median_regret"), F.avg("mean_quality").alias("mean_quality"), F.avg("worst_window_quality").alias("worst_window_quality"), F.avg("n_retrains").alias("mean_retrains"), F.avg("false_retrain_share").alias("false_retrain_share")).orderBy("median_regret")


def psi_diagnostics_summary(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    shares = [c for c in diagnostics.columns if c.endswith("_share")]
    return diagnostics.where("rank = 1").groupBy(*keys).agg(F.count_distinct("window_index").alias("windows"), F.max("psi").alias("max_top1_psi"), F.median("psi").alias("median_top1_psi"), *(F.avg(c).alias(f"mean_{c}") for c in shares))


def runtime_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    q = F.percentile("runtime_seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[1].alias("runtime_median"), (F.col("q")[2] - F.col("q")[0]).alias("runtime_iqr"))


def ablation_summary(correlations: DataFrame, runtimes: DataFrame | None = None) -> DataFrame:
    keys = ["ablation_type", "ablation_value", "method"]
    out = correlations.groupBy(*keys).agg(F.median("spearman").alias("median_spearman"), F.count_distinct("run_id").alias("n_runs"))
    if runtimes is not None:
        out = out.join(runtimes.groupBy(*keys).agg(F.median("runtime_median").alias("runtime_median"), F.median("runtime_iqr").alias("runtime_iqr")), keys, "left")
    return out.orderBy("ablation_type", F.desc("median_spearman"))
