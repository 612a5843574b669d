"""Thresholds, triggers and retraining policies over small tables of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import finite


def thresholds(scores: DataFrame, q: float = 0.95) -> DataFrame:
    """(method, threshold): a quantile of each method's finite scores; methods without any are left out."""
    if not 0 < q < 1:
        raise ValueError("the quantile must lie between 0 and 1")
    return scores.select("method", finite("score").alias("score")).where("score is not null").groupBy("method").agg(F.percentile("score", q).alias("threshold"))


def triggered(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Add threshold and triggered; without a threshold or a finite score nothing triggers."""
    return scores.join(F.broadcast(limits), "method", "left").withColumn("triggered", F.coalesce(finite("score") >= F.col("threshold"), F.lit(False)))


def periodic(window: Column, period: int) -> Column:
    return (window + 1) % period == 0


def trigger_matrix(scores: DataFrame, quality: DataFrame, periods: tuple[int, ...] = (4,), least_drop: float = 0.02) -> DataFrame:
    """(policy, window_index, trigger) of all policies.

    scores: (window_index, method, triggered); quality: (window_index, quality_drop). A method becomes a policy only if
    it has a row for every window.
    """
    w = F.col("window_index")
    row = lambda name, cond: quality.select(F.lit(name).alias("policy"), w, F.coalesce(cond, F.lit(False)).alias("trigger"))
    out = row("no_retraining", F.lit(False))
    for p in periods:
        out = out.unionByName(row(f"periodic_p{p}", periodic(w, p)))
    n = quality.select("window_index").distinct().agg(F.count(F.lit(1)).alias("n"))
    full = scores.join(F.broadcast(quality.select("window_index").distinct()), "window_index", "left_semi").groupBy("method").agg(F.count_distinct("window_index").alias("k")).join(F.broadcast(n)).where("k = n").select("method")
    by_method = scores.join(F.broadcast(full), "method", "left_semi").select(F.concat("method", F.lit("_trigger")).alias("policy"), w, F.col("triggered").alias("trigger"))
    out = out.unionByName(by_method)
    out = out.unionByName(row("oracle_drop", F.col("quality_drop") >= least_drop))
    return out.unionByName(row("oracle_every_window", F.lit(True)))


def retrain_schedule(triggers: DataFrame) -> DataFrame:
    """Add n_retrains (triggers before the window: a window is scored before it can retrain) and trained_after, the last
    window whose trigger came before (null: the first model)."""
    before = Window.partitionBy("policy").orderBy("window_index").rowsBetween(Window.unboundedPreceding, -1)
    return triggers.withColumns({"n_retrains": F.coalesce(F.sum(F.col("trigger").cast("long")).over(before), F.lit(0)), "trained_after": F.max(F.when(F.col("trigger"), F.col("window_index"))).over(before)})


def distinct_schedules(triggers: DataFrame) -> DataFrame:
    """(policy, schedule): policies with equal trigger vectors share a schedule, named by the smallest of them."""
    vector = triggers.groupBy("policy").agg(F.array_sort(F.collect_list(F.struct("window_index", "trigger"))).alias("v"))  # one row a window
    return vector.withColumn("schedule", F.min("policy").over(Window.partitionBy("v"))).select("policy", "schedule")


def oracle_series(observed: DataFrame, lower_better: bool, policy: str = "oracle_every_window", history: str = "all") -> DataFrame:
    """(window_index, oracle): quality of retraining every window, or the best observed where that is incomplete."""
    best = observed.groupBy("window_index").agg((F.min if lower_better else F.max)("quality").alias("best"), F.max(F.when((F.col("policy") == policy) & (F.col("history_mode") == history), F.col("quality"))).alias("own"))
    whole = F.count("own").over(Window.partitionBy()) == F.count(F.lit(1)).over(Window.partitionBy())  # one row a window
    return best.select("window_index", F.when(whole, F.col("own")).otherwise(F.col("best")).alias("oracle"))


def policy_summary(observed: DataFrame, base: DataFrame, lower_better: bool, least_drop: float = 0.02) -> DataFrame:
    """One row a policy and history: quality, retrains, gain, regret and false retrains, smallest regret first.

    observed: (policy, history_mode, window_index, quality, trigger); base: (window_index, quality_drop) of the first model.
    """
    sign = -1 if lower_better else 1
    none = observed.where(F.col("policy") == "no_retraining").select("history_mode", "window_index", F.col("quality").alias("q0"))
    rows = observed.join(none, ["history_mode", "window_index"], "left").join(F.broadcast(oracle_series(observed, lower_better)), "window_index", "left").join(F.broadcast(base), "window_index", "left")
    gain, regret = sign * (F.col("quality") - F.col("q0")), sign * (F.col("oracle") - F.col("quality"))
    retrains = F.sum(F.col("trigger").cast("long"))
    false = F.sum((F.col("trigger") & (F.col("quality_drop") < least_drop)).cast("long"))
    out = rows.groupBy("policy", "history_mode").agg(
        F.avg("quality").alias("mean_quality"), (F.max if lower_better else F.min)("quality").alias("worst_window_quality"), retrains.alias("n_retrains"), F.avg(gain).alias("mean_quality_gain"), F.sum(F.greatest(regret, F.lit(0.0))).alias("cumulative_regret"), F.coalesce(false, F.lit(0)).alias("false_retrains")
    )
    n = F.greatest(F.col("n_retrains"), F.lit(1))
    return out.withColumns({"quality_gain_per_retrain": F.col("mean_quality_gain") / n, "false_retrain_share": F.col("false_retrains") / n}).orderBy("cumulative_regret", "policy")


def history(rows: DataFrame, trained_after: int | None, mode: str = "all", rolling: int = 4) -> DataFrame:
    """Training rows of the model fitted after a test window: all rows so far, or the last test windows alone."""
    w, test = F.col("window_index"), F.col("split") == "test"
    if trained_after is None:
        return rows.where(F.col("split") == "train")
    if mode == "all":
        return rows.where((F.col("split") == "train") | test & (w <= trained_after))
    return rows.where(test & (w <= trained_after) & (w > trained_after - rolling))
