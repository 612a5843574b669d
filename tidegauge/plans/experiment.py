"""The temporal experiment: order, split, encode, score every window, calibrate, measure quality and retrain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.rankstats import correlation_table
from tidegauge.operators import distance, encode, ordering, policy, quality
from tidegauge.plans.report import dataset_summary
from tidegauge.plans.scoring import prepare, score_windows


@dataclass(frozen=True)
class Config:
    train: float = 0.6
    validation: float = 0.2
    window_size: int = 500
    least_window: int = 2
    window_mode: str = "count"  # or "time": windows are calendar periods of the first order column
    freq: str = "month"
    least_windows: int = 0  # test windows that a run needs
    reference: str = "train"
    recent_windows: int = 4
    representation: str = "raw"
    pca_components: int = 32
    model: str = "linear"
    methods: tuple[str, ...] = ("sliced", "mean_ks", "max_ks", "mean_psi", "max_psi", "mmd_rbf", "energy", "c2st")
    seed: int = 42
    max_onehot: int = 32
    buckets: int = 256
    threshold_quantile: float = 0.95
    psi_bins: int = 10
    ks_features: int | None = 2048  # features that a family of scores is drawn from; None: all
    psi_features: int | None = 2048
    max_pairs: int = 1000  # rows a side of MMD and transport
    energy_rows: int = 1000  # rows a side of the energy distance
    c2st_rows: int = 4000
    c2st_folds: int = 5
    periods: tuple[int, ...] = (4,)
    histories: tuple[str, ...] = ("all", "rolling")
    rolling_windows: int = 4
    least_drop: float = 0.02
    draws: int = 500  # of the bootstrap interval of a correlation
    retraining: bool = False


@dataclass
class Result:
    window_scores: DataFrame
    correlations: DataFrame
    thresholds: DataFrame
    dataset_summary: DataFrame
    psi_diagnostics: DataFrame | None
    retraining_windows: DataFrame | None = None
    retraining_summary: DataFrame | None = None


def split_and_windows(rows: DataFrame, order: list[str], config: Config, split: str | None = None) -> DataFrame:
    """Rows with split, rn, srn and window_index: split by fractions of the order, or by the column of names ``split``, in which case
    positions count within each part; windows of a number of rows or of a calendar period."""
    if split is None:
        data = ordering.fraction_split(ordering.with_ordinal(rows, *order), config.train, config.validation, 1 - config.train - config.validation)
    else:
        named = ordering.official_split(rows, split)
        parts, start = [], 0
        for name in ordering.SPLITS:
            part = ordering.with_ordinal(named.where(F.col("split") == name), *order)
            parts.append(part.withColumns({"srn": F.col("rn"), "rn": F.col("rn") + start}))
            start += parts[-1].count()
        data = distance.union_all(parts)
    if config.window_mode == "count":
        data = ordering.count_windows(data, config.window_size, config.least_window)
    elif config.window_mode in ("time", "calendar"):
        data = distance.union_all([ordering.calendar_windows(data.where(F.col("split") == s), order[0], config.freq, config.least_window).drop("period", "window_label") for s in ordering.SPLITS])
    else:
        raise ValueError(f"unknown window mode: {config.window_mode}")
    ordering.require_windows(data.where("split = 'test'"), config.least_windows)
    return data


def run(rows: DataFrame, order: list[str], features: list[str], target: str, task: str, config: Config = Config(), split: str | None = None, dataset: str = "") -> Result:
    """Score validation and test windows against the training rows and measure the model on each of them.

    ``split`` names the column of an official split; without it rows are split by fractions.
    """
    data = split_and_windows(rows, order, config, split)
    train = data.where("split = 'train'")
    enc = encode.Encoder.fit(train, encode.feature_types(train, features, config.max_onehot), config.buckets)
    name = "label" if task == "classification" else "actual"
    label, classes = quality.class_numbers(train, target) if task == "classification" else (F.col(target), 0)
    coded = ordering.settled(enc.transform(data.withColumn(name, label), ["split", "window_index", "srn", name]))
    fit_on = coded.where("split = 'train'")
    model = quality.fit_model(fit_on, config.model, task, config.seed, label=name)
    scored = ordering.settled(model(coded.where("split <> 'train'")))
    keys = ["split", "window_index"]
    metrics = quality.measured(scored, keys, task, classes)
    whole = scored.where("split = 'validation'").withColumn("all", F.lit(0))
    on_validation = quality.measured(whole, ["all"], task, classes).first().asDict()
    metric = quality.primary_metric(on_validation, task)
    reference_quality = on_validation[metric]
    space = coded
    if config.representation == "pca":
        space = ordering.settled(encode.pca(fit_on, config.pca_components)(coded))
    elif config.representation in ("model_output", "model_aware"):
        space = ordering.settled(model(coded).withColumn("features", F.array(F.col("score" if task == "classification" else "predicted"))))
    base = space.where("split = 'train'").select("srn", "features")
    ready = prepare(base, config.methods, config)
    # both splits in one plan: the windows of the test split come after those of the validation split
    first = space.where("split = 'validation'").agg(F.coalesce(F.max("window_index") + 1, F.lit(0))).first()[0]
    code = F.col("window_index") + F.when(F.col("split") == "test", first).otherwise(0)
    cur = space.where("split <> 'train'").withColumn("window_index", code).select("split", "window_index", "srn", "features")
    if config.reference == "recent":
        place = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2).cast("long") * (1 << 40) + F.col("srn")  # in time order over the splits
        near = ordering.recent_reference(space, config.recent_windows, "test").select((F.col("for_window") + first).alias("window_index"), place.alias("srn"), "features")
        near = ordering.settled(near)
        facts = [score_windows(ready, cur.where("split = 'validation'"), config.methods, config), score_windows(near, cur.where("split = 'test'"), config.methods, config)]
    else:
        facts = [score_windows(ready, cur, config.methods, config)]
    late = F.col("window_index") >= first
    scores = distance.union_all(facts).withColumns({"split": F.when(late, "test").otherwise("validation"), "window_index": F.col("window_index") - F.when(late, first).otherwise(0)})
    scores = ordering.settled(scores)
    limits = policy.thresholds(scores.where("split = 'validation'"), config.threshold_quantile)
    measured = metrics.select(*keys, F.col(metric).alias("quality"))
    sizes = ordering.window_table(coded.where("split <> 'train'"))
    fact = policy.triggered(scores, limits).join(measured, keys, "left").join(sizes, keys)
    drop = quality.quality_drop(metric, F.lit(reference_quality), F.col("quality"))
    fact = ordering.settled(fact.withColumns({"primary_metric": F.lit(metric), "reference_quality": F.lit(reference_quality), "quality_drop": drop, "reference_mode": F.lit(config.reference), "drift_representation": F.lit(config.representation), "model": F.lit(config.model), "dataset": F.lit(dataset)}).withColumnRenamed("split", "stream"))
    test = fact.where("stream = 'test'")
    diagnostics = None
    if any(distance.parse_method(m)[0] == "psi" for m in config.methods):
        counts, long = (ordering.sample_features(df, ready.dim, config.psi_features, config.seed) for df in (ready.counts, encode.value_counts(space.where("split = 'test'"), ["window_index"], "c")))
        diagnostics = distance.psi_diagnostics(distance.psi(counts, long, config.psi_bins, ready.edges))
    names = {"dataset": F.lit(dataset), "model": F.lit(config.model), "dataset_model": F.lit(f"{dataset}/{config.model}")}
    diagnostics = diagnostics and diagnostics.withColumns({k: names[k] for k in ("dataset", "model")})
    summary = dataset_summary(data, dataset, features, order[0]).withColumns({"task": F.lit(task), "model": F.lit(config.model)})
    result = Result(fact, correlation_table(test, draws=config.draws, seed=config.seed).withColumns(names), limits, summary, diagnostics)
    if config.retraining:
        result.retraining_windows, result.retraining_summary = (df.withColumns({k: names[k] for k in ("dataset", "model")}) for df in retrain(coded, test, task, name, metric, config, classes))
    return result


def retrain(coded: DataFrame, test: DataFrame, task: str, label: str, metric: str, config: Config, classes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Simulate the policies. A schedule says which model scores each window; every distinct model (history, last
    window seen, number of retrains) is fitted once and scores only the windows that need it."""
    base = ordering.settled(test.select("window_index", "quality_drop").dropDuplicates(["window_index"]))
    triggers = policy.trigger_matrix(test.select("window_index", "method", "triggered"), base, config.periods, config.least_drop)
    plan = ordering.settled(policy.retrain_schedule(triggers))
    measured = []
    for mode in config.histories:
        needs: dict[tuple, set[int]] = {}
        for r in plan.select("trained_after", "n_retrains", "window_index").distinct().collect():  # small: windows x policies
            needs.setdefault((r[0], r[1] if r[0] is not None else 0), set()).add(r[2])
        for (after, count), windows in sorted(needs.items(), key=lambda x: (x[0][0] is not None, x[0])):
            rows = policy.history(coded, after, mode, config.rolling_windows)
            model = quality.fit_model(rows, config.model, task, config.seed + count + (after is not None), label=label)
            scored = model(coded.where((F.col("split") == "test") & F.col("window_index").isin(sorted(windows))))
            got = quality.measured(scored, ["window_index"], task, classes)
            measured.append(got.select("window_index", F.col(metric).alias("quality"), F.lit(after).cast("long").alias("trained_after"), F.lit(count).cast("long").alias("n_retrains"), F.lit(mode).alias("history_mode")))
    quality_of = ordering.settled(distance.union_all(measured))
    same = plan["trained_after"].eqNullSafe(quality_of["trained_after"]) & (plan["n_retrains"] == quality_of["n_retrains"]) & (plan["window_index"] == quality_of["window_index"])
    windows = plan.join(F.broadcast(quality_of), same).select(plan["policy"], "history_mode", plan["window_index"], "quality", plan["trigger"], plan["n_retrains"])
    windows = ordering.settled(windows)
    return windows, policy.policy_summary(windows, base, metric in quality.LOWER_IS_BETTER, config.least_drop)
