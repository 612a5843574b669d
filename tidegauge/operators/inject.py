"""Controlled drift for evaluation: changed copies of windows and detection summaries."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import MISSING
from .quantiles import exact_quantiles

#: Scenario names.
SCENARIOS = ("mean_shift", "variance_shift", "correlation_shift", "categorical_prior_shift", "missingness_shift", "local_subpopulation_shift", "concept_like_shift", "mixed_shift")


def injection_stats(train: DataFrame, numeric: list[str]) -> dict[str, tuple[float, float, float]]:
    """Mean, sample deviation (1 where it is 0 or unknown) and median of each column."""
    if not numeric:
        return {}
    got = train.agg(*(f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("a", F.avg), ("s", F.stddev)))).first()
    long = train.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in numeric))).alias("at", "value"))
    half = {numeric[r["at"]]: r["q"][0] for r in exact_quantiles(long, ["at"], "value", [0.5]).collect()}  # one number a column
    return {c: (got[f"a_{c}"], got[f"s_{c}"] or 1.0, half.get(c)) for c in numeric}


def category_shares(train: DataFrame, column: str) -> list[tuple[str, float]]:
    """Values with their shares, missing included, most frequent first."""
    v = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    rows = train.groupBy(v.alias("v")).count().orderBy(F.desc("count"), "v").collect()  # a low-cardinality column
    n = sum(r["count"] for r in rows)
    return [(r["v"], r["count"] / n) for r in rows]


def chosen(columns: list[str], share: float, rng: np.random.Generator) -> list[str]:
    if not columns:
        return []
    k = min(len(columns), max(1, math.ceil(share * len(columns))))
    return [columns[i] for i in sorted(rng.choice(len(columns), size=k, replace=False))]


def mean_shift(rows: DataFrame, columns: list[str], stats: dict, delta: float = 0.75, where: Column | None = None) -> DataFrame:
    new = {c: F.col(c) + F.lit(delta * stats[c][1]) for c in columns}
    return rows.withColumns({c: x if where is None else F.when(where, x).otherwise(F.col(c)) for c, x in new.items()})


def variance_shift(rows: DataFrame, columns: list[str], stats: dict, scale: float = 1.5) -> DataFrame:
    return rows.withColumns({c: F.lit(stats[c][0]) + scale * (F.col(c) - F.lit(stats[c][0])) for c in columns})


def correlation_shift(rows: DataFrame, columns: list[str], stats: dict, degrees: float = 40.0) -> DataFrame:
    """Rotate neighbouring pairs of standardised columns; a missing value makes both of its pair missing."""
    c, s, new = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), {}
    for a, b in zip(columns[::2], columns[1::2]):
        za, zb = ((F.col(x) - F.lit(stats[x][0])) / F.lit(stats[x][1]) for x in (a, b))
        new[a] = F.lit(stats[a][0]) + F.lit(stats[a][1]) * (za * c + zb * s)
        new[b] = F.lit(stats[b][0]) + F.lit(stats[b][1]) * (zb * c - za * s)
    return rows.withColumns(new) if new else rows


def prior_shift(rows: DataFrame, column: str, shares: list[tuple[str, float]], seed: int, reverse: bool = False) -> DataFrame:
    """Draw the column anew from the training shares; with ``reverse`` the rarest value gets the largest share."""
    values = [v for v, _ in shares]
    probs = [p for _, p in (reversed(shares) if reverse else shares)]
    u, out, upto = F.rand(seed), F.lit(values[-1]), 1.0
    for v, p in reversed(list(zip(values[:-1], probs[:-1]))):
        upto = sum(q for x, q in zip(values, probs) if values.index(x) <= values.index(v))
        out = F.when(F.col("__u") < upto, v).otherwise(out)
    return rows.withColumn("__u", u).withColumn(column, out).drop("__u")


def missingness(rows: DataFrame, columns: list[str], rate: float, seed: int, where: Column | None = None) -> DataFrame:
    hit = lambda i: (F.rand(seed + i) < rate) if where is None else where & (F.rand(seed + i) < rate)
    return rows.withColumns({c: F.when(hit(i), F.lit(None)).otherwise(F.col(c)) for i, c in enumerate(columns)})


def local_rows(rows: DataFrame, column: str | Column, median: float, share: float, seed: int, key: str = "window_index") -> DataFrame:
    """Add __local: a share of each window's rows, at least one, drawn from those at or above the median, or from all rows where fewer than the share are."""
    value = F.col(column) if isinstance(column, str) else column
    inside = F.coalesce(value >= F.lit(median), F.lit(False))
    w = Window.partitionBy(key)
    rows = rows.withColumn("__u", F.rand(seed)).withColumn("__in", inside)
    rows = rows.withColumn("__any", F.sum(F.col("__in").cast("long")).over(w)).withColumn("__n", F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) * share)))
    eligible = F.col("__in") | (F.col("__any") < F.col("__n"))
    rank = F.row_number().over(w.orderBy(F.when(eligible, 0).otherwise(1), "__u"))
    return rows.withColumn("__local", eligible & (rank <= F.col("__n"))).drop("__u", "__in", "__any", "__n")


def inject(rows: DataFrame, scenario: str, numeric: list[str], categorical: list[str], stats: dict, shares: dict, start: int, seed: int = 42, numeric_share: float = 0.3, categorical_share: float = 0.5, delta: float = 0.75, scale: float = 1.5, degrees: float = 40.0, missing: float = 0.2, local: float = 0.25) -> DataFrame:
    """Rows with the scenario applied to windows from ``start`` on; columns are drawn numeric first, then categorical."""
    rng = np.random.default_rng(seed)
    num, cat = chosen(numeric, numeric_share, rng), chosen(categorical, categorical_share, rng)
    late, early = rows.where(F.col("window_index") >= start), rows.where(F.col("window_index") < start)
    prior = lambda df: reduce(lambda d, c: prior_shift(d, c, shares[c], seed + sum(map(ord, c))), cat, df)
    if scenario == "mean_shift":
        late = mean_shift(late, num, stats, delta)
    elif scenario == "variance_shift":
        late = variance_shift(late, num, stats, scale)
    elif scenario == "correlation_shift":
        late = correlation_shift(late, num, stats, degrees)  # needs two columns
    elif scenario == "categorical_prior_shift":
        late = prior(late)
    elif scenario == "missingness_shift":
        late = missingness(late, num + cat, missing, seed)
    elif scenario == "local_subpopulation_shift":
        at, median = (F.col(num[0]), stats[num[0]][2]) if num else (F.lit(0.0), 0.0)
        late = local_rows(late, at, median, local, seed)
        late = missingness(mean_shift(late, num, stats, delta, F.col("__local")), cat, missing, seed, F.col("__local")).drop("__local")
    elif scenario == "mixed_shift":
        late = missingness(prior(variance_shift(mean_shift(late, num, stats, delta / 2), num, stats, 1 + (scale - 1) / 2)), num + cat, missing / 2, seed)
    elif scenario != "concept_like_shift":
        raise ValueError(f"unknown scenario: {scenario}")
    return early.unionByName(late.select(*early.columns))


def detection_summary(scores: DataFrame, start: int, keys: list[str]) -> DataFrame:
    """AUROC and AUPRC of the score against "drifted", delay of the first trigger and false alarm rate before the start."""
    from .quality import classification_metrics

    rows = scores.withColumn("label", (F.col("window_index") >= start).cast("int"))
    curves = classification_metrics(rows, keys).select(*keys, F.col("roc_auc").alias("auroc"), F.col("pr_auc").alias("auprc"))
    w = F.col("window_index")
    out = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("triggered") & (w >= start), w - start)).alias("detection_delay_windows"), F.avg(F.when(w < start, F.col("triggered").cast("double"))).alias("false_alarm_rate"), F.count(F.lit(1)).alias("n_windows"), F.sum("label").alias("n_drift_windows")
    )
    return out.join(curves, keys)
