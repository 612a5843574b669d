"""Rank statistics over small tables, by group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(keys: list[str], value: str) -> Column:
    """Rank from 1; ties share their mean."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation, null where a side is constant or there are fewer than three rows."""
    ok = (F.count(F.lit(1)) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    spread = (F.sum(F.col(x) * F.col(x)) - sx * sx / n) * (F.sum(F.col(y) * F.col(y)) - sy * sy / n)
    return F.when(ok, cov / F.sqrt(F.when(spread > 0, spread)))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumn("__rx", average_rank(keys, x)).withColumn("__ry", average_rank(keys, y))
    return ranked.groupBy(*keys).agg(safe_corr("__rx", "__ry").alias(name), F.count(F.lit(1)).alias("n_windows"))


def lagged_spearman(rows: DataFrame, keys: list[str], order: str, x: str, y: str, lag: int) -> DataFrame:
    """x now against y ``lag`` rows later, after rows without either value are gone."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    later = rows.withColumn("__y", F.lead(y, lag).over(Window.partitionBy(*keys).orderBy(order)))
    out = spearman(later, keys, x, "__y", f"spearman_lag{lag}")
    return rows.select(*keys).distinct().join(out.drop("n_windows"), keys, "left")


def inversions(y: np.ndarray, few: int = 64) -> int:
    """Pairs i < j with y[i] > y[j], by merging halves."""
    if len(y) <= few:
        return int(np.triu(y[:, None] > y[None, :], 1).sum())
    half = len(y) // 2
    left, right = np.sort(y[:half]), y[half:]
    return inversions(y[:half], few) + inversions(right, few) + int((half - np.searchsorted(left, right, "right")).sum())


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float | None:
    """tau-b in n log n steps; None below three pairs or where a side is constant."""
    n = len(x)
    tied = lambda *columns: int(sum(c * (c - 1) // 2 for c in np.unique(np.column_stack(columns), axis=0, return_counts=True)[1]))
    pairs = n * (n - 1) // 2
    if pairs < 3:
        return None
    tx, ty, both = tied(x), tied(y), tied(x, y)
    if tx == pairs or ty == pairs:
        return None
    order = np.lexsort((y, x))
    return float((pairs - tx - ty + both - 2 * inversions(y[order])) / np.sqrt(float(pairs - tx) * float(pairs - ty)))


def kendall(rows: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """tau-b by group, of one row a window; unknown below three rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tau = kendall_tau(pdf["__x"].to_numpy(float), pdf["__y"].to_numpy(float))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "kendall_tau": [np.nan if tau is None else tau]}).astype({"kendall_tau": float})

    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "kendall_tau double"])
    out = rows.groupBy(*keys).applyInPandas(one, schema)
    return out.withColumn("kendall_tau", F.when(~F.isnan("kendall_tau"), F.col("kendall_tau")))


def bootstrap_spearman(rows: DataFrame, keys: list[str], order: str, x: str, y: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """Percentile interval (2.5, 97.5) of the rank correlation over resampled windows; numpy per small group."""

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rng, out = np.random.default_rng(seed), []
        for _ in range(draws if len(pdf) >= 3 else 0):
            at = rng.integers(0, len(pdf), len(pdf))
            r = pdf[[x, y]].iloc[at].rank().to_numpy()
            if (r.std(axis=0) > 0).all():
                out.append(np.corrcoef(r.T)[0, 1])
        low, high = np.quantile(out, [0.025, 0.975]) if out else (None, None)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ci_low": [low], "ci_high": [high]})

    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "ci_low double", "ci_high double"])
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).applyInPandas(interval, schema)


def correlation_table(rows: DataFrame, key: str = "method", order: str = "window_index", x: str = "score", y: str = "quality_drop", lags: tuple[int, ...] = (1, 2), draws: int = 0, seed: int = 42) -> DataFrame:
    """Spearman, Kendall and lagged Spearman by method, largest first, unknown last; with ``draws`` the bootstrap interval too.

    Windows whose score or quality is unknown or not finite don't count.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.withColumns({c: F.when(finite(c), F.col(c)) for c in (x, y)})
    out = spearman(rows, [key], x, y).join(kendall(rows, [key], order, x, y), key, "left")
    for lag in lags:
        out = out.join(lagged_spearman(rows, [key], order, x, y, lag), key, "left")
    if draws:
        ends = bootstrap_spearman(rows, [key], order, x, y, draws, seed).withColumnsRenamed({"ci_low": "spearman_ci_low", "ci_high": "spearman_ci_high"})
        out = out.join(ends, key, "left")
    return out.orderBy(F.desc_nulls_last("spearman"), key)


def benjamini_hochberg(rows: DataFrame, p: str = "p_value", keys: list[str] | None = None, level: float = 0.05) -> DataFrame:
    """Add p_adjusted (step-up, at most 1) and rejected."""
    keys = keys or []
    up = Window.partitionBy(*keys).orderBy(p)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    step = rows.withColumn("__i", F.row_number().over(up)).withColumn("__q", F.col(p) * n / F.col("__i"))
    upward = Window.partitionBy(*keys).orderBy("__i").rowsBetween(0, Window.unboundedFollowing)
    adjusted = F.least(F.min("__q").over(upward), F.lit(1.0))
    return step.withColumn("p_adjusted", adjusted).withColumn("rejected", F.col("p_adjusted") <= level).drop("__i", "__q")


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def signed_rank_p(ranks: list[float], positive: float) -> float:
    """Two-sided p of the signed-rank sum: exact for up to 50 untied ranks, else normal with tie correction."""
    n = len(ranks)
    if n == 0:
        return 1.0
    if n <= 50 and len(set(ranks)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        low = min(positive, n * (n + 1) / 2 - positive)
        return float(min(1.0, 2 * ways[: int(math.floor(low)) + 1].sum() / 2.0**n))
    _, ties = np.unique(ranks, return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return float(min(1.0, 2 * normal_sf(abs(positive - n * (n + 1) / 4) / math.sqrt(var)))) if var > 0 else 1.0


def wilcoxon(rows: DataFrame, reference: str, method: str = "method", pair: str = "pair", value: str = "value") -> DataFrame:
    """Signed-rank sums of every method against the reference over shared pairs, zero differences dropped, with p (unknown below three pairs)."""
    ref = rows.where(F.col(method) == reference).select(pair, F.col(value).alias("r"))
    d = rows.where(F.col(method) != reference).join(ref, pair).select(method, (F.col("r") - F.col(value)).alias("d")).where("d is not null")
    pairs = d.groupBy(method).agg(F.count(F.lit(1)).alias("pairs"))
    d = d.where("d <> 0")
    d = d.withColumn("a", F.abs("d"))
    ranked = d.withColumn("rank", average_rank([method], "a"))
    sums = ranked.groupBy(method).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("rank")).alias("ranks"))

    @F.pandas_udf("double")
    def p_value(ranks: pd.Series, plus: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(list(r), float(p)) for r, p in zip(ranks, plus)])

    sums = sums.join(pairs, method)
    return sums.select(method, "n", "w_plus", F.when(F.col("pairs") >= 3, p_value("ranks", "w_plus")).alias("p_value"))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution by series or continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def friedman(rows: DataFrame, method: str = "method", pair: str = "pair", value: str = "value") -> DataFrame:
    """Chi-square of ranks within pairs that have every method, tie-corrected; one row (statistic, n_pairs, n_methods).

    The statistic is null with fewer than two pairs or three methods. Repeated values of a pair are averaged first.
    """
    one = rows.groupBy(pair, method).agg(F.avg(value).alias("v")).where("v is not null")
    k = one.select(method).distinct().count()
    full = one.groupBy(pair).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == k).select(pair)
    ranked = one.join(full, pair).withColumn("rank", average_rank([pair], "v"))
    ties = ranked.groupBy(pair, "v").agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.col("t") ** 3 - F.col("t")), F.lit(0.0)).alias("ties"))
    sums = ranked.groupBy(method).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("r") ** 2).alias("rr"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    n, rr = F.col("n"), F.col("rr")
    stat = (12 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / F.nullif(1 - F.col("ties") / (n * (k**3 - k)), F.lit(0.0)) if k >= 3 else F.lit(None).cast("double")
    return sums.join(ties).select(F.when(n >= 2, stat).alias("statistic"), n.alias("n_pairs"), F.lit(k).alias("n_methods"))
