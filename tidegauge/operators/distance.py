"""Two-sample distances between a reference and every window, as grouped plans over long tables.

Reference rows: (feature_id, value); window rows: (window_index, feature_id, value). Higher is more drift. A reference with a column
window_index holds a sample of its own for every window, as rolling references do; without it all windows share it. Rows may also come as
counts of values: a reference with r, windows with c.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import block, matrix, parts, projected
from .ordering import drawn, running_total, sample_rows, settled
from .quantiles import between, exact_quantiles, wanted_ranks

EPS = 1e-6


def own_keys(reference: DataFrame) -> list[str]:
    """The columns by which a reference belongs to windows: window_index or none."""
    return [c for c in ("window_index",) if c in reference.columns]


def counted(reference: DataFrame) -> DataFrame:
    """(keys, feature_id, value, r): a reference of long rows as counts of its values. One that has r already stays as it is."""
    return reference if "r" in reference.columns else reference.groupBy(*own_keys(reference), "feature_id", "value").agg(F.count(F.lit(1)).alias("r"))


def hinted(df: DataFrame, by: list[str]) -> DataFrame:
    """df, which has a row a feature, with a broadcast hint unless it also has one for every window."""
    return df if by else F.broadcast(df)


# --- Kolmogorov-Smirnov ---------------------------------------------------------------------------------------------


def ks(reference: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_index, feature_id, ks). Both samples are counted by value first. Between two neighbouring values of the
    window its distribution is flat, so the largest gap is at one of them or just before: the reference is only looked
    up there, and a shared one is never repeated for each window."""
    by = own_keys(reference)
    ref = counted(reference)
    cur = windows if "c" in windows.columns else windows.groupBy("window_index", "feature_id", "value").agg(F.count(F.lit(1)).alias("c"))
    points = cur.select(*by, "feature_id", "value", F.lit(0).cast("long").alias("r")).distinct().unionByName(ref)
    points = points.groupBy(*by, "feature_id", "value").agg(F.sum("r").alias("r"))
    upto = running_total(points, [*by, "feature_id"], ["value"], "r", "upto")
    size = ref.groupBy(*by, "feature_id").agg(F.sum("r").alias("n_ref"))
    look = upto.join(hinted(size, by), [*by, "feature_id"]).select(*by, "feature_id", "value", (F.col("upto") / F.col("n_ref")).alias("f_ref"), ((F.col("upto") - F.col("r")) / F.col("n_ref")).alias("f_ref_before"))
    part = Window.partitionBy("window_index", "feature_id")
    own = cur.withColumn("n", F.sum("c").over(part)).withColumn("s", F.sum("c").over(part.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.greatest(F.abs(F.col("f_ref") - F.col("s") / F.col("n")), F.abs(F.col("f_ref_before") - (F.col("s") - F.col("c")) / F.col("n")))
    return own.join(look, [*by, "feature_id", "value"]).groupBy("window_index", "feature_id").agg(F.max(gap).alias("ks"))


# --- Population stability index ---------------------------------------------------------------------------------------


def quantile_grid(n: int) -> list[float]:
    return [float(q) for q in np.linspace(0, 1, n)]


def psi_edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """(keys, feature_id, edges, ref01, rlo, rhi, n_ref) of a reference: its distinct quantiles, whether all values are 0 or 1, range, size."""
    by, ref = [*own_keys(reference), "feature_id"], counted(reference)
    facts = ref.groupBy(*by).agg(F.bool_and(F.col("value").isin(0.0, 1.0)).alias("ref01"), F.min("value").alias("rlo"), F.max("value").alias("rhi"), F.sum("r").alias("n_ref"))
    return facts.join(exact_quantiles(ref, by, "value", quantile_grid(bins + 1), "edges", "r"), by).withColumn("edges", F.array_distinct("edges"))


def psi_bins(reference: DataFrame, windows: DataFrame, bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(window_index, feature_id, bin, expected, actual, n_ref, n_cur, n_bins): counts of both samples in every bin.

    Bins are the distinct quantiles of the reference, outer ones open; with fewer than three edges, 0/1 features have
    the bins 0 and 1, and others equal bins over the range of both samples (one bin if that is a point).
    """
    by, ref, each = own_keys(reference), counted(reference), F.col("c") if "c" in windows.columns else F.lit(1)
    edges = psi_edges(ref, bins) if edges is None else edges
    cur = windows.groupBy("window_index", "feature_id").agg(F.bool_and(F.col("value").isin(0.0, 1.0)).alias("cur01"), F.min("value").alias("clo"), F.max("value").alias("chi"), F.sum(each).alias("n_cur"))
    rule = cur.join(hinted(edges, by), [*by, "feature_id"])
    low, high = F.least("rlo", "clo"), F.greatest("rhi", "chi")
    step = (high - low) / bins
    linear = F.when(low == high, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: low + step * i))
    inner = F.when(F.size("edges") >= 3, F.slice("edges", 2, F.size("edges") - 2)).when(F.col("ref01") & F.col("cur01"), F.array(F.lit(0.5))).otherwise(linear)
    rule = rule.select("window_index", "feature_id", inner.alias("inner"), "n_ref", "n_cur", (F.size("edges") >= 3).alias("fixed"))
    bucket = F.size(F.filter("inner", lambda e: e <= F.col("value")))
    # windows x features grow with the data: no broadcast hint, Spark decides by size
    actual = windows.join(rule, ["window_index", "feature_id"]).groupBy("window_index", "feature_id", bucket.alias("bin")).agg(F.sum(each).alias("actual"))
    # reference counts depend on the bins alone: once for quantile bins, by window only where a fallback needs it
    shared = rule.where("fixed").select(*by, "feature_id", "inner").distinct()
    once = ref.join(hinted(shared, by), [*by, "feature_id"]).groupBy(*by, "feature_id", bucket.alias("bin")).agg(F.sum("r").alias("expected"))
    every = rule.where("fixed").select("window_index", "feature_id").join(once, [*by, "feature_id"])
    back = ref.join(rule.where("not fixed"), [*by, "feature_id"]).groupBy("window_index", "feature_id", bucket.alias("bin")).agg(F.sum("r").alias("expected"))
    expected = every.select("window_index", "feature_id", "bin", "expected").unionByName(back.select("window_index", "feature_id", "bin", "expected"))
    grid = rule.select("window_index", "feature_id", "n_ref", "n_cur", (F.size("inner") + 1).alias("n_bins"), F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    keys = ["window_index", "feature_id", "bin"]
    return grid.join(expected, keys, "left").join(actual, keys, "left").fillna(0, ["expected", "actual"])


def psi(reference: DataFrame, windows: DataFrame, bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(window_index, feature_id, psi, n_bins, zero_expected, zero_actual, clipped_expected, clipped_actual)."""
    e, a = F.col("expected") / F.col("n_ref"), F.col("actual") / F.col("n_cur")
    ce, ca = F.greatest(e, F.lit(EPS)), F.greatest(a, F.lit(EPS))
    count = lambda c: F.sum(c.cast("long"))
    return psi_bins(reference, windows, bins, edges).groupBy("window_index", "feature_id").agg(
        F.sum((ca - ce) * F.log(ca / ce)).alias("psi"), F.max("n_bins").alias("n_bins"), count(F.col("expected") == 0).alias("zero_expected"), count(F.col("actual") == 0).alias("zero_actual"), count(e < EPS).alias("clipped_expected"), count(a < EPS).alias("clipped_actual")
    )


def psi_summaries(per_feature: DataFrame, tops: tuple[int, ...] = (5,)) -> DataFrame:
    """mean, max, p95 and top-N means of the features' indices for every window."""
    best = F.sort_array(F.collect_list("psi"), asc=False)  # one value a feature
    mean = lambda n: F.aggregate(F.slice("all", 1, n), F.lit(0.0), lambda s, x: s + x) / F.least(F.size("all"), F.lit(n))
    out = per_feature.groupBy("window_index").agg(F.avg("psi").alias("mean_psi"), F.max("psi").alias("max_psi"), F.percentile("psi", 0.95).alias("p95_psi"), best.alias("all"))
    return out.select("window_index", "mean_psi", "max_psi", "p95_psi", *(mean(n).alias(f"top{n}_psi") for n in tops))


def psi_diagnostics(per_feature: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` features of each window with shares of empty and clipped bins, and the window's totals."""
    whole = Window.partitionBy("window_index")
    kinds = ("zero_expected", "zero_actual", "clipped_expected", "clipped_actual")
    total = {f"{k}_share": F.sum(k).over(whole) / F.sum("n_bins").over(whole) for k in kinds}
    rows = per_feature.withColumns(total | {"n_bins_total": F.sum("n_bins").over(whole), "n_features": F.count(F.lit(1)).over(whole), "rank": F.row_number().over(whole.orderBy(F.desc("psi"), "feature_id"))})
    return rows.where(F.col("rank") <= top).withColumnsRenamed({k: f"{k}_bins" for k in kinds})


# --- Sliced Wasserstein -----------------------------------------------------------------------------------------------


def quantiles(z: DataFrame, keys: list[str], grid: int, exact: bool = True) -> DataFrame:
    """(keys, q): quantiles of z at equal steps from 0 to 1."""
    if exact:
        return exact_quantiles(z, keys, "z", quantile_grid(grid))
    return z.groupBy(*keys).agg(F.percentile_approx("z", F.array(*map(F.lit, quantile_grid(grid))), F.lit(10_000)).alias("q"))


def sliced_details(reference: DataFrame, windows: DataFrame, grid: int = 512, exact: bool = True) -> DataFrame:
    """(window_index, proj_id, w2): squared quantile distance on every direction. The reference is reduced once."""
    ref = quantiles(reference, ["proj_id"], grid, exact).withColumnRenamed("q", "q_ref")
    both = quantiles(windows, ["window_index", "proj_id"], grid, exact).join(F.broadcast(ref), "proj_id")
    square = F.zip_with("q_ref", "q", lambda a, b: (a - b) * (a - b))
    return both.select("window_index", "proj_id", (F.aggregate(square, F.lit(0.0), lambda s, x: s + x) / grid).alias("w2"))


#: Rows of a window up to which one task projects and sorts it whole.
WHOLE = 200_000


#: Bins of all groups of a direction that a task counts at once.
BINS = 1 << 16


class Places:
    """np.searchsorted(edges, z, "left") for many values: a value's cell of a uniform grid says its place, but where several edges share that cell.
    Cells are rounded alike for values and edges and never fall, so this is exact."""

    def __init__(self, edges: np.ndarray, cells: int):
        self.edges, self.cells = edges, cells
        with np.errstate(all="ignore"):
            self.scale = cells / (edges[-1] - edges[0])
        self.plain = not np.isfinite(self.scale) or not 0 < self.scale
        if not self.plain:
            self.first = np.searchsorted(self.cell(edges), np.arange(cells + 2)).astype(np.int32)  # edges in the cells before

    def cell(self, z: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip((z - self.edges[0]) * self.scale, 0, self.cells).astype(np.int32)

    def __call__(self, z: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.searchsorted(self.edges, z, "left")
        cell = self.cell(z)
        at, own = self.first[cell], self.first[1:][cell]
        own -= at
        out = at + ((own > 0) & (z > self.edges[np.minimum(at, len(self.edges) - 1)]))
        many = np.flatnonzero(own > 1)
        out[many] = np.searchsorted(self.edges, z[many], "left")
        return out


#: Rows that are projected and counted at once.
AT_ONCE = 32_768


def direction_quantiles(rows: DataFrame, theta: np.ndarray, at: list[float], most: int = 20_000) -> np.ndarray:
    """Exact quantiles (at x directions) of finite rows with features on every direction. Tasks count projected values in bins by
    numpy; only bins that hold a wanted rank are cut again, until all of them hold few values, and those alone are sent."""
    sc, k = rows.sparkSession.sparkContext, theta.shape[1]
    cells = rows.select(F.col("features").alias("__x"))
    points = np.array(at, float)
    sent_theta = sc.broadcast(theta)

    def gathered(batches):
        """Blocks of projected values, each direction's in a row of memory."""
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(block(b.column("__x")))
                n += b.num_rows
            if n >= AT_ONCE:
                yield np.asfortranarray(np.concatenate(held) @ sent_theta.value)
                held, n = [], 0
        if held:
            yield np.asfortranarray(np.concatenate(held) @ sent_theta.value)

    def passed(make, merge, n_fields: int) -> list[tuple]:
        """make(blocks of projected values) by task, one binary a direction; merged by direction."""
        names = [f"f{i}" for i in range(n_fields)]
        schema = "d int, " + ", ".join(f"{c} binary" for c in names)

        def run(batches):
            own = make(gathered(batches))
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes() for v in one], pa.binary()) for one in own)], ["d", *names])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"d": pdf["d"].iloc[:1], **{c: [v] for c, v in zip(names, merge([[np.frombuffer(x) for x in pdf[c]] for c in names]))}})

        got = cells.mapInArrow(run, schema).groupBy("d").applyInPandas(add, schema).collect()  # bins that are looked at, for all directions
        return [tuple(np.frombuffer(r[c]) for c in names) for r in sorted(got, key=lambda r: r["d"])]

    def span(blocks):
        n, lo, hi = 0, np.full(k, np.inf), np.full(k, -np.inf)
        for z in blocks:
            n, lo, hi = n + len(z), np.minimum(lo, z.min(axis=0)), np.maximum(hi, z.max(axis=0))
        return [[np.array([float(n)])] * k, lo[:, None], hi[:, None]] if n else None

    facts = passed(span, lambda f: (sum(f[0]).tobytes(), np.min(f[1], axis=0).tobytes(), np.max(f[2], axis=0).tobytes()), 3)
    if not facts:
        raise ValueError("a reference without rows")
    n = int(facts[0][0][0])
    ranks = wanted_ranks(points, n)
    # of every direction: the edges of disjoint intervals [lo, hi] that hold the open ranks, and how many values lie before each
    lows, highs, starts = [np.array([f[1][0]]) for f in facts], [np.array([f[2][0]]) for f in facts], [np.array([0]) for _ in facts]
    held = [np.array([n]) for _ in facts]
    while any(h.sum() > most for h in held) and all((h > lo).any() for lo, h in zip(lows, highs)):
        edges = [np.unique(np.concatenate([np.linspace(a, b, max(2, BINS // len(lo)) + 1) for a, b in zip(lo, hi)])) for lo, hi in zip(lows, highs)]
        sent = sc.broadcast(edges)

        def count(blocks):
            own, total = None, []
            for z in blocks:
                if own is None:
                    own = [Places(e, 2 * BINS) for e in sent.value]
                    total = [np.zeros(len(e) + 1, np.int64) for e in sent.value]
                # bins (edges[i - 1], edges[i]]; the first holds what is not above the least edge
                for j, places in enumerate(own):
                    total[j] += np.bincount(places(z[:, j]), minlength=len(total[j]))
            return None if own is None else [[c.astype(float) for c in total]]

        before = sum(h.sum() for h in held)
        for j, (c,) in enumerate(passed(count, lambda f: (sum(f[0]).tobytes(),), 1)):
            upto = np.cumsum(c.astype(np.int64))
            hit = np.unique(np.searchsorted(upto, ranks, "right"))
            e = edges[j]
            lows[j] = np.where(hit > 0, e[np.maximum(hit - 1, 0)], -np.inf)
            highs[j] = e[np.minimum(hit, len(e) - 1)]
            starts[j], held[j] = upto[hit] - c[hit].astype(np.int64), c[hit].astype(np.int64)
            point = hit == 0  # the least value itself
            lows[j] = np.where(point, np.nextafter(highs[j], -np.inf), lows[j])
        if sum(h.sum() for h in held) >= before:
            break
    sent_bounds = sc.broadcast((lows, highs))

    def values(blocks):
        """Distinct values of the intervals (low, high], with their numbers."""
        lo, hi = sent_bounds.value
        found: list[list[np.ndarray]] = [[] for _ in range(k)]
        places = [Places(h, BINS >> 2) for h in hi]
        for z in blocks:
            for j in range(k):
                i = places[j](z[:, j])
                inside = (i < len(hi[j])) & (z[:, j] >= lo[j][np.minimum(i, len(hi[j]) - 1)])
                found[j].append(z[inside, j])
        both = [np.unique(np.concatenate(f) if f else np.zeros(0), return_counts=True) for f in found]
        return [[v for v, _ in both], [c.astype(float) for _, c in both]]

    def joined(f):
        v, at = np.unique(np.concatenate(f[0]), return_inverse=True)
        return v.tobytes(), np.bincount(at, np.concatenate(f[1]), len(v)).astype(float).tobytes()

    out = np.zeros((len(at), k))
    for j, (v, c) in enumerate(passed(values, joined, 2)):
        got = np.zeros(len(ranks))
        for lo, hi, start, size in zip(lows[j], highs[j], starts[j], held[j]):
            mine = (v <= hi) & ((v > lo) if start else (v >= lo))
            own, upto = v[mine], start + np.cumsum(c[mine]).astype(np.int64)
            here = (ranks >= start) & (ranks < start + size)
            got[here] = own[np.searchsorted(upto, ranks[here], "right")]
        out[:, j] = between(points, n, ranks, got)
    return out


def sliced_reference(reference: DataFrame, theta: np.ndarray, grid: int = 512) -> np.ndarray:
    """Quantiles of a shared reference of rows with features on every direction: grid x directions."""
    return direction_quantiles(reference, theta, quantile_grid(grid))


def sliced_windows(reference: DataFrame | np.ndarray, windows: DataFrame, theta: np.ndarray, grid: int = 512) -> DataFrame:
    """(window_index, score) of windows of rows with features, whose quantiles are taken where the rows are: no projected value is
    shuffled. ``reference`` is the result of ``sliced_reference``, or rows with a window_index. Windows of more than WHOLE rows go
    through histograms."""
    at = quantile_grid(grid)
    schema = "window_index bigint, score double"

    def reduced(pdf: pd.DataFrame) -> np.ndarray:
        return np.quantile(matrix(pdf) @ theta, at, axis=0)

    def distance(a: np.ndarray, b: np.ndarray) -> float:
        return float(np.sqrt(((a - b) ** 2).mean()))

    cur = windows.select("window_index", "features")
    sizes = cur.groupBy("window_index").count()
    if not isinstance(reference, np.ndarray):
        ref = reference.select("window_index", "features")
        sizes = sizes.unionByName(ref.groupBy("window_index").count())
    large = settled(sizes.where(F.col("count") > WHOLE).select("window_index").distinct())
    some = not large.isEmpty()
    few = cur.join(large, "window_index", "left_anti") if some else cur
    if isinstance(reference, np.ndarray):
        sent = cur.sparkSession.sparkContext.broadcast(reference)
        one = lambda pdf: pd.DataFrame({"window_index": pdf["window_index"].iloc[:1], "score": [distance(sent.value, reduced(pdf))]})
        out = few.select("window_index", *parts(few)).groupBy("window_index").applyInPandas(one, schema)
        if not some:
            return out
        q_ref = cur.sparkSession.createDataFrame([(k, [float(v) for v in reference[:, k]]) for k in range(reference.shape[1])], "proj_id int, q_ref array<double>")
        both = quantiles(projected(cur.join(large, "window_index", "left_semi"), ["window_index"], theta), ["window_index", "proj_id"], grid).join(F.broadcast(q_ref), "proj_id")
    else:
        own = ref.join(large, "window_index", "left_anti") if some else ref

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            both = len(left) and len(right)
            return pd.DataFrame({"window_index": right["window_index"].iloc[:1], "score": [distance(reduced(left), reduced(right))]} if both else {"window_index": [], "score": []})

        left, right = (df.select("window_index", *parts(df)).groupBy("window_index") for df in (own, few))
        out = left.cogroup(right).applyInPandas(pair, schema)
        if not some:
            return out
        keys = ["window_index", "proj_id"]
        each = [quantiles(projected(df.join(large, "window_index", "left_semi"), ["window_index"], theta), keys, grid) for df in (ref, cur)]
        both = each[1].join(each[0].withColumnRenamed("q", "q_ref"), keys)
    w2 = F.aggregate(F.zip_with("q_ref", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / grid
    return out.unionByName(both.groupBy("window_index").agg(F.sqrt(F.avg(w2)).alias("score")))


def sliced_wasserstein(reference: DataFrame, windows: DataFrame, grid: int = 512, exact: bool = True) -> DataFrame:
    return sliced_details(reference, windows, grid, exact).groupBy("window_index").agg(F.sqrt(F.avg("w2")).alias("score"))


def sliced_subsamples(reference: DataFrame, windows: DataFrame, n_ref: int, sizes: dict[int, int], draws: int = 5, size: int | None = None, seed: int = 42, theta: np.ndarray | None = None) -> DataFrame:
    """(window_index, score): equal-size variant of every window. The reference has rows (rn, proj_id, z), windows have
    window_index as well and rn from 0 in each; sizes are their rows. With theta both have features instead of
    proj_id and z, and drawn rows alone are projected. One generator draws both sides, draw by draw; windows of
    equal size share their positions."""
    spark = reference.sparkSession
    picks: dict[str, list[tuple[int, int, int]]] = {"ref": [], "cur": []}
    for n_cur in sorted(set(sizes.values())):
        m = min(n_ref, n_cur, size or n_ref)
        if m < 2:
            raise ValueError("at least two rows on each side")
        rng = np.random.default_rng(seed)
        for d in range(draws):
            for side, n in (("ref", n_ref), ("cur", n_cur)):
                picks[side] += [(n_cur, d, int(i)) for i in rng.choice(n, size=m, replace=False)]
    at = {side: F.broadcast(spark.createDataFrame(p, "n bigint, draw int, rn bigint")) for side, p in picks.items()}
    of = F.broadcast(spark.createDataFrame([(int(w), int(n)) for w, n in sizes.items()], "window_index bigint, n bigint"))
    keys = ["n", "draw", "proj_id"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("z")).alias("rank")
    on = lambda rows, *keep: rows if theta is None else projected(rows, list(keep), theta)
    ref = on(reference.join(at["ref"], "rn"), "n", "draw").select(*keys, rank(*keys), F.col("z").alias("ref"))
    cur = on(windows.join(of, "window_index").join(at["cur"], ["n", "rn"]), "window_index", "n", "draw").select("window_index", *keys, rank("window_index", *keys), F.col("z").alias("cur"))
    both = cur.join(ref, [*keys, "rank"])
    per = both.groupBy("window_index", "draw", "proj_id").agg(F.avg((F.col("ref") - F.col("cur")) ** 2).alias("w2")).groupBy("window_index", "draw").agg(F.sqrt(F.avg("w2")).alias("s"))
    return per.groupBy("window_index").agg(F.avg("s").alias("score"))


def sliced_subsample(reference: DataFrame, current: DataFrame, n_ref: int, n_cur: int, draws: int = 5, size: int | None = None, seed: int = 42) -> float:
    """Equal-size variant for one pair of samples of (rn, proj_id, z)."""
    return sliced_subsamples(reference, current.withColumn("window_index", F.lit(0).cast("long")), n_ref, {0: n_cur}, draws, size, seed).first()["score"]


# --- Kernel and energy distances ----------------------------------------------------------------------------------------


#: Rows of a table made on the driver up to which it is broadcast.
BROADCAST = 1_000_000


def sampled(rows: DataFrame, sizes: dict, most: int, seed: int, key: str = "window_index", rn: str = "srn") -> DataFrame:
    """At most ``most`` rows of every window, by drawn positions within the window (column __at, from 0). Positions depend on a window's
    size alone, so they are drawn once for all windows of a size."""
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(rn)) - 1)
    large = sorted({n for n in sizes.values() if n > most})
    if not large:
        return rows
    make = lambda data, schema: (F.broadcast if len(data) <= BROADCAST else (lambda df: df))(rows.sparkSession.createDataFrame(data, schema))
    held = rows.join(make([(k, n) for k, n in sizes.items()], f"`{key}` bigint, __n bigint"), key)
    at = make([(n, int(i)) for n in large for i in drawn(n, most, seed)], "__n bigint, __at int")
    return held.where(F.col("__n") <= most).unionByName(held.where(F.col("__n") > most).join(at, ["__n", "__at"], "left_semi").select(*held.columns)).select(*rows.columns)


#: Rows a side that a task compares in pairs. Samples are drawn to a cap of 1000 by default.
MOST_PAIRED = 20_000


def by_window(reference: DataFrame, windows: DataFrame, value: Callable[[object, np.ndarray], float | None], known: Callable[[np.ndarray], object] = lambda x: x) -> DataFrame:
    """(window_index, score): value(known(x), y) of the samples of every window; known(x) of a shared reference is made once a task. Both are bounded
    samples of rows with features; a shared reference is sent to the tasks, and refused beyond MOST_PAIRED rows. Windows are spread over the tasks whatever their
    few bytes, since their work is in pairs."""
    schema = "window_index bigint, score double"
    cells = lambda df: [*parts(df), *(c for c in ("srn",) if c in df.columns)]
    ordered = lambda pdf: matrix(pdf.sort_values("srn") if "srn" in pdf else pdf)  # noqa: E731  folds go by place
    tasks = 4 * windows.sparkSession.sparkContext.defaultParallelism
    cur = windows.select("window_index", *cells(windows)).repartition(tasks, "window_index")
    result = lambda w, s: pd.DataFrame({"window_index": [w], "score": [np.nan if s is None else s]}).astype({"score": float})
    if own_keys(reference):

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"window_index": [], "score": []})
            return result(right["window_index"].iloc[0], value(known(ordered(left)), ordered(right)))

        out = reference.select("window_index", *cells(reference)).repartition(tasks, "window_index").groupBy("window_index").cogroup(cur.groupBy("window_index")).applyInPandas(pair, schema)
    else:
        rows = reference.select(*cells(reference)).limit(MOST_PAIRED + 1).toPandas()
        if len(rows) > MOST_PAIRED:
            raise ValueError(f"more than {MOST_PAIRED} rows in a sample for pairs")
        if not len(rows):
            return cur.sparkSession.createDataFrame([], schema)
        sent = cur.sparkSession.sparkContext.broadcast(ordered(rows))
        once: list = []  # a task's own

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            if not once:
                once.append(known(sent.value))
            return result(pdf["window_index"].iloc[0], value(once[0], ordered(pdf)))

        out = cur.groupBy("window_index").applyInPandas(one, schema)
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Square distances of all pairs, some rows at a time."""
    step = max(1, 2_000_000 // max(1, y.size))
    return np.concatenate([((x[i : i + step, None, :] - y[None, :, :]) ** 2).sum(axis=2) for i in range(0, len(x), step)])


def gram_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Square distances of all pairs by one matrix product. Where it cancels too much (distances far below the lengths), exactly."""
    mean = x.mean(axis=0)
    x, y = x - mean, y - mean
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = np.column_stack([x, xx, np.ones(len(x))]) @ np.column_stack([-2 * y, np.ones(len(y)), yy]).T
    i, j = np.nonzero(out <= 1e-6 * (xx.max(initial=0) + yy.max(initial=0)))  # few, of which fewer cancel
    some = out[i, j] <= 1e-6 * (xx[i] + yy[j])
    i, j = i[some], j[some]
    for at in range(0, len(i), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        out[a, b] = ((x[a] - y[b]) ** 2).sum(axis=1)
    return out


def energy(reference: DataFrame, windows: DataFrame) -> DataFrame:
    mean = lambda a, b: float(np.sqrt(gram_squares(a, b)).mean())

    def value(known: tuple[np.ndarray, float], y: np.ndarray) -> float:
        x, xx = known
        return float(np.sqrt(max(2 * mean(x, y) - xx - mean(y, y), 0.0)))

    return by_window(reference, windows, value, lambda x: (x, mean(x, x)))


def mmd(reference: DataFrame, windows: DataFrame, gamma: float | None = None) -> DataFrame:
    """Biased maximum mean discrepancy with a Gaussian kernel. Unless given, gamma is 1 / (2 * the median positive squared
    distance of all distinct pairs of both samples), by window; 1 without such a pair."""

    distinct = lambda x: gram_squares(x, x)[np.tri(len(x), k=-1, dtype=bool)]

    def value(known: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> float:
        x, xx = known
        xy, yy = gram_squares(x, y).ravel(), distinct(y)
        g = gamma
        if not g:
            pairs = np.concatenate([xy, xx, yy])
            pairs = pairs[pairs > 0]
            g = 1 / max(2 * float(np.median(pairs)), 1e-12) if len(pairs) else 1.0
        of = lambda d: float(np.exp(-g * d).sum())
        own = lambda d, n: (n + 2 * of(d)) / (n * n)  # noqa: E731  every row with itself, and distinct pairs in both orders
        return float(np.sqrt(max(own(xx, len(x)) + own(yy, len(y)) - 2 * of(xy) / (len(x) * len(y)), 0.0)))

    return by_window(reference, windows, value, lambda x: (x, distinct(x)))


#: Rows of a block of the pairs of whole samples, and most blocks of a partition of them (on average).
SIDE, HELD = 1000, 64


def row_blocks(rows: DataFrame, key: str | None = None) -> DataFrame:
    """(w, b, n, x): rows with srn and features as blocks of about SIDE rows, of a window each where ``key`` names one (else w is 0). They
    are dealt to so many partitions that every two partitions of two such tables make a task."""
    w = F.col(key).cast("long") if key else F.lit(0).cast("long")
    dealt = rows.select(w.alias("w"), F.floor(F.col("srn") / SIDE).cast("long").alias("b"), *parts(rows))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"w": pdf["w"].iloc[:1], "b": pdf["b"].iloc[:1], "n": [len(pdf)], "x": [matrix(pdf).tobytes()]})

    held = math.ceil(rows.count() / SIDE)
    tasks = max(math.ceil(math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism)), math.ceil(held / HELD))
    return settled(dealt.groupBy("w", "b").applyInPandas(one, "w bigint, b bigint, n bigint, x binary").repartition(max(1, min(held, tasks))))


def energy_whole(reference: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_index, score): the energy distance over all pairs of a shared reference and every window, of rows (srn, features). Pairs
    of blocks are made in the task that takes them, from a partition of either side: blocks are shuffled and kept, pairs never. The work is that of all
    pairs, quadratic in the reference; disk is linear."""
    ref, cur = row_blocks(reference), row_blocks(windows, "window_index")
    side = lambda df, i: df.select(*(F.col(c).alias(f"{c}{i}") for c in df.columns))
    jobs = [  # weight 2: pairs of different blocks count in both orders
        ("xx", side(ref, 1).crossJoin(side(ref, 2).hint("shuffle_replicate_nl")).where("b1 <= b2"), F.when(F.col("b1") < F.col("b2"), 2.0).otherwise(1.0)),
        ("xy", side(ref, 1).crossJoin(side(cur, 2).hint("shuffle_replicate_nl")), F.lit(1.0)),
        ("yy", side(cur, 1).join(side(cur, 2), F.expr("w1 = w2 and b1 <= b2")), F.when(F.col("b1") < F.col("b2"), 2.0).otherwise(1.0)),
    ]

    def total(batches):
        for pdf in batches:
            sums = []
            for n1, x1, n2, x2 in zip(pdf["n1"], pdf["x1"], pdf["n2"], pdf["x2"]):
                x, y = (np.frombuffer(v).reshape(n, -1) for n, v in ((n1, x1), (n2, x2)))
                squared = gram_squares(x, y)
                sums.append(float(np.sqrt(squared, out=squared).sum()))
            yield pd.DataFrame({"kind": pdf["kind"], "w": pdf["w2"], "s": np.array(sums) * pdf["weight"]})

    pairs = union_all([df.select(F.lit(k).alias("kind"), "n1", "x1", "w2", "n2", "x2", weight.alias("weight")) for k, df, weight in jobs])
    sums = pairs.mapInPandas(total, "kind string, w bigint, s double").groupBy("kind", "w").agg(F.sum("s").alias("s"))
    sums = settled(sums)
    n, sizes = ref.agg(F.sum("n").alias("n_ref")), cur.groupBy("w").agg(F.sum("n").alias("n_cur"))
    of = lambda k, c, *keys: sums.where(F.col("kind") == k).select(*keys, F.col("s").alias(c))
    both = sizes.join(of("xy", "xy", "w"), "w").join(of("yy", "yy", "w"), "w").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(of("xx", "xx")))
    a, b = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    value = 2 * F.col("xy") / (a * b) - F.col("xx") / (a * a) - F.col("yy") / (b * b)
    return both.select(F.col("w").alias("window_index"), F.sqrt(F.greatest(value, F.lit(0.0))).alias("score"))


# --- Classifier and transport ---------------------------------------------------------------------------------------------


def auc(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Exact rank AUC by group; null unless both classes occur. Ties share their average rank."""
    counts = scored.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(label).cast("long")).alias("p"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("r", upto - (F.col("c") - 1) / 2)
    got = ranks.groupBy(*keys).agg(F.sum(F.col("p") * F.col("r")).alias("s"), F.sum("p").alias("np"), F.sum(F.col("c") - F.col("p")).alias("nn"))
    return got.select(*keys, F.when((F.col("np") > 0) & (F.col("nn") > 0), (F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Newton steps for weighted logistic regression with an intercept (last) and half the squared length of the weights as penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.r_[np.ones(x.shape[1] - 1), 0.0]
    loss = lambda b: float(w @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ b)) + penalty @ (b * b) / 2)
    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        slope = x.T @ (w * (p - y)) + penalty * b
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-10))[:, None]).T @ x + np.diag(penalty + 1e-10), slope)
        size = 1.0
        while (then := loss(b - size * step)) > now and size > 1e-6:
            size /= 2
        if not then < now - 1e-12 * max(1.0, abs(now)):
            break
        b, now = b - size * step, then
    return b


def rank_auc(score: np.ndarray, y: np.ndarray) -> float | None:
    """Exact AUC; ties share their average rank; None unless both classes occur."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return None
    _, at, counts = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[at]
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def fold_aucs(x: np.ndarray, y: np.ndarray, folds: int, seed: int) -> float | None:
    """Mean AUC over stratified folds of a balanced logistic classifier telling the rows of x (0) from those of y (1)."""
    if min(len(x), len(y)) < 2:
        return None
    k = max(2, min(folds, len(x), len(y)))
    rng = np.random.default_rng(seed)
    both, label = np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)])
    fold = np.concatenate([rng.permutation(np.arange(n) % k) for n in (len(x), len(y))])
    weight = len(both) / (2.0 * np.where(label == 0, len(x), len(y)))
    scores = []
    for f in range(k):
        mine = fold == f
        b = logistic(both[~mine], label[~mine], weight[~mine])
        scores.append(rank_auc(both[mine] @ b[:-1] + b[-1], label[mine]))
    scores = [s for s in scores if s is not None]
    return float(np.mean(scores)) if scores else None


def c2st_windows(reference: DataFrame, windows: DataFrame, folds: int = 5, max_samples: int = 4000, seed: int = 42) -> DataFrame:
    """(window_index, score): mean fold AUC of a balanced logistic classifier telling reference and window apart, all windows and
    folds in one plan. At most half of ``max_samples`` rows (srn, features) are drawn of each sample; null below two rows."""
    half = max_samples // 2
    count = lambda df: {r[0]: r[1] for r in df.groupBy("window_index").count().collect()}
    ref = sampled(reference, count(reference), half, seed) if own_keys(reference) else sample_rows(reference, reference.count(), half, seed, "srn")
    return by_window(ref, sampled(windows, count(windows), half, seed + 1), lambda x, y: fold_aucs(x, y, folds, seed))


def c2st(reference: DataFrame, current: DataFrame, folds: int = 5, max_samples: int = 4000, seed: int = 42) -> float | None:
    """The score of ``c2st_windows`` for one pair of samples (srn, features)."""
    got = c2st_windows(reference, current.withColumn("window_index", F.lit(0).cast("long")), folds, max_samples, seed).first()
    return got["score"] if got else None


def sinkhorn_cost(x: np.ndarray, y: np.ndarray, scale: float, reg: float, rounds: int = 300) -> float:
    """Entropic transport cost between equally weighted points. A round is two products with the kernel; where its numbers leave the
    range of doubles, it is done in the log domain."""
    c = squares(x, y) / scale
    kernel, u, v = np.exp(-c / reg), np.ones(len(x)), np.ones(len(y))
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            u = len(y) / (kernel @ v)
            new = len(x) / (u @ kernel)
            change = reg * np.abs(np.log(new) - np.log(v)).max()
            v = new
            if not change >= 1e-9:
                break
        plan = u[:, None] * kernel * v[None, :] / (len(x) * len(y))
        cost = float((plan * c).sum())
    tiny = kernel.max(axis=0).min() < 1e-200 or kernel.max(axis=1).min() < 1e-200
    if np.isfinite(cost) and np.isfinite(u).all() and np.isfinite(v).all() and (u > 0).all() and (v > 0).all() and not tiny:
        return cost
    return log_sinkhorn_cost(c, reg, rounds)


def log_sinkhorn_cost(c: np.ndarray, reg: float, rounds: int) -> float:
    f, g = np.zeros(c.shape[0]), np.zeros(c.shape[1])
    la, lb = -np.log(c.shape[0]), -np.log(c.shape[1])
    lse = lambda m, axis: (t := m.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(m - t).sum(axis=axis))
    for _ in range(rounds):
        f = -reg * lse((g[None, :] - c) / reg + lb, 1)
        new = -reg * lse((f[:, None] - c) / reg + la, 0)
        if np.abs(new - g).max() < 1e-9:
            g = new
            break
        g = new
    plan = np.exp((f[:, None] + g[None, :] - c) / reg + la + lb)
    return float((plan * c).sum())


def sinkhorn(reference: DataFrame, windows: DataFrame, reg: float = 0.05) -> DataFrame:
    """Debiased entropic divergence of every window from the reference; both bounded samples of rows with features."""

    def value(x: np.ndarray, y: np.ndarray) -> float:
        cross = squares(x, y)
        scale = float(np.median(cross[cross > 0])) if (cross > 0).any() else 1.0
        cost = sinkhorn_cost(x, y, scale, reg) - (sinkhorn_cost(x, x, scale, reg) + sinkhorn_cost(y, y, scale, reg)) / 2
        return float(np.sqrt(max(cost * scale, 0.0)))

    return by_window(reference, windows, value)


# --- Method names ------------------------------------------------------------------------------------------------------------

#: Method names.
STATIC = ("mean_ks", "max_ks", "mean_psi", "max_psi", "p95_psi", "robust_psi", "mmd_rbf", "energy", "c2st", "sinkhorn")


def parse_method(name: str) -> tuple[str, dict[str, int]]:
    """(family, parameters) of a method name; dynamic names carry numbers."""
    if m := re.fullmatch(r"sliced(?:_k(\d+))?(?:_q(\d+))?", name):
        return "sliced", {"projections": int(m[1] or 128), "grid": int(m[2] or 512)}
    if m := re.fullmatch(r"top(\d+)_psi", name):
        return "psi", {"top": int(m[1])}
    if name in STATIC:
        return {"ks": "ks", "psi": "psi"}.get(name.rpartition("_")[2], name), {"top": 5} if name == "robust_psi" else {}
    raise ValueError(f"unknown drift method: {name}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
