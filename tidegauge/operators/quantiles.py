"""Exact quantiles of groups of any size, by refined histograms.

Groups of up to ``SMALL`` values are sorted whole, a group in a task. The values of a larger group are counted in equal bins
between its least and greatest value; only bins that hold a wanted rank go on. A bin of one value gives it at once, a bin of up to
SMALL values gives its distinct values with their counts, a fuller one is cut into bins again. Counting is by map-side aggregation,
so no values are shuffled but those of small groups and wanted bins, and no task holds more than SMALL of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import settled

SMALL = 100_000


#: Groups or bins (some numbers each) up to which their table is broadcast to the rows.
FEW = 300_000


def _hinted(df: DataFrame) -> DataFrame:
    """df, which is computed already, broadcast if it is small: rows then stay where they are, whatever share of them a group has."""
    return F.broadcast(df) if df.count() <= FEW else df


def bins_for(ranks: int, rows: int, tasks: int) -> int:
    """Bins that balance the two things shuffled: counts, of which every task sends one a bin, and values, of which a share of ranks
    to bins is sent."""
    return int(2 ** np.clip(np.round(np.log2(max(1.0, ranks * rows / max(1, tasks))) / 2), 8, 16))


def wanted_ranks(at: np.ndarray, n: int) -> np.ndarray:
    """The 0-based ranks of n values that quantiles ``at`` lie between, ascending."""
    p = at * (n - 1)
    return np.unique(np.concatenate([np.floor(p), np.ceil(p)])).astype(np.int64)


def between(at: np.ndarray, n: int, ranks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Quantiles of n values from the values at their wanted ranks, linear between neighbours."""
    p = at * (n - 1)
    lo, hi = np.floor(p).astype(np.int64), np.ceil(p).astype(np.int64)
    a, b = values[np.searchsorted(ranks, lo)], values[np.searchsorted(ranks, hi)]
    return np.where(a == b, a, (hi - p) * a + (p - lo) * b)  # equal neighbours stay exactly what they are


def _bin(z: Column, lo: Column, hi: Column, bins: int) -> Column:
    share = F.when(F.abs(hi - lo) < float("inf"), (z - lo) / (hi - lo)).otherwise((z / 2 - lo / 2) / (hi / 2 - lo / 2))
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float], name: str = "q", weight: str | None = None, small: int = SMALL) -> DataFrame:
    """(keys, name): the quantiles ``at`` of finite ``value`` in every group, linear between neighbours. With ``weight`` a row counts
    so many times. Nulls don't count; groups without a value are left out."""
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__z"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("__w"))
    if not keys:
        own = own.withColumn("__all", F.lit(0))
    by, points = keys or ["__all"], np.array(at, float)
    stats = settled(own.groupBy(*by).agg(F.sum("__w").alias("__n"), F.count(F.lit(1)).alias("__rows"), F.min("__z").alias("__lo"), F.max("__z").alias("__hi")))
    large = (F.col("__rows") > small) & (F.col("__lo") < F.col("__hi"))
    point = (F.col("__rows") > small) & (F.col("__lo") == F.col("__hi"))
    kinds = {r[0]: r[1] for r in stats.groupBy(F.when(large, "large").when(point, "point").otherwise("small")).agg(F.max("__rows")).collect()}
    schema = ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in by), f"`{name}` array<double>"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["__z"].to_numpy(), kind="stable")
        z, upto = pdf["__z"].to_numpy()[order], np.cumsum(pdf["__w"].to_numpy()[order])
        ranks = wanted_ranks(points, int(upto[-1]))
        q = between(points, int(upto[-1]), ranks, z[np.searchsorted(upto, ranks, "right")])
        return pd.DataFrame({c: pdf[c].iloc[:1] for c in by}).assign(**{name: [q]})

    out = [stats.where(point).select(*by, F.array_repeat("__lo", len(at)).alias(name))] if "point" in kinds else []
    if "small" in kinds:
        few = own if len(kinds) == 1 else own.join(_hinted(stats.where(F.col("__rows") <= small).select(*by)), by, "left_semi")
        out.append(few.groupBy(*by).applyInPandas(whole, schema))
    if "large" in kinds:
        bins = bins_for(2 * len(at), kinds["large"], rows.sparkSession.sparkContext.defaultParallelism)
        out.append(_refined(own, stats.where(large), by, points, name, small, schema, bins))
    if not out:
        return stats.select(*by, F.lit(None).cast("array<double>").alias(name)).select(*keys, name)
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every.select(*keys, name)


def _chosen(path: list[str]):
    def choose(one: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
        """The bins of a group that hold a wanted rank, with the rank of their first value and the ranks in them."""
        bins = bins.sort_values(path[-1], ignore_index=True)
        start = one["__start"].iloc[0] + np.cumsum(bins["__k"].to_numpy()) - bins["__k"].to_numpy()
        ranks = np.sort(np.asarray(one["__ranks"].iloc[0]))
        place = np.searchsorted(start, ranks, "right") - 1
        hit = np.unique(place)
        out = bins.iloc[hit].assign(__start=start[hit], __ranks=[ranks[place == i] for i in hit])
        return out[[*path, "__k", "__rows", "__lo", "__hi", "__start", "__ranks"]]

    return choose


def _refined(own: DataFrame, stats: DataFrame, by: list[str], at: np.ndarray, name: str, small: int, schema: str, bins_each: int) -> DataFrame:
    """Quantiles of the groups in ``stats``, by one histogram a level."""
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(__start=0, __ranks=[wanted_ranks(at, int(n)) for n in pdf["__n"]])[[*by, "__lo", "__hi", "__start", "__ranks"]]

    typed = lambda path: ", ".join(f"`{c}` {kinds.get(c, 'int')}" for c in path)
    level = stats.mapInPandas(lambda batches: map(first, batches), f"{typed(by)}, __lo double, __hi double, __start bigint, __ranks array<bigint>")
    level = settled(level)
    rows, path, found = own, list(by), []
    while True:
        at_bin = f"__b{len(path)}"
        rows = rows.join(_hinted(level.select(*path, "__lo", "__hi")), path).withColumn(at_bin, _bin(F.col("__z"), F.col("__lo"), F.col("__hi"), bins_each)).drop("__lo", "__hi")
        counts = rows.groupBy(*path, at_bin).agg(F.sum("__w").alias("__k"), F.count(F.lit(1)).alias("__rows"), F.min("__z").alias("__lo"), F.max("__z").alias("__hi"))
        old, path = path, [*path, at_bin]

        bins = level.select(*old, "__start", "__ranks").groupBy(*old).cogroup(counts.groupBy(*old)).applyInPandas(_chosen(path), f"{typed(path)}, __k bigint, __rows bigint, __lo double, __hi double, __start bigint, __ranks array<bigint>")
        bins = settled(bins)  # at most two bins a quantile
        found.append(bins.where("__lo = __hi").select(*by, F.explode("__ranks").alias("__rank"), F.col("__lo").alias("__z")))
        some = bins.where((F.col("__lo") < F.col("__hi")) & (F.col("__rows") <= small)).select(*path, "__start", "__ranks")
        values = rows.join(_hinted(some.select(*path)), path, "left_semi").groupBy(*path, "__z").agg(F.sum("__w").alias("__k"))
        upto = F.sum("__k").over(Window.partitionBy(*path).orderBy("__z").rowsBetween(Window.unboundedPreceding, 0))  # at most ``small`` rows
        values = values.withColumn("__upto", upto).join(some, path).withColumn("__first", F.col("__start") + F.col("__upto") - F.col("__k"))
        here = F.filter("__ranks", lambda r: (r >= F.col("__first")) & (r < F.col("__first") + F.col("__k")))
        found.append(values.select(*by, F.explode(here).alias("__rank"), "__z"))
        level = bins.where((F.col("__lo") < F.col("__hi")) & (F.col("__rows") > small)).select(*path, "__lo", "__hi", "__start", "__ranks")
        if level.isEmpty():
            break
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)

    def finish(one: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("__rank")
        q = between(at, int(one["__n"].iloc[0]), values["__rank"].to_numpy(), values["__z"].to_numpy())
        return pd.DataFrame({c: one[c].iloc[:1] for c in by}).assign(**{name: [q]})

    return stats.select(*by, "__n").groupBy(*by).cogroup(every.groupBy(*by)).applyInPandas(finish, schema)
