"""Feature encoding fitted on training rows: types, imputation, scaling, one-hot, hashing, projections, PCA."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import finite, running_total
from .quantiles import exact_quantiles

#: Fixed value: what a missing category becomes.
MISSING = "__missing__"


@dataclass
class FeatureTypes:
    numeric: list[str] = field(default_factory=list)
    low: list[str] = field(default_factory=list)
    high: list[str] = field(default_factory=list)


def feature_types(train: DataFrame, features: list[str], max_onehot: int = 32) -> FeatureTypes:
    """Numbers but booleans are numeric; others have low or high cardinality by their distinct non-null training values."""
    out = FeatureTypes()
    other = [c for c in features if not isinstance(train.schema[c].dataType, T.NumericType)]
    out.numeric = [c for c in features if c not in other]
    if other:
        counts = train.agg(*(F.count_distinct(F.col(c).cast("string")).alias(c) for c in other)).first()
        for c in other:
            (out.low if counts[c] <= max_onehot else out.high).append(c)
    return out


def hash_bucket(token: Column, buckets: int) -> Column:
    """Stateless bucket of a text: the first 28 bits of its MD5 digest, modulo buckets."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long") % buckets


@dataclass
class Encoder:
    """What was fitted on the training rows. Outputs come in the order numeric, indicators, low, hashed."""

    types: FeatureTypes
    median: dict[str, float]
    indicators: list[str]
    centre: dict[str, tuple[float, float]]
    categories: dict[str, list[str]]
    buckets: int = 256

    @staticmethod
    def fit(train: DataFrame, types: FeatureTypes, buckets: int = 256) -> Encoder:
        if not (types.numeric or types.low or types.high):
            raise ValueError("no usable feature column")
        num = types.numeric
        rows = train.select(*(finite(F.col(c).cast("double")).alias(c) for c in num), *(F.col(c).cast("string").alias(c) for c in types.low))
        median, gaps, centre = {}, [], {}
        if num:
            got = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"k_{c}") for c in num)).first()
            long = rows.select(F.posexplode(F.array(*num)).alias("at", "value"))
            half = {num[r["at"]]: r["q"][0] for r in exact_quantiles(long, ["at"], "value", [0.5]).collect()}  # one number a column
            median = {c: half.get(c, 0.0) for c in num}
            gaps = [c for c in num if got[f"k_{c}"] < got["n"]]
            full = {c: F.coalesce(F.col(c), F.lit(median[c])) for c in num} | {f"{c}__missing": F.col(c).isNull().cast("double") for c in gaps}
            got = rows.agg(*(f(x).alias(f"{p}_{c}") for c, x in full.items() for p, f in (("a", F.avg), ("s", F.stddev_pop)))).first()
            centre = {c: (got[f"a_{c}"], got[f"s_{c}"] or 1.0) for c in full}
        categories = {}
        if types.low:
            got = rows.agg(*(F.array_sort(F.collect_set(F.coalesce(F.col(c), F.lit(MISSING)))).alias(c) for c in types.low)).first()
            categories = {c: list(got[c]) for c in types.low}  # at most max_onehot + 1 values a column
        return Encoder(types, median, gaps, centre, categories, buckets)

    def columns(self) -> dict[str, Column]:
        """Encoded features by name, as expressions on the input rows."""
        out: dict[str, Column] = {}
        for c in self.types.numeric:
            x = finite(F.col(c).cast("double"))
            a, s = self.centre[c]
            out[c] = (F.coalesce(x, F.lit(self.median[c])) - F.lit(a)) / F.lit(s)
        for c in self.indicators:
            a, s = self.centre[f"{c}__missing"]
            out[f"{c}__missing"] = (finite(F.col(c).cast("double")).isNull().cast("double") - F.lit(a)) / F.lit(s)
        for c in self.types.low:
            v = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            for value in self.categories[c]:
                out[f"{c}={value}"] = (v == value).cast("double")
        return out

    def hash_places(self) -> Column:
        """The buckets of the tokens name=value of all high-cardinality columns."""
        return F.array(*(hash_bucket(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(MISSING))), self.buckets) for c in self.types.high))

    def hashed(self) -> Column | None:
        """array<double> of counts of the tokens name=value of all high-cardinality columns."""
        if not self.types.high:
            return None
        zeros = F.array_repeat(F.lit(0.0), self.buckets)
        once = lambda a, x: F.concat(F.slice(a, 1, x.cast("int")), F.array(F.get(a, x.cast("int")) + 1.0), F.slice(a, x.cast("int") + 2, self.buckets))
        return F.aggregate(self.hash_places(), zeros, once)

    def names(self) -> list[str]:
        return [*self.columns(), *(f"hash_{i}" for i in range(self.buckets if self.types.high else 0))]

    def transform(self, rows: DataFrame, keep: list[str], name: str = "features") -> DataFrame:
        """keep columns and the encoded features: array<double>, or with hashed columns a sparse struct of size, indices and values
        that leaves out zeros."""
        cells = self.columns()
        dense = F.array(*cells.values()) if cells else F.array().cast("array<double>")
        if not self.types.high:
            return rows.select(*keep, dense.alias(name))
        first = len(cells)
        own = F.filter(F.transform(dense, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c["x"] != 0)
        at = self.hash_places()
        hashed = F.transform(F.array_sort(F.array_distinct(at)), lambda b: F.struct((b + first).cast("int").alias("i"), F.size(F.filter(at, lambda x: x == b)).cast("double").alias("x")))
        held = rows.select(*keep, F.concat(own, hashed).alias("__c"))
        sparse = F.struct(F.lit(first + self.buckets).alias("size"), F.transform("__c", lambda c: c["i"]).alias("indices"), F.transform("__c", lambda c: c["x"]).alias("values"))
        return held.select(*keep, sparse.alias(name))


def is_sparse(rows: DataFrame, features: str = "features") -> bool:
    return isinstance(rows.schema[features].dataType, T.StructType)


def dimension(rows: DataFrame, features: str = "features") -> int:
    """Number of features; 0 without a row."""
    one = rows.select((F.col(f"{features}.size") if is_sparse(rows, features) else F.size(features)).alias("d")).first()
    return one["d"] if one else 0


def dense(rows: DataFrame, features: str = "features") -> DataFrame:
    """rows with features as array<double>."""
    if not is_sparse(rows, features):
        return rows
    cells = F.map_from_arrays(F.col(f"{features}.indices"), F.col(f"{features}.values"))
    held = rows.withColumn("__m", cells)
    return held.withColumn(features, F.transform(F.sequence(F.lit(0), F.col(f"{features}.size") - 1), lambda i: F.coalesce(F.col("__m")[i], F.lit(0.0)))).drop("__m")


def parts(rows: DataFrame, features: str = "features") -> list[Column]:
    """The columns that carry features to a pandas function, for ``matrix``."""
    if is_sparse(rows, features):
        return [F.col(f"{features}.{c}").alias(c) for c in ("size", "indices", "values")]
    return [F.col(features).alias("cells")]


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    """The features of rows with the columns of ``parts``."""
    if "cells" in pdf:
        return np.array(pdf["cells"].tolist(), float).reshape(len(pdf), -1)
    out = np.zeros((len(pdf), int(pdf["size"].iloc[0]) if len(pdf) else 0))
    for i, (at, x) in enumerate(zip(pdf["indices"], pdf["values"])):
        out[i, at] = x
    return out


def value_counts(rows: DataFrame, keep: list[str], name: str, features: str = "features") -> DataFrame:
    """(keep, feature_id, value, name): how often every finite value occurs. Zeros of sparse features come from the number of rows,
    not from cells."""
    if not is_sparse(rows, features):
        return long_form(rows, keep, features).groupBy(*keep, "feature_id", "value").agg(F.count(F.lit(1)).alias(name))
    cells = F.explode(F.arrays_zip(F.col(f"{features}.indices").alias("i"), F.col(f"{features}.values").alias("x"))).alias("c")
    found = rows.select(*keep, cells).select(*keep, F.col("c.i").alias("feature_id"), F.col("c.x").alias("value")).groupBy(*keep, "feature_id", "value").agg(F.count(F.lit(1)).alias(name))
    totals = rows.groupBy(*keep).agg(F.count(F.lit(1)).alias("__n"), F.max(f"{features}.size").alias("__d"))
    every = totals.where("__n > 0").select(*keep, "__n", F.explode(F.sequence(F.lit(0), F.col("__d") - 1)).alias("feature_id"))
    some = found.groupBy(*keep, "feature_id").agg(F.sum(name).alias("__k"))
    zeros = every.join(some, [*keep, "feature_id"], "left").select(*keep, "feature_id", F.lit(0.0).alias("value"), (F.col("__n") - F.coalesce("__k", F.lit(0))).alias(name))
    return found.where(finite("value").isNotNull()).unionByName(zeros.where(F.col(name) > 0))


def long_form(rows: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
    """One row a feature: keep columns, feature_id, value (finite or dropped)."""
    rows = dense(rows, features)
    return rows.select(*keep, F.posexplode(features).alias("feature_id", "value")).withColumn("value", finite("value")).where("value is not null")


def directions(dim: int, count: int, seed: int = 42) -> np.ndarray:
    """Unit directions, dim x count, as numpy draws them."""
    d = np.random.default_rng(seed).normal(size=(dim, count))
    return d / np.maximum(np.linalg.norm(d, axis=0, keepdims=True), 1e-12)


def block(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow column of equally long arrays, or of sparse features, as a matrix."""
    if pa.types.is_struct(column.type):
        at, x = column.field("indices"), column.field("values")
        out = np.zeros((len(column), column.field("size")[0].as_py()))
        out[np.repeat(np.arange(len(column)), at.value_lengths().to_numpy(zero_copy_only=False)), at.flatten().to_numpy(zero_copy_only=False)] = x.flatten().to_numpy(zero_copy_only=False)
        return out
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def products(rows: DataFrame, keep: list[str], theta: np.ndarray | None, features: str = "features", name: str = "z", centre: np.ndarray | None = None) -> DataFrame:
    """keep columns and name, array<double>: every row (less ``centre``) times theta, if given, as matrix products over Arrow batches."""
    sent = rows.sparkSession.sparkContext.broadcast((theta, 0.0 if centre is None else centre))
    fields = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mean = sent.value
        for batch in batches:
            if batch.num_rows:
                z = block(batch.column("__x")) - mean
                z = z if own is None else z @ own
                ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], [*keep, name])

    return rows.select(*keep, F.col(features).alias("__x")).mapInArrow(run, fields)


def projected(rows: DataFrame, keep: list[str], theta: np.ndarray, features: str = "features") -> DataFrame:
    """keep columns, proj_id and z: every row on every direction."""
    return products(rows, keep, theta, features).select(*keep, F.posexplode("z").alias("proj_id", "z"))


#: Features from which components come from distributed products instead of a covariance matrix on the driver.
WIDE = 1024
#: Rows of a summed matrix that meet in one group.
CHUNK = 256


def summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], features: str = "features") -> np.ndarray:
    """The sum of make(block) over all blocks of rows: summed by task, then by pieces of CHUNK rows of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = make(block(batch.column(features)))
                total = got if total is None else total + got
        if total is not None:
            pieces = [np.ascontiguousarray(total[i : i + CHUNK]).tobytes() for i in range(0, shape[0], CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["at", "piece"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "piece": [sum(np.frombuffer(v) for v in pdf["piece"]).tobytes()]})

    out = np.zeros(shape)
    for r in rows.select(features).mapInArrow(run, "at int, piece binary").groupBy("at").applyInPandas(add, "at int, piece binary").collect():  # the result itself
        out[r["at"] * CHUNK : (r["at"] + 1) * CHUNK] = np.frombuffer(r["piece"]).reshape(-1, shape[1])
    return out


def wide_components(rows: DataFrame, mean: np.ndarray, k: int, features: str = "features", extra: int = 10, rounds: int = 5, seed: int = 42) -> np.ndarray:
    """Leading principal directions (features x k) by a randomised range finder with power steps: only matrices of features x
    (k + extra) reach the driver."""
    width = min(len(mean), k + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), width)))[0]
    sc = rows.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast((q, mean))
        q = np.linalg.qr(summed(rows, lambda x: (x - sent.value[1]).T @ ((x - sent.value[1]) @ sent.value[0]), q.shape, features))[0]  # noqa: B023  called at once
    sent = sc.broadcast((q, mean))
    inner = summed(rows, lambda x: (z := (x - sent.value[1]) @ sent.value[0]).T @ z, (width, width), features)
    return q @ np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1][:, :k]


def pca(train: DataFrame, components: int = 32, features: str = "features", wide: int = WIDE):
    """A function that maps rows to principal components of the centred training rows."""
    dim = dimension(train, features)
    n = train.count()
    k = max(1, min(components, dim, n - 1))
    mean = summed(train, lambda x: x.sum(axis=0)[:, None], (dim, 1), features)[:, 0] / n
    if dim > wide:
        theta = wide_components(train, mean, k, features)
    else:
        centred = products(train, [], None, features, "__v", mean).select(array_to_vector("__v").alias("__v"))
        theta = PCA(k=k, inputCol="__v", outputCol="__p").fit(centred).pc.toArray()
    return lambda df: products(df, [c for c in df.columns if c != features], theta, features, features, mean).select(*df.columns)


def ordered_target(rows: DataFrame, column: str, label: str, order: str, name: str = "target_mean", weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows with name, category means): ordered target statistics of a category. A row's mean is of the labels of earlier rows of its
    category only, so its own label doesn't leak; the overall mean counts ``weight`` rows more. Later rows take theirs from the second
    table (column, name). Null is a category; null labels don't count. Running sums are cut into ranges of the order, so a category may
    hold any share of the rows."""
    y = F.col(label).cast("double")
    held = rows.withColumns({"__c": F.coalesce(F.col(column).cast("string"), F.lit(MISSING)), "__y": F.coalesce(y, F.lit(0.0)), "__k": y.isNotNull().cast("long")})
    mean = held.agg(F.sum("__y") / F.sum("__k")).first()[0] or 0.0
    smooth = lambda total, count: (total + weight * mean) / (count + weight)
    upto = running_total(running_total(held, ["__c"], [order], "__y", "__sy"), ["__c"], [order], "__k", "__sk")
    out = upto.withColumn(name, smooth(F.col("__sy") - F.col("__y"), F.col("__sk") - F.col("__k"))).drop("__c", "__y", "__k", "__sy", "__sk")
    table = held.groupBy(F.col("__c").alias(column)).agg(smooth(F.sum("__y"), F.sum("__k")).alias(name))
    return out, table


def binary_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each feature of long rows that is 0 or 1 throughout its group, else null."""
    ok = F.bool_and(F.col("value").isin(0.0, 1.0))
    return rows.groupBy(*keys, "feature_id").agg(F.when(ok, F.avg("value")).alias("mean"))
