"""Tables with roles from CSV, Parquet, saved tables, array folders or a generator."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.ordering import with_source_order


@dataclass(frozen=True)
class Dataset:
    """A table with its target, time and optional split column."""

    name: str
    frame: DataFrame
    target: str
    time: str
    task: str
    split: str | None = None
    source: str = ""
    place: str | None = None  # the column of the order of the input

    @property
    def features(self) -> list[str]:
        return [c for c in self.frame.columns if c not in (self.target, self.time, self.split, self.place)]

    @property
    def order(self) -> list[str]:
        """What rows are sorted by: time, then their place in the input, or all other columns where that isn't known."""
        return [self.time, self.place] if self.place else [self.time, *(c for c in self.frame.columns if c != self.time)]


def infer_task(frame: DataFrame, target: str, task: str | None = None) -> str:
    """classification or regression: as given; else texts, booleans and integers with few values are classes."""
    if task:
        if task not in ("classification", "regression"):
            raise ValueError(f"unknown task: {task}")
        return task
    kind = frame.schema[target].dataType
    known = frame.where(F.col(target).isNotNull())
    n, distinct = known.agg(F.count(F.lit(1)), F.count_distinct(target)).first()
    if not n:
        raise ValueError("the target has no values")
    if not isinstance(kind, T.NumericType):
        return "classification"
    return "classification" if isinstance(kind, T.IntegralType) and distinct <= max(20, int(0.05 * n)) else "regression"


def dataset_name(path: str) -> str:
    return Path(path).stem.lower().replace(" ", "_")


#: The column of the order of the input of datasets from files.
PLACE = "source_order"


def _with_roles(frame: DataFrame, path: str, target: str, time: str, task: str | None, name: str | None, split: str | None) -> Dataset:
    missing = [c for c in (target, time) if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return Dataset(name or dataset_name(path), frame, target, time, infer_task(frame, target, task), split, path, PLACE if PLACE in frame.columns else None)


def load_csv_frame(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return with_source_order(spark.read.options(**({"header": "true", "inferSchema": "true"} | options)).csv(path), PLACE)


def load_csv(spark: SparkSession, path: str, target: str, time: str, task: str | None = None, name: str | None = None, split: str | None = None, **options: str) -> Dataset:
    return _with_roles(load_csv_frame(spark, path, **options), path, target, time, task, name, split)


def load_parquet(spark: SparkSession, path: str, target: str, time: str, task: str | None = None, name: str | None = None, split: str | None = None) -> Dataset:
    return _with_roles(with_source_order(spark.read.parquet(path), PLACE), path, target, time, task, name, split)


def load_table(spark: SparkSession, table: str, target: str, time: str, task: str | None = None, name: str | None = None, split: str | None = None) -> Dataset:
    return _with_roles(spark.table(table), table, target, time, task, name, split)


#: Array files of a folder and the prefix of their columns.
ARRAYS = {"X_num": "num", "X_bin": "bin", "X_cat": "cat", "X_meta": "meta"}
#: Files that a complete folder has.
REQUIRED = ("Y.npy", "info.json", "split-{}/train_idx.npy", "split-{}/val_idx.npy", "split-{}/test_idx.npy")


#: Arrays of texts or codes, and names of tasks.
TEXTS = ("X_cat", "X_meta")
TASKS = {"regression": "regression", "reg": "regression", "binclass": "classification", "multiclass": "classification", "classification": "classification", "class": "classification"}


def missing_files(folder: str, split: str = "default") -> list[str]:
    """What keeps a folder from being a complete array dataset; empty if nothing does."""
    root = Path(folder)
    out = [f.format(split) for f in REQUIRED if not (root / f.format(split)).exists()]
    return out + ([] if any((root / f"{a}.npy").exists() for a in ARRAYS) else ["X_*.npy"])


def load_arrays(spark: SparkSession, folder: str, split: str = "default", name: str | None = None, rows_per_task: int = 200_000) -> Dataset:
    """A folder of numpy arrays on storage that all executors see. Tasks map the files and read their own rows.

    Rows come in the order train, validation, test; time is their position. Arrays of one dimension are one column. Texts are arrays
    of fixed width: object arrays, which would run code from the file, are refused.
    """
    root = Path(folder)
    if not (root / f"split-{split}").is_dir():
        raise FileNotFoundError(f"no split {split} in {folder}")
    present = [a for a in ARRAYS if (root / f"{a}.npy").exists()]
    if not present:
        raise FileNotFoundError(f"no feature arrays in {folder}")
    heads = {a: np.load(root / f"{a}.npy", mmap_mode="r") for a in present}
    text = {a: a in TEXTS or heads[a].dtype.kind not in "fiub" for a in present}
    columns = [(a, i, f"{ARRAYS[a]}_{i}") for a in present for i in range(heads[a].shape[1] if heads[a].ndim > 1 else 1)]
    y = np.load(root / "Y.npy", mmap_mode="r")
    y_kind = {"f": "double", "i": "bigint", "u": "bigint", "b": "boolean"}.get(y.dtype.kind, "string")
    info = root / "info.json"
    kind = str((json.loads(info.read_text()) if info.exists() else {}).get("task_type") or "classification").lower()
    if kind not in TASKS:
        raise ValueError(f"unknown task: {kind}")
    parts, at = [], 0
    for part, file in (("train", "train_idx"), ("validation", "val_idx"), ("test", "test_idx")):
        n = len(np.load(root / f"split-{split}" / f"{file}.npy", mmap_mode="r"))
        parts += [(part, file, low, min(n, low + rows_per_task), at + low) for low in range(0, n, rows_per_task)]
        at += n
    schema = ", ".join([*(f"{c} {'string' if text[a] else 'double'}" for a, _, c in columns), f"target {y_kind}", "time bigint", "split string"])
    path = str(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            for part, file, low, high, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = np.load(f"{path}/split-{split}/{file}.npy", mmap_mode="r")[low:high]
                data = {a: np.load(f"{path}/{a}.npy", mmap_mode="r")[own].reshape(high - low, -1) for a in present}
                arrays = [pa.array([None if v is None else str(v) for v in data[a][:, i]], pa.string()) if text[a] else pa.array(data[a][:, i].astype(float)) for a, i, _ in columns]
                target = np.load(f"{path}/Y.npy", mmap_mode="r")[own]
                arrays += [pa.array(target.tolist(), types[y_kind]), pa.array(np.arange(first, first + high - low)), pa.array([part] * (high - low))]
                yield pa.RecordBatch.from_arrays(arrays, [*(c for _, _, c in columns), "target", "time", "split"])

    plan = spark.createDataFrame(parts, "part string, file string, low bigint, high bigint, first bigint").repartition(max(1, len(parts)))
    return Dataset(name or root.name.replace("_", "-"), plan.mapInArrow(read, schema), "target", "time", TASKS[kind], "split", folder)


def generate(spark: SparkSession, n: int = 12_000, numeric: int = 10, categorical: int = 3, drift_start: float = 0.75, task: str = "classification", seed: int = 42, name: str = "synthetic_temporal") -> Dataset:
    """A table whose distribution changes at ``drift_start``, made row by row from hashes, at any size.

    The first four numbers are correlated; from the change on, two of them move, two swap, two widen, categories become
    even and the first number is missing more often.
    """
    late = F.col("time") >= int(n * drift_start)
    beta = np.random.default_rng(seed).normal(size=numeric)
    beta /= np.linalg.norm(beta) + 1e-12
    z = lambda i: F.randn(seed + i)
    df = spark.range(n).select(F.col("id").alias("time"))
    df = df.withColumns({"__c": z(1000), **{f"x_num_{i}": z(i) for i in range(numeric)}})
    # equal correlation of 1/4: half of a common part
    df = df.withColumns({f"x_num_{i}": F.sqrt(F.lit(0.75)) * F.col(f"x_num_{i}") + 0.5 * F.col("__c") for i in range(min(4, numeric))})
    x = [F.col(f"x_num_{i}") for i in range(numeric)]
    moved = {}
    if numeric >= 2:
        moved |= {0: x[0] + 0.75, 1: x[1] - 0.5}
    if numeric >= 4:
        moved |= {2: x[3], 3: x[2]}
    if numeric >= 6:
        moved |= {4: x[4] * 1.45, 5: x[5] * 1.45}
    df = df.withColumns({f"x_num_{i}": F.when(late, c).otherwise(x[i]) for i, c in moved.items()})
    pick = lambda u, cuts: F.when(u < cuts[0], "a").when(u < cuts[1], "b").when(u < cuts[2], "c").otherwise("d")
    for i in range(categorical):
        df = df.withColumn("__u", F.rand(seed + 2000 + i))
        df = df.withColumn(f"x_cat_{i}", F.when(late, pick(F.col("__u"), (0.25, 0.5, 0.75))).otherwise(pick(F.col("__u"), (0.60, 0.85, 0.95))))
    if numeric:
        df = df.withColumn("x_num_0", F.when(F.rand(seed + 4000) >= F.when(late, 0.18).otherwise(0.03), F.col("x_num_0")))
    # the target sees a missing number as 0, and five slow waves over the time of the table
    signal = sum((F.coalesce(F.col(f"x_num_{i}"), F.lit(0.0)) * float(beta[i]) for i in range(numeric)), F.lit(0.0))
    signal = signal + 0.35 * F.sin(F.col("time") * (10 * float(np.pi) / max(1, n - 1)))
    chance = 1 / (1 + F.exp(-(signal + 0.7 * z(3001))))
    df = df.withColumn("target", (F.rand(seed + 3000) < chance).cast("int") if task == "classification" else signal + 0.5 * z(3001))
    return Dataset(name, df.drop("__c", "__u"), "target", "time", task, None, "generated")


#: Names of settings in dataset files, and ours where they differ.
SPEC = {
    "target_col": "target",
    "time_col": "time",
    "split_col": "split",
    "task_type": "task",
    "n_samples": "n",
    "n_numeric": "numeric",
    "n_categorical": "categorical",
    "drift_start_frac": "drift_start",
}


#: Options of another CSV reader in dataset files, and Spark's names for them.
CSV_OPTIONS = {"sep": "sep", "delimiter": "sep", "encoding": "encoding", "quotechar": "quote", "escapechar": "escape", "comment": "comment", "date_format": "timestampFormat"}
#: Options that change nothing here: texts are read the same way at any size.
CSV_IDLE = ("low_memory", "engine", "memory_map", "cache_dates", "infer_datetime_format")


def load_csv_as(spark: SparkSession, path: str, options: dict, target: str, time: str, task: str | None = None, name: str | None = None, split: str | None = None) -> Dataset:
    """A CSV file with the reader options of its dataset file: those of CSV_OPTIONS, header (0 or null), names, usecols, index_col
    (false), na_values (one text), parse_dates (columns), dtype (by column), nrows. Others are refused."""
    given = {CSV_OPTIONS[k]: str(v) for k, v in options.items() if k in CSV_OPTIONS}
    rest = {k: v for k, v in options.items() if k not in CSV_OPTIONS and k not in CSV_IDLE}
    names, header = rest.pop("names", None), rest.pop("header", 0)
    given["header"] = str(header is not None and (names is None or "header" in options)).lower()
    if header not in (0, None, "infer"):
        raise ValueError(f"header in line {header}")
    if (missing := rest.pop("na_values", None)) is not None:
        one = [missing] if isinstance(missing, str) else list(missing)
        if len(one) != 1:
            raise ValueError("na_values takes one text")
        given["nullValue"] = one[0]
    if rest.pop("index_col", False):
        raise ValueError("index_col isn't taken")
    columns, dates, kinds, most = rest.pop("usecols", None), rest.pop("parse_dates", None) or [], rest.pop("dtype", None) or {}, rest.pop("nrows", None)
    if rest:
        raise ValueError(f"unknown CSV options: {sorted(rest)}")
    data = load_csv_frame(spark, path, **given)
    data = data.toDF(*names, PLACE) if names else data
    data = data.select(*columns, PLACE) if columns else data
    types = {c: {"str": "string", "object": "string", "category": "string", "int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float", "bool": "boolean"}.get(str(t), str(t)) for c, t in kinds.items()}
    types |= {c: "timestamp" for c in (dates if isinstance(dates, list) else [])}
    data = data.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in data.columns})
    return _with_roles(data.limit(most) if most else data, path, target, time, task, name, split)


def load_spec(spark: SparkSession, spec: dict) -> Dataset:
    """A dataset from a mapping with ``type``: csv, parquet, table, arrays (or tabred) or synthetic. Names of SPEC are taken too."""
    spec = {SPEC.get(k, k): v for k, v in spec.items()}
    kind, options = str(spec.pop("type", "csv")).lower(), spec.pop("read_csv_kwargs", None)
    loaders = {"csv": load_csv, "parquet": load_parquet, "table": load_table, "arrays": load_arrays, "tabred": load_arrays, "synthetic": generate}
    if kind not in loaders:
        raise ValueError(f"unknown dataset type: {kind}")
    if options and kind == "csv":
        path = spec.pop("path")
        return load_csv_as(spark, path, dict(options), **spec)
    if loaders[kind] is load_arrays and "path" in spec:
        spec["folder"] = spec.pop("path")
    return loaders[kind](spark, **spec)
