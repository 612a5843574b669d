"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import builtins
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def process_store() -> dict:
    """A dict that lives as long as this Python process: memo tables outlast a task where workers are reused."""
    return builtins.__dict__.setdefault("_tidegauge_store", {})


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    One is made only where that is unset on one machine, as in tests; a cluster has to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile remove their shuffle files as soon as they have run."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, with its lineage cut; the shuffle files behind it go at once."""
    shared_folder(df.sparkSession)
    with _cleaning(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read from there: smaller than a checkpoint, columns can be left unread, and
    the shuffle files behind it go at once."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def share(df: DataFrame, value: object) -> Callable[[], object]:
    """Broadcast an object of bounded size; the result, called in a task, gives it back.

    It travels as cloudpickle bytes, so that workers need not be able to import its class.
    """
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to every Arrow batch; None drops the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def train_fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3 (1 is the held-out fold)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Powers that a process keeps (16 bytes each); longer tables live as long as they are used.
_KEPT_POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n; short tables are kept for the process."""
    store = process_store()
    have = store.get("powers")
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, _INVERSE, np.uint64)
        down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= _KEPT_POWERS:
            store["powers"] = have
    return have[0][:n], have[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base**position: the hash of any slice is one subtraction and one product away."""
    up, _ = powers(max(1, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_MIX[data] * up[: len(data)], out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of bounds."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


BYTE_MIX = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)
