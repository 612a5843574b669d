"""Time order, splits, windows and samples as columns on rows."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")
#: Rows up to which a running total may use one partition of a window.
ONE_TASK = 2_000_000


def settled(df: DataFrame) -> DataFrame:
    """df computed once, kept in the shared checkpoint folder (spark.checkpoint.dir; one is made only on one machine, as in tests)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def with_ordinal(df: DataFrame, *keys: str, name: str = "rn") -> DataFrame:
    """Add the 0-based position of each row in the order of keys, without a single-task sort.

    Rows are range-partitioned and sorted within partitions; a row's position is its place in the partition plus the
    sizes of the partitions before, of which there are as many as partitions. Keys must tell rows apart.
    """
    placed = settled(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offset = F.broadcast(df.sparkSession.createDataFrame(before or [(0, 0)], "__part bigint, __before bigint"))
    placed = placed.withColumn("__part", part.cast("long")).join(offset, "__part", "left")
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__at")


def with_source_order(df: DataFrame, name: str = "source_order") -> DataFrame:
    """Add the place of every row in the files that df was just read from: file, start of the part of the file, place within. Sorting
    by it after the time leaves equal times in the order of the input."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", place.alias(name))


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over a group's rows up to and including each row, in order.

    Large inputs are cut into ranges of the order; each range is summed on its own and shifted by the ranges before.
    """
    df = settled(df)
    upto = lambda *by: F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if df.count() <= ONE_TASK:
        return df.withColumn(name, upto(*group))
    cut = settled(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    sums = cut.groupBy(*group, "__part").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sums.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__sum")
    return cut.withColumn(name, upto(*group, "__part")).join(F.broadcast(shift), [*group, "__part"]).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def fraction_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, test: float = 0.2, rn: str = "rn", size: int | None = None) -> DataFrame:
    """Add split and srn (position within the split): the first rows train, the next validate, the rest test."""
    if min(train, validation, test) <= 0 or abs(train + validation + test - 1) > 1e-9:
        raise ValueError("fractions must be positive and sum to 1")
    n = df.count() if size is None else size
    first = int(n * train)
    second = first + int(n * validation)
    if not 0 < first < second < n:
        raise ValueError("a part of the split would be empty")
    name = F.when(F.col(rn) < first, SPLITS[0]).when(F.col(rn) < second, SPLITS[1]).otherwise(SPLITS[2])
    start = F.when(F.col(rn) < first, 0).when(F.col(rn) < second, first).otherwise(second)
    return df.withColumn("split", name).withColumn("srn", F.col(rn) - start)


def official_split(df: DataFrame, column: str) -> DataFrame:
    """Add split from a column of names in any case; rows with other names are dropped. The order stays as it is."""
    low = F.lower(F.col(column))
    name = F.when(low == "train", SPLITS[0]).when(low.isin("val", "valid", "validation"), SPLITS[1]).when(low == "test", SPLITS[2])
    return df.withColumn("split", name).where(F.col("split").isNotNull())


def last_window(n: int, size: int, least: int | None = None, drop_remainder: bool = False) -> tuple[int, int]:
    """(number of windows, rows covered) of n rows in windows of ``size``; a short tail joins the last window or goes."""
    least = max(2, size // 2) if least is None else least
    full, tail = divmod(n, size)
    if tail and (tail >= least or not full and not drop_remainder):
        return full + 1, n
    return full, full * size if drop_remainder else n


def count_windows(df: DataFrame, size: int, least: int | None = None, drop_remainder: bool = False, split: str = "split", srn: str = "srn") -> DataFrame:
    """Add window_index to the rows of every split; rows of a dropped tail go."""
    sizes = {r[0]: r[1] for r in df.groupBy(split).count().collect()}
    out, keep = F.lit(None).cast("long"), F.lit(False)
    for name, n in sorted(sizes.items()):
        windows, covered = last_window(n, size, least, drop_remainder)
        mine = F.col(split) == name
        index = F.least(F.floor(F.col(srn) / size), F.lit(max(0, windows - 1))).cast("long")
        out, keep = F.when(mine, index).otherwise(out), F.when(mine, F.col(srn) < covered).otherwise(keep)
    return df.withColumn("window_index", out).where(keep)


def calendar_windows(df: DataFrame, time: str, freq: str = "month", least: int = 2) -> DataFrame:
    """Add window_index (dense over kept periods) and window_label (position among all periods); small periods go."""
    if df.schema[time].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date"):
        raise ValueError("calendar windows need a timestamp column")
    unit = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}.get(freq, freq)
    rows = df.withColumn("period", F.date_trunc(unit, F.col(time)))
    sizes = rows.groupBy("period").count()  # one row a period: a small table
    sizes = sizes.withColumn("window_label", F.row_number().over(Window.orderBy("period")) - 1).where(F.col("count") >= least)
    sizes = sizes.withColumn("window_index", F.row_number().over(Window.orderBy("period")) - 1).drop("count")
    return rows.join(sizes, "period")


def window_table(rows: DataFrame, rn: str = "srn") -> DataFrame:
    """One row a window: first and one past the last position, and size."""
    return rows.groupBy("split", "window_index").agg(F.min(rn).alias("window_start"), (F.max(rn) + 1).alias("window_end"), F.count(F.lit(1)).alias("window_size"))


def require_windows(windows: DataFrame, least: int) -> None:
    n = windows.select("window_index").distinct().count()
    if n < least:
        raise ValueError(f"{n} windows, at least {least} are asked for")


def drawn(n: int, size: int, seed: int) -> np.ndarray:
    """Sorted positions of a sample without replacement; all positions if n <= size."""
    return np.arange(n) if n <= size else np.sort(np.random.default_rng(seed).choice(n, size=size, replace=False))


def sample_rows(df: DataFrame, n: int, size: int, seed: int, rn: str = "rn") -> DataFrame:
    """Rows at drawn positions. The positions (at most ``size``) are broadcast; no row is collected."""
    if n <= size:
        return df
    at = df.sparkSession.createDataFrame([(int(i),) for i in drawn(n, size, seed)], f"`{rn}` bigint")
    return df.join(F.broadcast(at), rn, "left_semi")


def sample_features(long: DataFrame, n: int, most: int | None, seed: int) -> DataFrame:
    """Long rows of at most ``most`` drawn features of n; all of them if there are no more. The ids are literals."""
    if most is None or n <= most:
        return long
    return long.where(F.col("feature_id").isin([int(i) for i in drawn(n, most, seed)]))


def recent_reference(rows: DataFrame, windows: int, split: str = "test") -> DataFrame:
    """Reference rows of every window of a split: those of the last ``windows`` windows before it, over all scored
    splits in time order; windows without any predecessor use the training rows. Adds for_window."""
    order = ("validation", "test")
    scored = rows.where(F.col("split").isin(*order)).withColumn("__s", F.when(F.col("split") == "validation", 0).otherwise(1))
    ids = scored.select("split", "__s", "window_index").distinct()  # one row a window
    ids = ids.withColumn("__pos", F.row_number().over(Window.orderBy("__s", "window_index")) - 1)
    target = ids.where(F.col("split") == split).select(F.col("window_index").alias("for_window"), F.col("__pos").alias("__for"))
    # the training rows stand before the first scored window as one block
    blocks = ids.select("split", "window_index", "__pos").unionByName(rows.sparkSession.createDataFrame([("train", None, -1)], "split string, window_index bigint, __pos int"))
    # a row for each window and predecessor, so that both joins are by equality
    before = target.withColumn("__pos", F.explode(F.sequence(F.greatest(F.lit(-1), F.col("__for") - windows), F.col("__for") - 1)))
    pairs = before.join(blocks, "__pos").select("for_window", "split", F.coalesce("window_index", F.lit(-1)).alias("__window"))
    block = F.when(F.col("split") == "train", F.lit(-1)).otherwise(F.col("window_index"))
    return rows.withColumn("__window", block).join(pairs, ["split", "__window"]).select("for_window", *rows.columns)


def finite(x: Column | str) -> Column:
    """x where it is a finite number, else null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
