"""Calendar windows over a stream, compared with a static reference."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.distance import quantile_grid
from tidegauge.operators.ordering import settled
from tidegauge.operators.quantiles import exact_quantiles


def window_quantiles(stream: DataFrame, time: str, value: str, width: str = "1 day", late: str = "1 day", grid: int = 11, accuracy: int | None = None) -> DataFrame:
    """(start, n_rows, mean, q) of every window; a window comes out when the watermark has passed it. Exact quantiles keep the distinct values of
    a window as state; with ``accuracy`` (say 10,000) a sketch of that size is kept instead, for windows of any number of values."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    at = F.array(*map(F.lit, quantile_grid(grid)))
    return rows.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean"), (F.percentile_approx(F.col(value).cast("double"), at, F.lit(accuracy)) if accuracy else F.percentile(value, at)).alias("q")).select(F.col("window.start").alias("start"), "n_rows", "mean", "q")


def drift_of(windows: DataFrame, reference: list[float]) -> DataFrame:
    """Add the root mean squared quantile distance from the reference's quantiles."""
    ref = F.array(*map(F.lit, reference))
    square = F.zip_with("q", ref, lambda a, b: (a - b) * (a - b))
    return windows.withColumn("score", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x) / len(reference))).drop("q")


def replay(spark: SparkSession, folder_in: str, name: str, time: str, value: str, grid: int = 11, accuracy: int | None = None) -> DataFrame:
    """Run the file of a table (``name`` in a folder) through the stream once and return the windows that were complete."""
    table = spark.read.parquet(f"{folder_in}/{name}")
    reference = exact_quantiles(table, [], value, quantile_grid(grid)).first()["q"]
    settled(spark.range(1))  # makes sure that a shared folder is set
    folder = f"{spark.sparkContext.getCheckpointDir()}/{tempfile.mktemp(prefix='stream-', dir='')}"
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", name).parquet(folder_in)
    out = drift_of(window_quantiles(stream, time, value, grid=grid, accuracy=accuracy), reference)
    run = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
