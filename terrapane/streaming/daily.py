"""Incremental flows: daily composites of a stream, and batches that are stored once however often they run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import store


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """The Parquet files of a folder whose names match, as a stream; new files are new batches."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_composites(stream: DataFrame, key: Sequence[str], value: str, late: str = "2 days") -> DataFrame:
    """The largest value of each key and day of event time, and the number of observations; rows later than ``late`` are left out.

    ts must be a timestamp with time zone: watermarks reject the other kind.
    """
    day = F.window("ts", "1 day").alias("day")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(*key, day).agg(F.max(value).alias(value), F.count("*").alias("n")).select(*key, F.col("day.start").cast("date").alias("obs_date"), value, "n")


def keep_updates(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of the keys that a batch changed, one partition a batch, so a batch that runs again changes nothing."""

    def write(batch: DataFrame, n: int) -> None:
        store.write_patches(batch.withColumn("batch_id", F.lit(n)), path, ("batch_id",))

    return write


def compact(spark: SparkSession, path: str, key: Sequence[str]) -> None:
    """Merges the updates of all batches but the newest into one partition, the last but one, so that updates don't pile up.

    The newest batch is left as it is, as it is the only one that may run again.  Older partitions go after the merged one is written; if that is
    cut short, they hold only states that the merged one has as new or newer, so ``current`` stays the same.
    """
    batches = sorted(r[0] for r in spark.read.parquet(path).select("batch_id").distinct().collect())
    if len(batches) < 3:
        return
    old = spark.read.parquet(path).where(F.col("batch_id") <= batches[-2])
    store.write_patches(store.keep_latest(old, key, ["batch_id"]).withColumn("batch_id", F.lit(batches[-2])), path, ("batch_id",))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for n in batches[:-2]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"batch_id={n}"), True)


def current(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The last state of each key in the updates."""
    return store.keep_latest(spark.read.parquet(path), key, ["batch_id"]).drop("batch_id")


def run_available(result: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Processes what is there now and stops; the checkpoint remembers what has been done.  In update mode, state older than the watermark is dropped."""
    query = result.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
