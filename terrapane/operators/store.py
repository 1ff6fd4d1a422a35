"""Patch-store bookkeeping: what is there, what is missing, what is newest."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import patch_store

#: A partition of the store is written by so many tasks, so a global day of a variable is not one task and one file.
SLICES = 8


def upsert(current: DataFrame, update: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of update replace rows of current with the same key; both have unique keys."""
    return current.join(update.select(*key), list(key), "left_anti").select(current.columns).unionByName(update.select(current.columns))


def keep_latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the (total) order, by one aggregation."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*key, "row.*").select(rows.columns)


def write_patches(patches: DataFrame, path: str, by: Sequence[str] = ("variable", "obs_date")) -> None:
    """Overwrites only the partitions that patches touches, so a batch can run again."""
    rest = [c for c in patches.columns if c not in by]
    patches.repartition(*by, F.pmod(F.xxhash64(*rest), F.lit(SLICES))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def complete_dates(patches: DataFrame, variables: Sequence[str], key: Sequence[str] = ("obs_date",), variable: str = "variable") -> DataFrame:
    """The keys (days, or days of a cell) that have every one of the variables."""
    found = patches.where(F.col(variable).isin(*variables)).groupBy(*key).agg(F.count_distinct(variable).alias("n"))
    return found.where(F.col("n") == len(set(variables))).select(*key)


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of an index of processed days; empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge_index(entries: DataFrame, path: str) -> None:
    """Adds the entries that the index lacks; a run that is repeated adds nothing."""
    new = entries.distinct()
    have = read_index(entries.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema))
    new.join(have, new.columns, "left_anti").write.mode("append").parquet(path)


def write_dense(rows: DataFrame, path: str, time: str, key: Sequence[str], mode: str = "append") -> None:
    """A dense store (time, key, one column for each variable), partitioned by time; see patch_store.write_variables."""
    patch_store.write_variables(rows, path, time, key, mode, SLICES)


def calendar(spark: SparkSession, start: date, end: date, day: str = "obs_date") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias(day))


def missing_ranges(wanted: DataFrame, done: DataFrame, key: Sequence[str], day: str = "obs_date") -> DataFrame:
    """For each key, the days of wanted that done lacks, as runs of consecutive days: key, start, end, n_days."""
    lack = wanted.select(*key, day).distinct().join(done.select(*key, day).distinct(), [*key, day], "left_anti")
    n = F.row_number().over(Window.partitionBy(*key).orderBy(day))
    return lack.withColumn("island", F.date_sub(F.col(day), n)).groupBy(*key, "island").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("n_days")).drop("island")


def day_batches(ranges: DataFrame, days: int) -> DataFrame:
    """Ranges (start, end) cut into runs of so many days, the last one shorter."""
    begin = F.explode(F.sequence("start", "end", F.expr(f"interval {days} days"))).alias("batch_start")
    return ranges.select("*", begin).withColumn("batch_end", F.least(F.date_add("batch_start", days - 1), F.col("end")))


def first_dates_and_cells(patches: DataFrame, samples: int) -> DataFrame:
    """The first cells, in order, of the first day of each variable."""
    first = patches.groupBy("variable").agg(F.min("obs_date").alias("obs_date"))
    rows = patches.join(first, ["variable", "obs_date"]).select("variable", "obs_date", "grid_id").distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("variable").orderBy("grid_id"))).where(F.col("n") <= samples)
