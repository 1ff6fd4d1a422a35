"""Resume-safe ingest: date batches, a log of what is done, and a store in which patches replace patches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patch_store, store


def read_log(spark: SparkSession, path: str, box: str | None = None) -> DataFrame:
    """obs_date (and the box) of what is done; empty where there is no log yet."""
    return store.read_index(spark, path, f"{box} long, obs_date date" if box else "obs_date date")


def ingest(observations: DataFrame, start: date, end: date, store_path: str, log_path: str, days: int = 7, variable: str = "variable", key: Sequence[str] = (), box: str | None = None, buckets: int = 16) -> int:
    """Stores the days of observations (variable, obs_date, key, ...) that the log lacks, in batches of so many days; returns the number of batches.

    key: what tells the patches of a day apart; without one, a day of a variable is replaced as a whole.  With ``box``, a column of whole numbers, each box has days of its own in the log, and a batch takes in only the boxes that lack its days; boxes that
    write patches of the same day leave each other's alone.  Only days (of a box) that were written are logged, so days whose data arrive later are ingested
    by a later run.

    The loop is over date ranges (metadata); each batch is one distributed job, whose source is read once.  A batch that fails is not in the log and runs again.
    """
    spark = observations.sparkSession
    own = [box] if box else []
    done = read_log(spark, log_path, box)
    every = F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("obs_date")
    lacking = (observations.select(box).distinct().select(box, every) if box else spark.range(1).select(every)).join(done, [*own, "obs_date"], "left_anti")
    lacking_days = [r[0] for r in lacking.select("obs_date").distinct().orderBy("obs_date").collect()]
    batches: list[tuple[date, date]] = []
    for d in lacking_days:
        if batches and (d - batches[-1][0]).days < days and (d - batches[-1][1]).days == 1:
            batches[-1] = (batches[-1][0], d)
        else:
            batches.append((d, d))
    for first, last in batches:
        mine = observations.where(F.col("obs_date").between(first, last)).join(read_log(spark, log_path, box), [*own, "obs_date"], "left_anti")
        staged = patch_store.upsert_patches(mine.select(observations.columns), store_path, key, (variable, "obs_date"), buckets)
        store.merge_index(staged.select(*own, "obs_date"), log_path)
    return len(batches)
