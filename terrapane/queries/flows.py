"""Streams and resumable batches."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import patch_store, store
from ..plans.ingest import ingest
from ..streaming import daily
from ..workdir import work_path
from .registry import query, r6


@query("st01_stream_daily", "select user_id, cast(ts as date) as obs_date, round(max(value),6) as value, count(*) as n from events group by 1,2")
def st01(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fixtures.table(spark, sf_dir, "events").schema
    stream = daily.file_stream(spark, sf_dir, "events.parquet", schema)
    out = work_path(spark, "daily")
    daily.run_available(daily.daily_composites(stream, ["user_id"], "value"), daily.keep_updates(out), work_path(spark, "daily-checkpoint"))
    return daily.current(spark, out, ["user_id", "obs_date"]).select("user_id", "obs_date", r6(F.col("value")).alias("value"), "n")


@query("k18_batch_ingest", "select variable, obs_date, count(*) as n, round(sum(nir),6) as nir from f_obs where obs_date between date '2024-01-03' and date '2024-01-20' group by 1,2")
def k18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.obs(spark, sf_dir).select("obs_id", "variable", "obs_date", "nir")
    at, log = work_path(spark, "store"), work_path(spark, "log")
    ingest(rows, date(2024, 1, 3), date(2024, 1, 12), at, log, key=["obs_id"])
    ingest(rows, date(2024, 1, 3), date(2024, 1, 20), at, log, key=["obs_id"])  # resumes after the 12th
    return patch_store.read_store(spark, at).groupBy("variable", "obs_date").agg(F.count("*").alias("n"), r6(F.sum("nir")).alias("nir"))


@query("k18_box_ingest", "select box_id, obs_date, count(*) as n, round(sum(nir),6) as nir from (select pixel_id % 3 as box_id, * from f_obs) where obs_date between date '2024-01-03' and date '2024-01-16' and (box_id <> 2 or obs_date >= date '2024-01-09') group by 1,2")
def k18b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box 0 alone, then boxes 0 and 1, then a later span of all three: patches of a day that several boxes share are all kept."""
    rows = fixtures.obs(spark, sf_dir).select((F.col("pixel_id") % 3).alias("box_id"), "obs_id", "variable", "obs_date", "nir")
    at, log = work_path(spark, "store"), work_path(spark, "log")
    for boxes, first, last in (([0], 3, 8), ([0, 1], 3, 12), ([0, 1, 2], 9, 16)):
        ingest(rows.where(F.col("box_id").isin(boxes)), date(2024, 1, first), date(2024, 1, last), at, log, 5, key=["obs_id"], box="box_id")
    return patch_store.read_store(spark, at).groupBy("box_id", "obs_date").agg(F.count("*").alias("n"), r6(F.sum("nir")).alias("nir"))


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.obs(spark, sf_dir).select("variable", "obs_date", F.col("pixel_id").cast("string").alias("grid_id"), "nir")
    return rows.groupBy("variable", "obs_date", "grid_id").agg(F.sort_array(F.collect_list("nir")).alias("data"))


@query("k01_patch_store", "select event_type as variable, cast(ts as date) as obs_date, cast(user_id as varchar) as grid_id, count(*) as n, 512 as patch_size from events group by 1,2,3")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with attributes, made once and opened again; the attributes of the first time stay."""
    at = work_path(spark, "patches")
    for size in (512, 256):
        patch_store.upsert_patches(_patches(spark, sf_dir).where(F.col("variable").isin("click", "view") if size == 512 else F.lit(True)), at, attrs={"projection": "sinusoidal", "patch_size": size})
    size = patch_store.read_meta(spark, at)["attrs"]["patch_size"]
    return patch_store.read_store(spark, at).select("variable", "obs_date", "grid_id", F.size("data").cast("long").alias("n"), F.lit(size).alias("patch_size"))


_PATCH = "select variable, obs_date, cast(pixel_id as varchar) as grid_id, count(*) as n, round(sum(nir), 6) as total from f_obs group by 1,2,3"


@query("k02_store_upsert", f"select variable, obs_date, grid_id, n, case when cast(grid_id as int) % 2 = 1 and obs_date <= date '2024-01-15' then round(total + n, 6) else total end as total from ({_PATCH})")
def k02s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even cells, odd cells of the same days, odd cells of the first half again with other values, and that once more."""
    at, rows = work_path(spark, "patches"), _patches(spark, sf_dir)
    odd = F.col("grid_id").cast("int") % 2 == 1
    changed = rows.where(odd & (F.col("obs_date") <= "2024-01-15")).withColumn("data", F.transform("data", lambda v: v + 1))
    for update in (rows.where(~odd), rows.where(odd), changed, changed):
        patch_store.upsert_patches(update, at, buckets=4)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return patch_store.read_store(spark, at).select("variable", "obs_date", "grid_id", F.size("data").cast("long").alias("n"), r6(total).alias("total"))


@query("k04_dense_store", "select pixel_id, obs_date, round(max(nir),6) as nir, case when obs_date between date '2024-01-05' and date '2024-01-20' then round(max(red),6) end as red, case when obs_date >= date '2024-01-03' then max(qa)::double end as qa, case when obs_date = date '2024-01-03' then max(doy)::double end as doy from f_obs group by 1,2")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new store of some days, then the other days, then three further variables, each for part of the days."""
    rows = fixtures.obs(spark, sf_dir).groupBy("pixel_id", "obs_date").agg(*[F.max(c).cast("double").alias(c) for c in ("nir", "red", "qa", "doy")])
    at, day = work_path(spark, "dense"), F.col("obs_date")
    store.write_dense(rows.select("pixel_id", "obs_date", "nir").where(day < "2024-01-10"), at, "obs_date", ["pixel_id"], "overwrite")
    store.write_dense(rows.select("pixel_id", "obs_date", "nir"), at, "obs_date", ["pixel_id"])
    for name, mine in (("red", day.between("2024-01-05", "2024-01-20")), ("qa", day >= "2024-01-03"), ("doy", day == "2024-01-03")):
        store.write_dense(rows.where(mine).select("pixel_id", "obs_date", name), at, "obs_date", ["pixel_id"], "variables")
    return patch_store.read_store(spark, at).select("pixel_id", "obs_date", r6(F.col("nir")).alias("nir"), r6(F.col("red")).alias("red"), "qa", "doy")


def _indexed(spark: SparkSession, sf_dir: str, index_first: bool) -> tuple[str, str, DataFrame]:
    """A store of all patches and an index of its first half, in either order."""
    at, index, rows = work_path(spark, "patches"), work_path(spark, "index"), _patches(spark, sf_dir)
    half = rows.where("obs_date <= date '2024-01-15'").select("obs_date").distinct()
    for step in (1, 2):
        if (step == 1) == index_first:
            half.write.parquet(index)
        else:
            patch_store.upsert_patches(rows, at)
    return at, index, rows


@query("k06_stored_days", "select distinct variable, obs_date from f_obs")
def k06s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by the store's own partitions, without reading data."""
    return patch_store.stored_days(spark, _indexed(spark, sf_dir, True)[0]).select("variable", "obs_date")


@query("k06_fresh_index", "select distinct obs_date from f_obs where obs_date <= date '2024-01-15'")
def k06f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is newer than the store, so it is believed."""
    at, index, _ = _indexed(spark, sf_dir, False)
    return patch_store.processed_days(spark, at, index)


@query("k06_stale_index", "select distinct obs_date from f_obs where obs_date <= date '2024-01-20'")
def k06t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is older than the store, so the store is asked for the wanted days."""
    at, index, _ = _indexed(spark, sf_dir, True)
    return patch_store.processed_days(spark, at, index, wanted=[date(2024, 1, d) for d in range(1, 21)])


@query("k06_box_days", "select distinct pixel_id % 3 as box_id, obs_date from f_obs where pixel_id % 3 < 2 and (pixel_id % 3 = 0 or obs_date <= date '2024-01-10')")
def k06b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes 0 and 1 have an index each, box 2 has none: nothing of it counts as done, whatever the shared store holds."""
    at, index, _ = _indexed(spark, sf_dir, True)
    rows = fixtures.obs(spark, sf_dir).select((F.col("pixel_id") % 3).alias("box_id"), "obs_date").distinct()
    rows.where("box_id = 0 or box_id = 1 and obs_date <= date '2024-01-10'").write.mode("append").partitionBy("box_id").parquet(f"{index}-boxes")
    days = [patch_store.processed_days(spark, at, f"{index}-boxes", box=str(b)).select(F.lit(b).cast("long").alias("box_id"), "obs_date") for b in range(3)]
    return days[0].unionByName(days[1]).unionByName(days[2])
