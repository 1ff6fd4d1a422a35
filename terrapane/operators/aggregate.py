"""Composites, cloud statistics, noise models and availability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.calendar import thirty_day_month


def clean_tiles(scores: DataFrame, most_cloud: float = 0.3) -> DataFrame:
    """grid_id, obs_date, cloud_fraction, t, month of the tiles with at most so much cloud; scores below 0.5 are cloud, null is clear.  t counts a grid's days from 0."""
    day = scores.groupBy("grid_id", "obs_date").agg(F.avg(F.coalesce((F.col("score") < 0.5).cast("int"), F.lit(0))).alias("cloud_fraction"))
    t = F.row_number().over(Window.partitionBy("grid_id").orderBy("obs_date")) - 1
    return day.withColumn("t", t).withColumn("month", F.month("obs_date")).where(F.col("cloud_fraction") <= most_cloud)


def month_summary(fractions: DataFrame, most_cloud: float = 0.3) -> DataFrame:
    """month, total, passing, rejected, reject_percent."""
    ok = F.count_if(F.col("cloud_fraction") <= most_cloud)
    return fractions.groupBy("month").agg(F.count("*").alias("total"), ok.alias("passing"), (F.count("*") - ok).alias("rejected"), (100.0 * (F.count("*") - ok) / F.count("*")).alias("reject_percent"))


def max_composite(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The largest value of each key, nulls left out."""
    return rows.groupBy(*key).agg(F.max(value).alias(value))


def ndvi_composite(red: DataFrame, nir: DataFrame, pixel: Sequence[str]) -> DataFrame:
    """Daily maximum vegetation index over the times that both bands have: red and nir are (pixel, ts, value)."""
    both = red.select(*pixel, "ts", F.col("value").alias("red")).join(nir.select(*pixel, "ts", F.col("value").alias("nir")), [*pixel, "ts"])
    index = both.withColumn("ndvi", bands.intraday_ndvi(red=F.col("red"), nir=F.col("nir")))
    return index.groupBy(*pixel, F.col("ts").cast("date").alias("obs_date")).agg(F.max("ndvi").alias("ndvi"), F.count("*").alias("n_times"))


def _quantile(ordered: Column, q: float) -> Column:
    """The linearly interpolated quantile of a sorted array without nulls."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    first = F.get(ordered, low)
    return first + (F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) - first) * (at - low)


def reliability(rows: DataFrame, key: Sequence[str], index: str, band: str, slots: int = 5) -> DataFrame:
    """key, ndvi_p75, ndvi_std, flagged: the share of slots further than 3 median deviations from the band's median.

    Each key has ``slots`` slots at least; those without an observation, and nulls, count as zeros in all three.  One shuffle, then arrays.
    """
    lists = rows.groupBy(*key).agg(*(F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(n) for c, n in ((index, "index_"), (band, "band_"))))
    pad = lambda c: F.array_sort(F.concat(c, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), slots - F.size(c)))))
    full = lists.withColumn("index_", pad(F.col("index_"))).withColumn("band_", pad(F.col("band_"))).withColumn("mid", _quantile(F.col("band_"), 0.5))
    off = full.withColumn("off", F.array_sort(F.transform("band_", lambda x: F.abs(x - F.col("mid")))))
    odd = F.size(F.filter("off", lambda x: x / (F.col("mad") + 1e-6) > 3)) / F.size("off")
    mean = F.aggregate("index_", F.lit(0.0), lambda t, x: t + x) / F.size("index_")
    square = F.aggregate("index_", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("index_")
    return off.withColumn("mad", _quantile(F.col("off"), 0.5)).withColumn("mean", mean).select(*key, _quantile(F.col("index_"), 0.75).alias("ndvi_p75"), F.sqrt(square).alias("ndvi_std"), odd.alias("flagged"))


def month_noise(rows: DataFrame, most: float = 0.1) -> DataFrame:
    """pixel_id, month, sigma, n: population deviation of residuals in (0, most], times sqrt(pi / 2); 0.001 where there are fewer than two."""
    use = F.when((F.col("residual") > 0) & (F.col("residual") <= most), F.col("residual"))
    return rows.groupBy("pixel_id", thirty_day_month(F.col("doy")).alias("month")).agg((F.when(F.count(use) > 1, F.stddev_pop(use)).otherwise(0.001) * 1.2533141373155001).alias("sigma"), F.count(use).alias("n"))


def yearly_presence(rows: DataFrame, countries: Sequence[str], level: str) -> DataFrame:
    """year by country, 1 where there are records of the level, else 0, over all years of the table."""
    years = rows.select("year").distinct()
    flag = rows.where((F.col("s_res") == level) & F.col("country").isin(*countries)).groupBy("year").pivot("country", list(countries)).agg((F.count(F.lit(1)) > 0).cast("int"))
    return years.join(flag, "year", "left").select("year", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in countries])


def raster_metadata(pixels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Height, width, bounds and value range of rasters."""
    return pixels.groupBy(*key).agg((F.max("r") - F.min("r") + 1).alias("height"), (F.max("c") - F.min("c") + 1).alias("width"), F.count_distinct("r").alias("n_rows"), F.min("v").alias("low"), F.max("v").alias("high"))


def raster_geometry(pixels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Width, height, pixel size and outer bounds of rasters of pixel centres (key, x, y); one column or row has no size, and bounds of null."""
    size = lambda c: (F.max(c) - F.min(c)) / F.nullif(F.count_distinct(c) - 1, F.lit(0))
    out = pixels.groupBy(*key).agg(F.count_distinct("x").alias("width"), F.count_distinct("y").alias("height"), size("x").alias("pixel_size_x"), size("y").alias("pixel_size_y"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    half = lambda c: F.col(f"pixel_size_{c}") / 2
    return out.select(*key, "width", "height", "pixel_size_x", "pixel_size_y", (F.col("x0") - half("x")).alias("west"), (F.col("y0") - half("y")).alias("south"), (F.col("x1") + half("x")).alias("east"), (F.col("y1") + half("y")).alias("north"))
