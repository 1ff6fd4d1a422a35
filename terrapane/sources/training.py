"""Sources of training samples: each gives a catalog (grid, date) and pixels, and a sample joins them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, bits
from ..functions.calendar import previous_month


class Source(Protocol):
    """What a source offers: the (grid_id, obs_date) it has, or None if it has no limits; and its pixels."""

    def catalog(self) -> DataFrame | None: ...

    def pixels(self) -> DataFrame: ...


def constrained(keys: DataFrame, available: DataFrame | None) -> DataFrame:
    """The keys that are available; None (a static source) constrains nothing."""
    return keys if available is None else keys.join(available, available.columns, "left_semi")


def available_to_all(keys: DataFrame, sources: Sequence[Source]) -> DataFrame:
    for s in sources:
        keys = constrained(keys, s.catalog())
    return keys


def lookback(rows: DataFrame, key: str, end: str, days: int, value: str) -> DataFrame:
    """The last ``days`` days up to end for every key, missing days as 0."""
    last = F.lit(end).cast("date")
    spine = rows.select(key).distinct().select(key, F.explode(F.sequence(F.date_sub(last, days - 1), last, F.expr("interval 1 day"))).alias("obs_date"))
    return spine.join(rows.where(F.col("obs_date").between(F.date_sub(last, days - 1), last)), [key, "obs_date"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def raw_source(rows: DataFrame) -> DataFrame:
    """Observed index, the envelope (the same) and the soft weight from a state word: columns pixel key, red, nir, qa."""
    index = bands.clipped_ndvi(red=F.col("red"), nir=F.col("nir"))
    return rows.withColumn("observed", index).withColumn("envelope", index).withColumn("soft", (bits.bit_field(F.col("qa"), 0, 2) == 0).cast("double"))


def processed_source(observed: DataFrame, envelope: DataFrame, gaps: DataFrame, key: Sequence[str], threshold: float) -> DataFrame:
    """Observed values with their envelope; the soft weight is 0 inside long gaps or where the envelope is missing."""
    rows = observed.join(envelope, list(key), "left").join(gaps, list(key), "left")
    open_ = bands.gap_mask(F.col("gap_forward"), F.col("gap_back"), threshold)
    return rows.withColumn("soft", F.when(F.col("z").isNull(), 0.0).otherwise(open_.cast("double"))).drop("gap_forward", "gap_back")


def processed_patch_source(observed: DataFrame, coarse: DataFrame, key: Sequence[str], threshold: float, factor: int = 2) -> DataFrame:
    """``processed_source`` for patches: observed (key, r, c, observed) has pixels ``factor`` times as fine as coarse (key, r, c, z, gap_back, gap_forward).

    A fine pixel takes the values of the coarse one that it is in, by a join on the coarse place; nothing is upsampled first.
    """
    near = observed.withColumns({"r_": F.floor(F.col("r") / factor).cast("int"), "c_": F.floor(F.col("c") / factor).cast("int")})
    open_ = bands.gap_mask(F.col("gap_forward"), F.col("gap_back"), threshold)
    place = coarse.select(*key, F.col("r").cast("int").alias("r_"), F.col("c").cast("int").alias("c_"), "z", open_.cast("double").alias("open_"))
    rows = near.join(place, [*key, "r_", "c_"], "left")
    return rows.select(*key, "r", "c", "observed", F.col("z").alias("envelope"), F.when(F.col("z").isNull(), 0.0).otherwise(F.col("open_")).alias("soft"))


def previous_month_source(days: DataFrame, monthly: DataFrame, key: str) -> DataFrame:
    """For each day, the composite of the month before: key, obs_date, prior; missing as 0."""
    wanted = days.withColumn("month", previous_month(F.col("obs_date")))
    return wanted.join(monthly.select(key, "month", F.col("ndvi").alias("prior")), [key, "month"], "left").select(key, "obs_date", bands.monthly_prior(F.col("prior")).alias("prior"))


def previous_month_mean(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``previous_month_source`` for composites that are means of the same rows (key, obs_date, value): key, obs_date, prior.

    A window over the month before, so rows are shuffled once, by key, and composites are not joined back.
    """
    month = (F.year("obs_date") * 12 + F.month("obs_date")).alias("month_")
    before = Window.partitionBy(key).orderBy("month_").rangeBetween(-1, -1)
    return rows.select(key, "obs_date", F.col(value).alias("value_"), month).select(key, "obs_date", bands.monthly_prior(F.avg("value_").over(before)).alias("prior"))


def sparse_leaf_source(days: DataFrame, leaf: DataFrame, key: Sequence[str]) -> DataFrame:
    """Leaf-area values where there are any (else 0), with weight 0 for missing or bad ones."""
    rows = days.join(leaf, list(key), "left")
    return rows.select(*key, F.coalesce("lai", F.lit(0.0)).alias("lai"), F.when(F.coalesce(bits.leaf_bad(F.col("qc")), F.lit(True)) | F.col("lai").isNull(), 0.0).otherwise(1.0).alias("weight"))


def land_cover_source(cells: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """The class of each cell, 0 where there is none."""
    return cells.join(classes, key, "left").withColumn("lc_class", F.coalesce("lc_class", F.lit(0)))


def synchronous_samples(pairs: DataFrame, composites: DataFrame, patches: DataFrame) -> DataFrame:
    """One row for each (grid_id, obs_date): the composite and the patch as arrays in row-major order."""
    packed = lambda df, name: df.groupBy("grid_id", "obs_date").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "c", "v"))), lambda p: p["v"]).alias(name))
    return pairs.join(packed(composites, "composite"), ["grid_id", "obs_date"], "left").join(packed(patches, "patch"), ["grid_id", "obs_date"], "left")
