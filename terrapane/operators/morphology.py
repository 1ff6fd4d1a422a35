"""Binary morphology and nearest-neighbour scaling on pixel tables (key columns, r, c)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands


def _as_sets(true: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """key, places: each raster's true pixels as r * size + c, so that the squares are taken inside a row; a raster is one row, pixels are shuffled once."""
    place = F.col("r").cast("int") * size + F.col("c").cast("int")
    return true.groupBy(*key).agg(F.collect_set(place).alias("places"))


def _as_pixels(sets: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    rows = sets.select(*key, F.explode("places").alias("place_"))
    return rows.select(*key, F.floor(F.col("place_") / size).cast("int").alias("r"), (F.col("place_") % size).cast("int").alias("c"))


def _grown(places: Column, size: int, reach: int) -> Column:
    """The places within a square of 2 * reach + 1 of some place, inside the raster: along columns, then along rows."""
    c = lambda p: p % size
    r = lambda p: F.floor(p / size).cast("int")
    low, high = lambda at: F.least(F.lit(reach), at), lambda at: F.least(F.lit(reach), size - 1 - at)
    wide = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p - low(c(p)), p + high(c(p))))))
    return F.array_distinct(F.flatten(F.transform(wide, lambda p: F.sequence(p - low(r(p)) * size, p + high(r(p)) * size, F.lit(size)))))


def _shrunk(places: Column, size: int, reach: int) -> Column:
    """The places whose whole square is true: those that no false place, nor the outside of the raster, is near to."""
    whole = F.sequence(F.lit(0), F.lit(size * size - 1))
    inner = F.filter(whole, lambda p: (p % size).between(reach, size - 1 - reach) & F.floor(p / size).between(reach, size - 1 - reach))
    return F.array_except(inner, _grown(F.array_except(whole, places), size, reach))


def dilated(true: DataFrame, key: Sequence[str], size: int, reach: int = 2) -> DataFrame:
    """The true pixels (inside a size x size raster) after dilation by a square of 2 * reach + 1."""
    return _as_pixels(_as_sets(true, key, size).select(*key, _grown(F.col("places"), size, reach).alias("places")), key, size)


def eroded(true: DataFrame, key: Sequence[str], size: int, reach: int = 2) -> DataFrame:
    """The pixels whose whole square is true; outside the raster counts as false."""
    return _as_pixels(_as_sets(true, key, size).select(*key, _shrunk(F.col("places"), size, reach).alias("places")), key, size)


def closed(true: DataFrame, key: Sequence[str], size: int, reach: int = 2) -> DataFrame:
    sets = _as_sets(true, key, size).select(*key, _shrunk(_grown(F.col("places"), size, reach), size, reach).alias("places"))
    return _as_pixels(sets, key, size)


def upsampled(pixels: DataFrame, factor: int, crop: int | None = None) -> DataFrame:
    """Each pixel as factor x factor pixels; rows and columns from crop on are cut off."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(factor) for j in range(factor)])).alias("step_")
    rest = [c for c in pixels.columns if c not in ("r", "c")]
    out = pixels.select(*rest, "r", "c", steps).select(*rest, (F.col("r") * factor + F.col("step_.i")).alias("r"), (F.col("c") * factor + F.col("step_.j")).alias("c"))
    return out.where(f"r < {crop} and c < {crop}") if crop is not None else out


def flipped(pixels: DataFrame, size: int) -> DataFrame:
    """The first row becomes the last."""
    return pixels.withColumn("r", F.lit(size - 1) - F.col("r"))


def grown_and_closed(pixels: DataFrame, key: Sequence[str], flag: Column, name: str, reach: int = 2) -> DataFrame:
    """pixels with a flag's mask, dilated by a square of 2 * reach + 1 and then closed by it; every pixel of a raster must be a row.

    Squares are taken axis by axis by windows over rows that stay what they are: two dilations are one of twice the reach, and outside the raster counts
    as false in the erosion.  Dealt by key once, sorted three times.
    """
    at = lambda axis, other, n: Window.partitionBy(*key, other).orderBy(axis).rangeBetween(-n, n)
    out = pixels.repartition(*key).withColumn(name, F.max(flag.cast("int")).over(at("c", "r", 2 * reach)))
    out = out.withColumn(name, F.max(name).over(at("r", "c", 2 * reach)))
    for axis, other in (("r", "c"), ("c", "r")):
        out = out.withColumn(name, (F.sum(name).over(at(axis, other, reach)) == 2 * reach + 1).cast("int"))
    return out.withColumn(name, F.col(name) == 1)


def fused_cloud(pixels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cloud fusion: pixels (key, r, c, reference: bool, level, blue), every pixel of a raster a row, to cloud, soft_score, meta.

    The masks are reconciled by the blue veto, dilated and united, and closed; the score uses the reconciled reference mask.
    """
    one, two = bands.disagreement_veto(F.col("reference"), F.coalesce(F.col("level") <= 1, F.lit(False)), F.col("blue"))
    rows = pixels.withColumn("one", one).withColumn("two", two)
    scored = grown_and_closed(rows, key, F.coalesce(F.col("one") | F.col("two"), F.lit(False)), "cloud").withColumn("soft_score", bands.soft_score(F.col("level"), F.col("one"), F.col("blue")))
    return scored.select(*key, "r", "c", "cloud", "soft_score", F.when(F.col("cloud"), 0.0).otherwise(F.col("soft_score")).alias("meta"))
