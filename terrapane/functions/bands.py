"""Band arithmetic and calibration as Columns; invalid values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILL_BELOW = -0.05


def ndvi(*, red: Column, nir: Column) -> Column:
    """(nir - red) / (nir + red); null where the sum is zero."""
    return F.try_divide(nir - red, nir + red)


def valid(x: Column, below: float = FILL_BELOW) -> Column:
    return F.when(x >= below, x)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clipped_ndvi(*, red: Column, nir: Column) -> Column:
    return clip(ndvi(red=valid(red), nir=valid(nir)), -1.0, 1.0)


def intraday_ndvi(*, red: Column, nir: Column) -> Column:
    """Null unless the sum exceeds 0.01."""
    return F.when(nir + red > 0.01, (nir - red) / F.when(nir + red > 0.01, nir + red))


def calibrated_band(family: Column, raw: Column, fill: Column, scale: Column, offset: Column) -> Column:
    """By family: reflectance, leaf (raw above 100 is special), monthly_index (fixed scale), else the raw word."""
    x = F.when(raw != fill, raw)
    return F.when(family == "reflectance", x * scale + offset).when(family == "leaf", F.when(x <= 100, x) * scale + offset).when(family == "monthly_index", F.when((x != -3000) & (x >= -2000), x) * 0.0001).otherwise(raw)


def calibrated_product(product: Column, raw: Column, is_integer: Column) -> Column:
    """By product: surface temperature to Celsius, vegetation index, night lights (integer or float files), their quality flag."""
    return (
        F.when(product == "temperature", F.when(raw > 0, raw * 0.02 - 273.15))
        .when(product == "index", F.when(raw != -3000, raw * 0.0001))
        .when(product == "lights", F.when(is_integer, F.when(raw != 65535, raw * 0.1)).otherwise(F.when(raw > -900, raw)))
        .when(product == "lights_quality", F.when(raw == 255, F.lit(0.0)).otherwise(raw))
        .otherwise(raw)
    )


def soft_score(level: Column, reference_cloud: Column, blue: Column) -> Column:
    """Confidence of clearness in 0..1 from the four-level flag, a binary mask (after the veto) and blue reflectance; a fill level gives null."""
    score = F.when(level <= 3, level / 3.0)
    return 0.5 * score + 0.3 * F.when(reference_cloud, 0.0).otherwise(1.0) + 0.2 * (1.0 - clip(blue, 0.0, 0.3) / 0.3)


def disagreement_veto(one: Column, two: Column, blue: Column) -> tuple[Column, Column]:
    """Both masks, set where they disagree under bright blue (above 0.15)."""
    veto = (one != two) & (blue > 0.15)
    return one | veto, two | veto


def normalised(channel: Column, x: Column) -> Column:
    """Channels 0 and 1: (x - 0.5) / 0.5; channel 2: clipped to -1..1, null as -1."""
    return F.when(channel.isin(0, 1), (x - 0.5) / 0.5).otherwise(F.coalesce(clip(x, -1.0, 1.0), F.lit(-1.0)))


def denormalised(channel: Column, x: Column) -> Column:
    return F.when(channel.isin(0, 1), x * 0.5 + 0.5).otherwise(x)


def monthly_prior(x: Column) -> Column:
    """A previous month's index: null as 0, else clipped to -0.2..1."""
    return F.coalesce(clip(x, -0.2, 1.0), F.lit(0.0))


def gap_mask(forward: Column, backward: Column, threshold: float) -> Column:
    """0 where both gaps reach the threshold (an unknown gap is endless), else 1."""
    end = F.lit(1e18)
    return F.when((F.coalesce(forward, end) >= threshold) & (F.coalesce(backward, end) >= threshold), 0).otherwise(1)
