"""Dates of composites, file names and solar geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def previous_month(day: Column) -> Column:
    """The first day of the month before."""
    return F.add_months(F.trunc(day, "MM"), -1)


def thirty_day_month(day_of_year: Column) -> Column:
    """1..12 by thirty-day steps of the day of year (not calendar months)."""
    return (F.least(F.floor((day_of_year - 1) / 30), F.lit(11)) + 1).cast("int")


def day_number(day: Column) -> Column:
    """Days since 2000-01-01."""
    return F.datediff(day, F.lit("2000-01-01").cast("date"))


def normalised_date(text: Column) -> Column:
    """The date in the first ten characters."""
    return F.to_date(F.substring(text, 1, 10))


def cos_solar_zenith(lat: Column, lon: Column, day_of_year: Column, utc_hour: Column) -> Column:
    """Spencer's approximation: declination and equation of time from the day of year, hour angle from longitude."""
    b = F.radians(F.lit(360.0 / 365.0) * (day_of_year - 81))
    declination = F.radians(23.45 * F.sin(b))
    minutes = 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)
    hour_angle = F.radians(15.0 * (utc_hour + lon / 15.0 + minutes / 60.0 - 12.0))
    phi = F.radians(lat)
    return F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour_angle)
