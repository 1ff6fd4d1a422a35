"""File and region names as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(name: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def granule_date(name: Column) -> Column:
    return F.to_date(_part(name, r"\.A(\d{7})\."), "yyyyDDD")


def granule_tile(name: Column) -> tuple[Column, Column]:
    return _part(name, r"\.h(\d{2})v").cast("int"), _part(name, r"\.h\d{2}v(\d{2})").cast("int")


def swath_name(name: Column) -> dict[str, Column]:
    """product, date, time, collection, production and the short name of the geolocation granule; nulls if the name does not fit."""
    pattern = r"^(M[OY]D\w+)\.A(\d{7})\.(\d{4})\.(\d{3})\.(\d{13})\.hdf$"
    product = _part(name, pattern, 1)
    return {
        "product": product,
        "obs_date": F.to_date(_part(name, pattern, 2), "yyyyDDD"),
        "obs_time": _part(name, pattern, 3),
        "collection": _part(name, pattern, 4),
        "production": _part(name, pattern, 5),
        "geolocation": F.when(product.startswith("MOD"), "MOD03").when(product.startswith("MYD"), "MYD03"),
    }


def path_part(path: Column, n: int) -> Column:
    return F.get(F.split(path, "/"), n)


def region_key(country: Column, district: Column) -> Column:
    return F.concat_ws("_", F.initcap(country), F.initcap(district))
