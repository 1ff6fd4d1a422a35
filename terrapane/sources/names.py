"""Names of dimensions as different archives spell them."""

from __future__ import annotations

from pyspark.sql import DataFrame

ALIASES = {"valid_time": "time", "date": "time", "x": "lon", "longitude": "lon", "y": "lat", "latitude": "lat"}


def normalised_dimensions(rows: DataFrame) -> DataFrame:
    """time, lat and lon under these names, whatever the archive calls them."""
    return rows.withColumnsRenamed({c: ALIASES[c.lower()] for c in rows.columns if c.lower() in ALIASES})
