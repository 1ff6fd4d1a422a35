"""A training source over any table of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


class TableSource:
    """Rows of a table; keys name the columns that say where and when there is data (None: everywhere, always)."""

    def __init__(self, rows: DataFrame, keys: Sequence[str] | None):
        self.rows, self.keys = rows, keys

    def catalog(self) -> DataFrame | None:
        return self.rows.select(*self.keys).distinct() if self.keys else None

    def pixels(self) -> DataFrame:
        return self.rows
