"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import columns, composition, files, flows, relational, spatial, timeline  # noqa: F401
from .queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a04_monthly_ndvi"](spark, sf_dir)
