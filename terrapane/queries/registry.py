"""Query name -> function, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with SQL (fixtures named in it are put in front) if SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = fixtures.sql(sql)
        return f

    return put


def projection(name: str, fixture: str, key: str, columns: Callable[[], dict], sql: str) -> None:
    """A query that computes columns over a fixture; sql: the select list for the same."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(fixtures, fixture)(spark, sf_dir).select(key, *[c.alias(n) for n, c in columns().items()])

    query(name, f"select {key}, {sql} from f_{fixture}")(run)


def r6(c):
    return F.round(c, 6)
