"""A store of patches or of dense variables: Parquet partitions, and beside them one small file with its schema and attributes.

The file says which columns, keys and partitions the store has; every read and write goes by it, so a column that only some
days have is null on the others, whichever file is read first.  It is written under another name and renamed over the old one, so a reader
sees the old or the new one.  Data files are plain Parquet and can be read without it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from ..workdir import work_path

FILE = "_store.json"
BUCKET = "cell_bucket"


# ---- the file ----------------------------------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def read_meta(spark: SparkSession, path: str) -> dict | None:
    """What the file of a store says; None where there is none."""
    at = _path(spark, f"{path}/{FILE}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_meta(spark: SparkSession, path: str, meta: Mapping) -> None:
    """Replaces the file of a store in one step."""
    conf, new, at = spark._jsc.hadoopConfiguration(), _path(spark, f"{path}/_{uuid.uuid4().hex}.tmp"), _path(spark, f"{path}/{FILE}")
    stream = new.getFileSystem(conf).create(new, True)
    try:
        stream.write(bytearray(json.dumps(meta, sort_keys=True, indent=1).encode()))
    finally:
        stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf).rename(new, at, over)


def schema_of(meta: Mapping) -> StructType:
    return StructType.fromJson(meta["schema"])


def _merged(old: StructType, new: StructType) -> StructType:
    """All columns of both; a column has one type."""
    have = {f.name: f for f in old}
    for f in new:
        if f.name in have and have[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} of the store is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType([StructField(f.name, f.dataType) for f in (*old, *(f for f in new if f.name not in have))])


def opened(spark: SparkSession, path: str, schema: StructType, key: Sequence[str], by: Sequence[str], buckets: int = 0, attrs: Mapping | None = None) -> dict:
    """The store's file, made or brought up to date: columns that are new are added, attributes that are there stay as they are.

    A store keeps its key and partitions; opening it with others is an error.
    """
    old = read_meta(spark, path)
    meta = {"schema": StructType([StructField(f.name, f.dataType) for f in schema]).jsonValue(), "key": list(key), "by": list(by), "buckets": buckets, "attrs": dict(attrs or {})}
    if old is not None:
        for name in ("key", "by", "buckets"):
            if old[name] != meta[name]:
                raise ValueError(f"the store's {name} is {old[name]}, not {meta[name]}")
        meta |= {"schema": _merged(schema_of(old), schema).jsonValue(), "attrs": dict(attrs or {}) | old["attrs"]}
    if meta != old:
        write_meta(spark, path, meta)
    return meta


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store with all its columns; columns that a partition lacks are null."""
    meta = read_meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no store at {path}")
    return _rows(spark, path, meta).select(schema_of(meta).names)


def _rows(spark: SparkSession, path: str, meta: Mapping) -> DataFrame:
    schema = schema_of(meta)
    return spark.read.schema(_bucketed(schema) if meta["buckets"] else schema).parquet(path)


def _bucketed(schema: StructType) -> StructType:
    return StructType([*schema, StructField(BUCKET, IntegerType())])


# ---- patches -----------------------------------------------------------------------------------------------------------


def upsert_patches(patches: DataFrame, path: str, key: Sequence[str] = ("grid_id",), by: Sequence[str] = ("variable", "obs_date"), buckets: int = 16, attrs: Mapping | None = None) -> DataFrame:
    """Patches replace those of the store with the same partition and key, and leave all others; returns the patches as they were staged.

    A partition (variable and day) is cut into buckets of cells, and only buckets that are touched are written anew.  The update is
    staged first, so it is computed once, and a run that breaks off can be repeated: the same patches give the same store.
    Several patches of one key in an update: an error, as none is the newest.  Without a key, whole partitions replace each other.
    """
    spark = patches.sparkSession
    meta = opened(spark, path, patches.schema, key, by, buckets, attrs)
    names = schema_of(meta).names
    at = work_path(spark, "staged")
    bucket = (F.pmod(F.xxhash64(*key), F.lit(buckets)) if key else F.lit(0)).cast("int").alias(BUCKET)
    patches.select("*", bucket).write.option("compression", "zstd").parquet(at)
    staged = spark.read.schema(_bucketed(patches.schema)).parquet(at)
    whole = [*by, *key]
    several = staged.groupBy(*whole).agg(F.count("*").alias("n")).where("n > 1").first() if key else None
    if several is not None:
        raise ValueError(f"the update has {several['n']} patches of {several.asDict()}")
    touched = staged.select(*by, BUCKET).distinct()
    old = _rows(spark, path, meta)
    for c in by:  # the partitions of an update are few: named here, only they are listed and read
        values = [r[0] for r in touched.select(c).distinct().collect()]
        old = old.where(F.col(c).isin([v for v in values if v is not None]) | (F.col(c).isNull() if None in values else F.lit(False)))
    same = lambda cols: [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in cols]
    left = old.alias("old").join(F.broadcast(touched).alias("new"), same([*by, BUCKET]), "left_semi")
    left = left.alias("old").join(staged.select(*whole).alias("new"), same(whole), "left_anti")
    out = left.unionByName(staged, allowMissingColumns=True).select(*names, BUCKET)
    out.repartition(*by, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by, BUCKET).parquet(path)
    return staged.drop(BUCKET)


# ---- dense variables -----------------------------------------------------------------------------------------------------


def write_variables(rows: DataFrame, path: str, time: str, key: Sequence[str], mode: str = "append", slices: int = 8, attrs: Mapping | None = None) -> None:
    """A dense store (time, key, one column for each variable), partitioned by time.

    overwrite: a new store.  append: times that are not there yet are added, those that are there stay as they are, also if they
    have fewer cells than rows.  variables: rows bring variables for some times and keys; their values replace those of the same variables at the times they
    touch (cells that rows lack become null there), and all other variables and times stay.
    """
    spark = rows.sparkSession
    if mode == "overwrite":
        rows.limit(0).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    meta = opened(spark, path, rows.schema, [time, *key], [time], 0, attrs)
    old, names = _rows(spark, path, meta), schema_of(meta).names
    if mode == "append":
        rows = rows.join(old.select(time).distinct(), time, "left_anti")
    elif mode == "variables":
        brought = [c for c in rows.columns if c not in (time, *key)]
        touched = rows.select(time).distinct()
        rows = old.drop(*brought).join(touched, time, "left_semi").join(rows, [time, *key], "full")
    elif mode != "overwrite":
        raise ValueError(f"unknown mode {mode}")
    for c in schema_of(meta):
        if c.name not in rows.columns:
            rows = rows.withColumn(c.name, F.lit(None).cast(c.dataType))
    out = rows.select(names).repartition(time, F.pmod(F.xxhash64(*key), F.lit(slices)))
    how = ("overwrite", "dynamic") if mode == "variables" else ("append", "static")
    out.write.mode(how[0]).option("partitionOverwriteMode", how[1]).option("compression", "zstd").partitionBy(time).parquet(path)


# ---- which days are processed ----------------------------------------------------------------------------------------


def stored_days(spark: SparkSession, path: str, by: Sequence[str] = ("variable", "obs_date")) -> DataFrame:
    """by and the newest modification time of each partition that has a file with rows; from paths and footers, no data column is read."""
    rows = read_store(spark, path).select(*by, F.col("_metadata.file_modification_time").alias("modified"))
    return rows.groupBy(*by).agg(F.max("modified").alias("modified"))


def _newest(spark: SparkSession, path: str) -> int | None:
    """The newest modification time below a path in milliseconds; None where there is nothing."""
    at = _path(spark, path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    newest, files = fs.getFileStatus(at).getModificationTime(), fs.listFiles(at, True)
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest


def processed_days(spark: SparkSession, store: str, index: str, box: str | None = None, wanted: Sequence | None = None, day: str = "obs_date") -> DataFrame:
    """The days (one column) that need not be processed again.

    With a box: the days in that box's own index (``index``/box_id=...), or none where it has no index yet; the shared store is not asked, as others write to it.
    Without: the index, if it is as new as the store, and covers the wanted days where they are given; else the store itself.
    """
    empty = spark.createDataFrame([], StructType([StructField(day, DateType())]))
    mine = f"{index}/box_id={box}" if box is not None else index
    written = _newest(spark, mine)
    have = spark.read.schema(empty.schema).parquet(mine).select(day).distinct() if written is not None else empty
    if box is not None:
        return have if wanted is None else have.where(F.col(day).isin(list(wanted)))
    there = _newest(spark, store)
    if written is not None and written >= (there or 0):
        if wanted is None:
            return have
        found = have.where(F.col(day).isin(list(wanted)))
        if found.count() == len(set(wanted)):
            return found
    if there is None:
        return empty
    days = stored_days(spark, store, (day,)).select(day)
    return days if wanted is None else days.where(F.col(day).isin(list(wanted)))


def days_of_names(files: DataFrame, path: str = "path", day: str = "obs_date") -> DataFrame:
    """The days in file names such as product_20240131.tif; other names have none."""
    found = F.regexp_extract(path, r"_(\d{8})\.tif$", 1)
    return files.select(F.to_date(F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyyMMdd"))).alias(day)).where(F.col(day).isNotNull()).distinct()
