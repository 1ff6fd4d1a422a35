"""Where intermediate tables go, and small helpers that the text operators have in common."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset in local mode (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="terrapane-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: the lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrapane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of ``saved``; all tables made of it must have been saved before."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


MOST_CLASHES = 10_000


def clashes(mine: DataFrame, classes: DataFrame) -> dict[tuple[int, int], int]:
    """(class, check) -> new class, for texts whose first digests clash: about n * n / 2**65 of n classes, so one in 10**10 documents.

    mine: class, check of each row; classes: the least (low) and greatest (high) check of each class.
    """
    several = classes.where("low <> high").select("class")
    rows = mine.join(F.broadcast(several), "class").select("class", "check").distinct().limit(MOST_CLASHES + 1).collect() if not several.isEmpty() else []
    if len(rows) > MOST_CLASHES:
        raise ValueError("more clashes than digests of 64 bits can have")
    return {(c, h): int(mix(np.array([c ^ h], np.int64).view(np.uint64)).view(np.int64)[0]) for c, h in rows}


def renamed_classes(mine: DataFrame, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """mine with the new names of the classes that clash."""
    new = mine.sparkSession.createDataFrame([(c, h, x) for (c, h), x in renamed.items()], "class long, check long, new long")
    return mine.join(F.broadcast(new), ["class", "check"], "left").withColumn("class", F.coalesce("new", "class")).drop("new")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that are used, under fixed names: id (long), text (null: empty) and ``more``; other columns cannot clash."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    return df.select(*cols, *[F.col(f"`{c}`").alias(c) for c in more])
