"""The patch store and the dense store: schema file, upserts, variables, boxes, processed days."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from terrapane.operators import patch_store
from terrapane.plans.ingest import ingest

DAY = lambda n: dt.date(2024, 1, n)
SCHEMA = "variable string, obs_date date, grid_id string, v int"


def patches(spark, *rows):
    return spark.createDataFrame([(v, DAY(d), g, x) for v, d, g, x in rows], SCHEMA)


def content(spark, path):
    return sorted((r["variable"], r["obs_date"].day, r["grid_id"], r["v"]) for r in patch_store.read_store(spark, path).collect())


def test_two_regions_of_one_day_and_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    a, b = patches(spark, ("x", 1, "a", 1), ("x", 2, "a", 2)), patches(spark, ("x", 1, "b", 3), ("y", 1, "a", 4))
    for batch in (a, b, b):
        patch_store.upsert_patches(batch, path, buckets=2)
    assert content(spark, path) == [("x", 1, "a", 1), ("x", 1, "b", 3), ("x", 2, "a", 2), ("y", 1, "a", 4)]
    patch_store.upsert_patches(patches(spark, ("x", 1, "a", 9)), path, buckets=2)
    assert ("x", 1, "a", 9) in content(spark, path) and len(content(spark, path)) == 4
    with pytest.raises(ValueError, match="2 patches"):
        patch_store.upsert_patches(patches(spark, ("x", 1, "a", 1), ("x", 1, "a", 2)), path, buckets=2)
    with pytest.raises(ValueError, match="buckets"):
        patch_store.upsert_patches(a, path, buckets=3)


def test_only_touched_buckets_are_written_anew(spark, tmp_path):
    path = str(tmp_path / "s")
    patch_store.upsert_patches(patches(spark, *[("x", d, f"g{i}", i) for d in (1, 2) for i in range(40)]), path, buckets=4)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    patch_store.upsert_patches(patches(spark, ("x", 1, "g7", 100)), path, buckets=4)
    gone, new = before - files(), files() - before
    assert len(gone) == len(new) == 1 and os.path.dirname(min(gone)) == os.path.dirname(min(new))
    assert len(content(spark, path)) == 80


def test_nulls_and_empty_updates(spark, tmp_path):
    path = str(tmp_path / "s")
    patch_store.upsert_patches(patches(spark, ("x", 1, "a", 1)).withColumn("grid_id", F.lit(None).cast("string")), path)
    patch_store.upsert_patches(patches(spark, ("x", 1, "b", 2)).withColumn("variable", F.lit(None).cast("string")), path)
    patch_store.upsert_patches(patches(spark, ("x", 1, "b", 3)).where("false"), path)
    patch_store.upsert_patches(patches(spark, ("x", 1, "a", 5)).withColumn("grid_id", F.lit(None).cast("string")), path)
    got = {(r["variable"], r["grid_id"], r["v"]) for r in patch_store.read_store(spark, path).collect()}
    assert got == {("x", None, 5), (None, "b", 2)}


def test_attributes_stay_and_columns_are_added(spark, tmp_path):
    path = str(tmp_path / "s")
    patch_store.upsert_patches(patches(spark, ("x", 1, "a", 1)), path, attrs={"projection": "sinusoidal"})
    patch_store.upsert_patches(patches(spark, ("x", 2, "a", 2)).withColumn("quality", F.lit(0.5)), path, attrs={"projection": "other", "step": 250})
    assert patch_store.read_meta(spark, path)["attrs"] == {"projection": "sinusoidal", "step": 250}
    rows = {r["obs_date"].day: r["quality"] for r in patch_store.read_store(spark, path).collect()}
    assert rows == {1: None, 2: 0.5}
    with pytest.raises(ValueError, match="is int, not string"):
        patch_store.upsert_patches(patches(spark, ("x", 1, "a", 1)).withColumn("v", F.lit("s")), path)
    assert not [f for f in os.listdir(path) if f.endswith(".tmp")]
    with pytest.raises(FileNotFoundError):
        patch_store.read_store(spark, str(tmp_path / "none"))


def test_variables_on_different_days_all_survive(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = lambda name, *cells: spark.createDataFrame([(DAY(d), k, v) for d, k, v in cells], f"time date, k int, {name} double")
    write = lambda df, mode: patch_store.write_variables(df, path, "time", ["k"], mode)
    write(rows("nir", (1, 0, 0.1), (2, 0, 0.2), (3, 0, 0.3)), "overwrite")
    write(rows("red", (3, 0, 30.0)), "variables")
    write(rows("blue", (3, 0, 3.0), (1, 1, 1.0)), "variables")
    write(rows("red", (2, 0, 20.0)), "variables")
    write(rows("nir", (3, 0, 9.9), (4, 0, 0.4)), "append")
    got = sorted((r["time"].day, r["k"], r["nir"], r["red"], r["blue"]) for r in patch_store.read_store(spark, path).collect())
    assert got == [(1, 0, 0.1, None, None), (1, 1, None, None, 1.0), (2, 0, 0.2, 20.0, None), (3, 0, 0.3, 30.0, 3.0), (4, 0, 0.4, None, None)]
    write(rows("nir", (5, 0, 0.5)), "overwrite")
    assert [(r["time"].day, r["nir"]) for r in patch_store.read_store(spark, path).collect()] == [(5, 0.5)]
    with pytest.raises(ValueError, match="unknown mode"):
        write(rows("nir", (5, 0, 0.5)), "merge")


def test_boxes_have_days_of_their_own(spark, tmp_path):
    where = str(tmp_path / "store"), str(tmp_path / "log")
    rows = spark.createDataFrame([(b, "x", DAY(d), f"{b}-{i}", d) for b in (0, 1) for d in range(1, 7) for i in range(2)], f"box_id long, {SCHEMA}")
    run = lambda df, a, b: ingest(df, DAY(a), DAY(b), *where, days=2, key=["grid_id"], box="box_id")
    assert run(rows.where("box_id = 0"), 1, 4) == 2
    assert run(rows, 1, 4) == 2  # box 1 alone
    assert run(rows, 1, 4) == 0
    assert run(rows, 1, 6) == 1
    assert len(content(spark, where[0])) == 24
    assert spark.read.parquet(where[1]).count() == spark.read.parquet(where[1]).distinct().count() == 12


def test_processed_days_by_index_store_and_box(spark, tmp_path):
    store, index = str(tmp_path / "s"), str(tmp_path / "i")
    days = lambda df: sorted(r["obs_date"].day for r in df.collect())
    half = spark.createDataFrame([(DAY(1),)], "obs_date date")
    assert days(patch_store.processed_days(spark, store, index)) == []
    patch_store.upsert_patches(patches(spark, ("x", 1, "a", 1), ("x", 2, "a", 1)), store)
    assert days(patch_store.processed_days(spark, store, index)) == [1, 2]  # no index: the store
    time.sleep(1.1)
    half.write.parquet(index)
    assert days(patch_store.processed_days(spark, store, index)) == [1]  # a fresh index
    assert days(patch_store.processed_days(spark, store, index, wanted=[DAY(1)])) == [1]
    assert days(patch_store.processed_days(spark, store, index, wanted=[DAY(1), DAY(2), DAY(9)])) == [1, 2]  # which does not cover what is wanted
    time.sleep(1.1)
    patch_store.upsert_patches(patches(spark, ("x", 3, "a", 1)), store)
    assert days(patch_store.processed_days(spark, store, index)) == [1, 2, 3]  # a stale one
    assert days(patch_store.processed_days(spark, store, index, box="7")) == []
    half.write.parquet(f"{index}/box_id=7")
    assert days(patch_store.processed_days(spark, store, index, box="7")) == [1]
    assert days(patch_store.processed_days(spark, store, index, box="8")) == []


def test_stored_days_read_no_data_column(spark, tmp_path):
    path = str(tmp_path / "s")
    patch_store.upsert_patches(patches(spark, ("x", 1, "a", 1), ("y", 2, "a", 1)), path)
    df = patch_store.stored_days(spark, path)
    assert "ReadSchema: struct<>" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["variable"], r["obs_date"].day) for r in df.collect()) == [("x", 1), ("y", 2)]


def test_days_of_file_names(spark):
    names = [("file:/a/MOD09_20240131.tif",), ("file:/a/MOD09_20241331.tif",), ("file:/a/x.tif",), ("file:/a/20240131.tif",), (None,), ("file:/b/MOD09_20240131.tif",)]
    assert [r["obs_date"] for r in patch_store.days_of_names(spark.createDataFrame(names, "path string")).collect()] == [dt.date(2024, 1, 31)]


def test_compacted_updates_have_the_same_state(spark, tmp_path):
    from terrapane.streaming import daily

    path, sink = str(tmp_path / "u"), daily.keep_updates(str(tmp_path / "u"))
    state = lambda: sorted(tuple(r) for r in daily.current(spark, path, ["k"]).select("k", "v").collect())
    for n, rows in enumerate([[(1, 10), (2, 20)], [(1, 11)], [(3, 30)], [(2, 22), (1, 12)]]):
        sink(spark.createDataFrame(rows, "k int, v int"), n)
    before = state()
    daily.compact(spark, path, ["k"])
    assert state() == before == [(1, 12), (2, 22), (3, 30)] and sorted(d for d in os.listdir(path) if d.startswith("batch")) == ["batch_id=2", "batch_id=3"]
    sink(spark.createDataFrame([(1, 13)], "k int, v int"), 3)  # the newest batch runs again, with other rows
    assert state() == [(1, 13), (2, 20), (3, 30)]
    daily.compact(spark, path, ["k"])
    sink(spark.createDataFrame([(4, 40)], "k int, v int"), 4)
    daily.compact(spark, path, ["k"])
    assert state() == [(1, 13), (2, 20), (3, 30), (4, 40)] and len(os.listdir(path)) < 5
