"""GeoTIFF data source: files of other layouts, round trips, filters, failures."""

import datetime as dt
import io
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapane.sources import tiff


def image(raw):
    return tiff.Tiff(pa.PythonFile(io.BytesIO(raw), mode="r"))


def assembled(raw):
    t = image(raw)
    out = np.zeros((t.samples, t.height, t.width), t.dtype.newbyteorder("="))
    for band, r, c, values in t.tiles():
        out[band, r : r + values.shape[0], c : c + values.shape[1]] = values
    return out


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (256, 256), (300, 517)])
def test_round_trip_of_every_type(dtype, shape):
    rng = np.random.default_rng(2)
    kind = np.dtype(dtype)
    make = lambda: rng.normal(size=shape).astype(kind) if kind.kind == "f" else rng.integers(np.iinfo(kind).min, np.iinfo(kind).max, shape, kind, endpoint=True)
    bands = [make(), make()]
    if kind.kind == "f":
        bands[0][0, 0] = np.nan
    raw = tiff.encoded(bands, ["a & <b>", "é"], 100.0, 50.0, 0.25, 0.5, 4326, nodata=-1.0)
    t = image(raw)
    assert t.names == {0: "a & <b>", 1: "é"} and t.epsg == 4326 and t.corner() == (100.0, 50.0, 0.25, 0.5) and t.predictor == (3 if kind.kind == "f" else 2)
    np.testing.assert_array_equal(assembled(raw), np.array(bands))
    assert image(tiff.encoded(bands, ["a", "b"], 0.0, 0.0, 1.0, 1.0, 32632)).epsg == 32632


def built(order, values, strip_rows, compression, predictor, planar, big):
    """A strip TIFF of (height, width, samples) written by hand."""
    height, width, n = values.shape
    kind = values.dtype.newbyteorder(order)
    planes = [values] if planar == 1 else [values[:, :, s : s + 1] for s in range(n)]
    strips = []
    for plane in planes:
        for r in range(0, height, strip_rows):
            part = plane[r : r + strip_rows].astype(kind)
            if predictor == 2:
                part[:, 1:] = part[:, 1:] - plane[r : r + strip_rows, :-1].astype(kind)
            body = part.tobytes()
            strips.append(zlib.compress(body) if compression != 1 else body)
    at = 16 if big else 8
    offsets = [at + sum(map(len, strips[:i])) for i in range(len(strips))]
    end = at + sum(map(len, strips))
    code = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    fields = [(256, "H", [width]), (257, "H", [height]), (258, "H", [kind.itemsize * 8] * n), (259, "H", [compression]), (273, "I", offsets), (277, "H", [n]), (278, "H", [strip_rows]), (279, "I", [len(s) for s in strips]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [code] * n)]
    entry, room, count, far = (20, 8, "Q", "Q") if big else (12, 4, "I", "I")
    more_at, table, more = end + (8 if big else 2) + entry * len(fields) + (8 if big else 4), b"", b""
    for tag, c, v in fields:
        raw = struct.pack(f"{order}{len(v)}{c}", *v)
        held = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + far, more_at + len(more))
        more += raw if len(raw) > room else b""
        table += struct.pack(order + "HH" + count, tag, {"H": 3, "I": 4}[c], len(v)) + held
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, end) if big else struct.pack(order + "HI", 42, end))
    return head + b"".join(strips) + struct.pack(order + ("Q" if big else "H"), len(fields)) + table + b"\0" * (8 if big else 4) + more


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 8, 32946])
@pytest.mark.parametrize(("predictor", "planar", "big"), [(1, 1, False), (2, 1, False), (2, 2, True), (1, 2, True)])
def test_strips_of_other_writers(order, compression, predictor, planar, big):
    values = np.random.default_rng(4).integers(0, 60_000, (11, 7, 3), np.uint16)
    np.testing.assert_array_equal(assembled(built(order, values, 4, compression, predictor, planar, big)), values.transpose(2, 0, 1))


def test_what_is_not_supported_is_an_error():
    values = np.zeros((2, 2, 1), np.uint8)
    for raw in (b"GIF89a" + b"\0" * 20, b"II" + b"\0" * 20, built("<", values, 2, 5, 1, 1, False), built("<", values, 2, 8, 9, 1, False)):
        with pytest.raises(ValueError, match=r"not a TIFF|not supported"):
            image(raw)


ROWS = [("a", dt.date(2024, 1, 1), 2, 3, [[1.0, 2.0, None, 4.0, 5.0, 6.0]], "float32", None), ("a", dt.date(2024, 1, 2), 1, 1, [[7.0]], "float64", None), ("b", None, 1, 2, [[None, -5.0]], "int16", -9999.0)]


def frame(spark, rows):
    made = [(n, d, h, w, 10.0, 20.0, 1.0, 1.0, 6933, t, nodata, ["v"] * len(b), b) for n, d, h, w, b, t, nodata in rows]
    return spark.createDataFrame(made, tiff.WRITE_SCHEMA)


def test_source_round_trip_and_filters(spark, tmp_path):
    tiff.register(spark)
    path = str(tmp_path / "t")
    frame(spark, ROWS).write.format("geotiff").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["a_20240101.tif", "a_20240102.tif", "b.tif"]
    df = spark.read.format("geotiff").load(path)
    got = {os.path.basename(r["path"]): r for r in df.collect()}
    assert np.isnan(got["a_20240101.tif"]["data"][2]) and got["b.tif"]["data"] == [-9999.0, -5.0] and got["b.tif"]["nodata"] == -9999.0 and got["b.tif"]["obs_date"] is None
    assert (got["a_20240101.tif"]["height"], got["a_20240101.tif"]["width"], got["a_20240101.tif"]["west"], got["a_20240101.tif"]["epsg"]) == (2, 3, 10.0, 6933)
    late = df.where(F.col("obs_date") > dt.date(2024, 1, 1))
    assert late.rdd.getNumPartitions() == 1 and [r["data"] for r in late.collect()] == [[7.0]]
    assert df.where("obs_date is null").count() == 1
    assert spark.read.format("geotiff").load(f"{path}/b.tif").count() == 1


def test_overwrite_replaces_the_folder_s_rasters(spark, tmp_path):
    tiff.register(spark)
    path = str(tmp_path / "t")
    frame(spark, ROWS).write.format("geotiff").mode("append").save(path)
    frame(spark, ROWS[1:2]).write.format("geotiff").mode("overwrite").save(path)
    assert os.listdir(path) == ["a_20240102.tif"]


@pytest.mark.parametrize("bad", [("c", None, 2, 2, [[1.0]], "float32", None), ("c", None, 1, 1, [[None]], "int16", None), ("../c", None, 1, 1, [[1.0]], "int16", None), ("a", dt.date(2024, 1, 1), 1, 1, [[1.0]], "int16", None)])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    tiff.register(spark)
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match=r"not 2 x 2|nodata|not a file name|one name"):
        frame(spark, [*ROWS, bad]).repartition(3).write.format("geotiff").mode("append").save(path)
    assert os.listdir(path) == []


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    tiff.register(spark)
    assert spark.read.format("geotiff").load(str(tmp_path)).count() == 0


def test_rasters_of_a_collection(spark):
    """Missing pixels and nulls are nodata, images outside the dates and boxes without pixels are left out, an odd width is cut unevenly."""
    from terrapane.plans.export import rasters

    day = dt.date(2024, 1, 1)
    pixels = spark.createDataFrame([(1, day, 360 + r, 720 + c, None if (r, c) == (0, 0) else float(10 * r + c)) for r in range(2) for c in range(5) if (r, c) != (1, 4)] + [(2, dt.date(2024, 2, 1), 360, 720, 1.0)], "image int, obs_date date, row int, col int, v double")
    regions = spark.createDataFrame([("a", 0.0, -0.5, 1.25, 0.0), ("b", 50.0, 50.0, 51.0, 51.0), ("c", 0.01, -0.02, 0.02, -0.01)], "region string, lon_min double, lat_min double, lon_max double, lat_max double")
    got = {r["name"]: r for r in rasters(pixels, regions, day, dt.date(2024, 2, 1), {"v": lambda v: v + 1}, 0.25, (2, 1)).collect()}
    assert set(got) == {"1-a-0", "1-a-1"}
    assert (got["1-a-0"]["width"], got["1-a-1"]["width"], got["1-a-1"]["height"]) == (2, 3, 2) and got["1-a-1"]["west"] == 0.5 and got["1-a-0"]["north"] == 0.0
    assert got["1-a-0"]["bands"] == [[None, 2.0, 11.0, 12.0]] and got["1-a-1"]["bands"] == [[3.0, 4.0, 5.0, 13.0, 14.0, None]] and got["1-a-0"]["nodata"] == -9999.0
