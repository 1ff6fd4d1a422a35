"""Facts that the functions are pinned to, on small arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapane.functions import bands, bits, geo, names

C = F.col


def column(spark, values, kind, expr):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(expr).collect()]


def pairs(spark, red, nir, expr):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(red, nir, strict=True))]
    return [r[0] for r in spark.createDataFrame(rows, "i int, red double, nir double").orderBy("i").select(expr).collect()]


def test_index_known_values(spark):
    got = pairs(spark, [0.1, 0.2, 0.0, None], [0.3, 0.2, 0.0, 0.1], bands.ndvi(red=C("red"), nir=C("nir")))
    assert got[0] == pytest.approx(0.5) and got[1] == 0.0 and got[2] is None and got[3] is None


def test_index_is_near_infrared_minus_red(spark):
    assert pairs(spark, [0.1], [0.4], bands.ndvi(red=C("red"), nir=C("nir")))[0] > 0


def test_fill_is_masked(spark):
    got = pairs(spark, [-0.2, 0.1], [0.3, 0.3], bands.clipped_ndvi(red=C("red"), nir=C("nir")))
    assert got[0] is None and got[1] == pytest.approx(0.5)


def test_clip_keeps_null(spark):
    assert column(spark, [None, 5.0, -5.0, 0.2], "double", bands.clip(C("x"), -1.0, 1.0)) == [None, 1.0, -1.0, 0.2]


def test_level_decoding_and_fill(spark):
    assert column(spark, [0, 1, 2, 3, 99], "int", bits.level_cloud(C("x"))) == [True, True, False, False, False]
    assert column(spark, [0, 1, 2, 3, 99], "int", bits.level_cloud_or_fill(C("x"))) == [True, True, False, False, True]


def test_high_quality_bits_stay_exact(spark):
    assert column(spark, [2049, 65535], "int", bits.bit_field(C("x"), 0, 16)) == [2049, 65535]


def test_state_algorithms_against_integers(spark):
    words = list(range(0, 65536, 97))
    by = {
        "cloud_state": lambda w: w & 3 in (1, 2), "cloud_only": lambda w: w & 3 == 1, "binned": lambda w: w & 3 in (2, 3), "internal": lambda w: w >> 10 & 1 == 1,
        "strict": lambda w: w & 3 in (1, 2) or w >> 2 & 1 == 1 or w >> 6 & 3 >= 2 or w >> 8 & 1 == 1 or w >> 10 & 1 == 1,
    }
    for algorithm, f in by.items():
        assert column(spark, words, "int", bits.state_cloud(C("x"), algorithm)) == [f(w) for w in words]
    with pytest.raises(ValueError):
        bits.state_cloud(C("x"), "other")


def test_pixel_sizes():
    assert [geo.pixel_size(n) for n in (250, 500, 1000, 30)] == [1111950 / 4800, 1111950 / 2400, 1111950 / 1200, 30.0]


def test_sinusoidal_origin_and_first_tile(spark):
    row = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    assert tuple(row.select(*geo.sinusoidal(C("lat"), C("lon"))).first()) == (0.0, 0.0)
    assert tuple(row.select(*geo.tile_origin(F.lit(0), F.lit(0))).first()) == (-20015109.0, 10007555.0)


def test_tiles_floor_below_the_edge(spark):
    row = spark.range(1).select(*geo.tile_of(F.lit(-20015109.0 - 1), F.lit(10007555.0 + 1))).first()
    assert tuple(row) == (-1, -1)


def test_azimuthal_inverse_keeps_distance_and_direction(spark):
    df = spark.createDataFrame([(10.0, 20.0, 0.0, 64000.0), (10.0, 20.0, 0.0, 0.0), (0.0, 179.9, 50000.0, 0.0), (-90.0, 0.0, 0.0, 1000.0)], "lat0 double, lon0 double, x double, y double")
    north, same, east, pole = (tuple(r) for r in geo.unprojected(df, "azimuthal", C("x"), C("y")).select("lat", "lon").collect())
    assert north == pytest.approx((10.578611, 20.0), abs=1e-6) and same == pytest.approx((10.0, 20.0))  # 64 km of WGS84; the sphere has 10.575565
    assert east == pytest.approx((0.0, 179.9 + 50000 / 6378137 / 3.141592653589793 * 180)) and pole[0] == pytest.approx(-89.991047, abs=1e-5)


FLINDERS, BUNINYONG = (-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600), (-(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600)


def test_published_geodesic_and_utm_points(spark):
    """The worked examples of the Geocentric Datum of Australia's technical manual, to a millimetre."""
    import math

    df = spark.createDataFrame([(*FLINDERS, *BUNINYONG)], "lat1 double, lon1 double, lat2 double, lon2 double")
    out = geo.with_geodesic(df, C("lat1"), C("lon1"), C("lat2"), C("lon2"))
    out = geo.with_geodesic_end(out, C("lat1"), C("lon1"), C("azimuth"), C("metres"))
    out = geo.with_utm(geo.with_utm(out, C("lat1"), C("lon1"), F.lit(32755)), C("lat2"), C("lon2"), F.lit(32755), "x2", "y2")
    r = out.first()
    assert r["metres"] == pytest.approx(54972.271, abs=1e-3) and math.degrees(r["azimuth"]) % 360 == pytest.approx(306 + 52 / 60 + 5.37 / 3600, abs=2e-6)
    assert (r["lat"], r["lon"]) == pytest.approx(BUNINYONG, abs=1e-9)
    assert (r["x"], r["y"]) == pytest.approx((273741.297, 5796489.777), abs=1e-3) and (r["x2"], r["y2"]) == pytest.approx((228854.052, 5828259.038), abs=1e-3)


def test_utm_round_trip_in_every_zone_and_hemisphere(spark):
    points = spark.createDataFrame([(lat, -180.0 + 6 * z + east) for z in range(60) for lat in (-79.9, -33.0, -0.001, 0.001, 47.0, 83.9) for east in (0.01, 3.0, 5.99)], "p double, q double")
    back = geo.with_utm_inverse(geo.with_utm(points.withColumn("epsg", geo.utm_epsg(C("p"), C("q"))), C("p"), C("q"), C("epsg")), C("x"), C("y"), C("epsg"))
    r = back.agg(F.max(F.abs(C("p") - C("lat"))), F.max(F.abs(C("q") - C("lon"))), F.min("x"), F.max("x"), F.count_distinct("epsg")).first()
    assert r[0] < 1e-10 and r[1] < 1e-10 and r[2] > 166000 and r[3] < 834000 and r[4] == 120


def test_geodesics_end_where_they_lead(spark):
    rows = [(lat, lon, a / 7, 10.0**e) for lat in (-89.0, -45.0, 0.0, 30.0, 80.0) for lon in (-180.0, 0.0, 179.0) for a in range(0, 44, 3) for e in (0, 3, 5, 6, 7)]
    df = spark.createDataFrame(rows, "lat0 double, lon0 double, a double, s double")
    there = geo.with_geodesic(geo.with_geodesic_end(df, C("lat0"), C("lon0"), C("a"), C("s")), C("lat0"), C("lon0"), C("lat"), C("lon"), steps=8)
    r = there.agg(F.max(F.abs(C("metres") - C("s"))), F.max(F.when(C("lat0") > -89, F.abs(F.sin((C("azimuth") - C("a")) / 2)) * C("s")))).first()
    assert r[0] < 1e-3 and r[1] < 1e-3


def test_grid_of_cells_is_a_partition(spark):
    points = [(lat, lon) for lat in (-90.0, -89.99, -60.5, -0.0001, 0.0, 33.3, 89.99, 90.0) for lon in (-180.0, -179.999, -90.2, -1e-9, 0.0, 77.7, 179.999, 180.0)]
    for km in (100.0, 437.0, 5000.0):
        n = geo.grid_rows(km)
        df = spark.createDataFrame(points, "lat double, lon double")
        row, col = geo.grid_indices_of(C("lat"), C("lon"), km)
        got = df.select("lat", "lon", row.alias("row"), col.alias("col")).select("*", geo.grid_columns(C("row"), km).alias("m"), geo.grid_name(C("row"), C("col")).alias("name"))
        got = got.select("*", *[c.alias(a) for c, a in zip((*geo.grid_indices(C("name")), *geo.grid_point(C("row"), C("col"), km)), ("r2", "c2", "south", "west"), strict=True)]).collect()
        for r in got:
            assert (r["row"], r["col"]) == (r["r2"], r["c2"]) and -(n // 2) <= r["row"] < n - n // 2 and -(r["m"] // 2) <= r["col"] < r["m"] - r["m"] // 2
            south_gap = r["row"] == -(n // 2) and r["lat"] < r["south"]
            assert south_gap or r["lat"] == 90 or r["south"] <= r["lat"] + 1e-9 < r["south"] + 180 / n + 1e-6
            assert 0 <= (r["lon"] - r["west"] + 1e-9) % 360 < 360 / r["m"] + 1e-6
    assert column(spark, ["12D_34L", "x", "7U_0R", "7U_0R_1"], "string", geo.grid_indices(C("x"))[0]) == [-12, None, 7, None]


def test_grid_ids_without_numbers_are_null(spark):
    assert column(spark, ["12D_34L", "x_5L", "7U"], "string", geo.grid_row_col(C("x"))[0]) == [12, None, 7]
    assert column(spark, ["12D_34L", "x_5L", "7U"], "string", geo.grid_row_col(C("x"))[1]) == [34, 5, None]


def test_swath_names_that_do_not_fit_are_null(spark):
    got = column(spark, ["MYD35_L2.A2024060.1005.061.2024061000000.hdf", "junk"], "string", names.swath_name(C("x"))["geolocation"])
    assert got == ["MYD03", None]


def test_soft_score_bounds(spark):
    rows = [(i, lv, m, b) for i, (lv, m, b) in enumerate((lv, m, b) for lv in (0, 3, 99) for m in (True, False) for b in (-1.0, 0.1, 2.0))]
    got = [r[0] for r in spark.createDataFrame(rows, "i int, lv int, m boolean, b double").orderBy("i").select(bands.soft_score(C("lv"), C("m"), C("b"))).collect()]
    assert all(v is None or -1e-12 <= v <= 1 + 1e-12 for v in got) and got[-1] is None
    assert max(v for v in got if v is not None) == pytest.approx(1.0)


def test_solar_noon_at_the_equator(spark):
    from terrapane.functions.calendar import cos_solar_zenith

    v = spark.range(1).select(cos_solar_zenith(F.lit(0.0), F.lit(0.0), F.lit(81), F.lit(12.0))).first()[0]
    assert v > 0.999 and math.isfinite(v)
    assert np.isclose(v, np.cos(np.radians(15 * (-7.53 / 60))), atol=1e-6)


def test_every_cell_of_the_grid_has_its_own_point(spark):
    km = 400.0
    n = geo.grid_rows(km)
    rows = spark.range(-(n // 2), n - n // 2).withColumn("m", geo.grid_columns(C("id"), km))
    cells = rows.select(C("id").alias("row"), F.explode(F.sequence(-F.floor(C("m") / 2), C("m") - F.floor(C("m") / 2) - 1)).alias("col"))
    lat, lon = geo.grid_point(C("row"), C("col"), km)
    back = geo.grid_indices_of(C("lat"), C("lon"), km)
    found = cells.select("row", "col", lat.alias("lat"), lon.alias("lon")).select("row", "col", back[0].alias("r"), back[1].alias("c"))
    assert found.where("r <> row or c <> col").count() == 0 and found.count() > 3000
