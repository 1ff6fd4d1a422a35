"""Projections: quality bits, calibration, dates, geometry and names."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import bands, bits, calendar, geo, names
from .registry import projection, query, r6

C = F.col

projection("p01_ndvi", "obs", "obs_id", lambda: {"ndvi": r6(bands.ndvi(red=C("red"), nir=C("nir")))}, "round((nir-red)/nullif(nir+red,0),6) as ndvi")
projection("p02_valid_reflectance", "obs", "obs_id", lambda: {"red_ok": r6(bands.valid(C("red"))), "nir_ok": r6(bands.valid(C("nir")))}, "round(case when red >= -0.05 then red end,6) as red_ok, round(case when nir >= -0.05 then nir end,6) as nir_ok")
projection(
    "p03_clipped_ndvi", "obs", "obs_id", lambda: {"ndvi": r6(bands.clipped_ndvi(red=C("red"), nir=C("nir")))},
    "round(case when red >= -0.05 and nir >= -0.05 and nir+red <> 0 then greatest(-1.0, least(1.0, (nir-red)/(nir+red))) end,6) as ndvi",
)
projection("p04_intraday_ndvi", "obs", "obs_id", lambda: {"ndvi": r6(bands.intraday_ndvi(red=C("red"), nir=C("nir")))}, "round(case when nir+red > 0.01 then (nir-red)/(nir+red) end,6) as ndvi")
projection("p05_bits", "obs", "obs_id", lambda: {"f2": bits.bit_field(C("qa"), 2, 4), "f10": bits.bit_field(C("qa"), 10, 1)}, "(qa >> 2) & 15 as f2, (qa >> 10) & 1 as f10")
projection("p06_qc_reflectance", "obs", "obs_id", lambda: {"bad": bits.reflectance_bad(C("qa"))}, "not ((qa & 3) = 0 and ((qa >> 2) & 3) = 0 and ((qa >> 4) & 3) = 0) as bad")
_STATE = {
    "strict": "(qa & 3) in (1,2) or ((qa >> 2) & 1) = 1 or ((qa >> 6) & 3) >= 2 or ((qa >> 8) & 1) = 1 or ((qa >> 10) & 1) = 1", "cloud_state": "(qa & 3) in (1,2)",
    "cloud_only": "(qa & 3) = 1", "binned": "(qa & 3) in (2,3)", "internal": "((qa >> 10) & 1) = 1",
}
for _a in bits.STATE_ALGORITHMS:
    projection(f"p07_state_mask_{_a}", "obs", "obs_id", lambda a=_a: {"cloud": bits.state_cloud(C("qa"), a)}, f"{_STATE[_a]} as cloud")
projection("p08_state_variants", "obs", "obs_id", lambda: {"cloud": bits.state_cloud(C("qa"), "cloud_state"), "internal": bits.bit_field(C("qa"), 10, 1) != 0}, "(qa & 3) in (1,2) as cloud, (qa & 1024) <> 0 as internal")
projection("p09_level_decode", "obs", "obs_id", lambda: {"cloud": bits.level_cloud(C("cloud_level"))}, "cloud_level <> 99 and cloud_level < 2 as cloud")
projection("p10_level_mask_strict_fill", "obs", "obs_id", lambda: {"cloud": bits.level_cloud_or_fill(C("cloud_level"))}, "cloud_level < 2 or cloud_level = 99 as cloud")
projection("p11_swath_level", "obs", "obs_id", lambda: {"level": bits.swath_level(C("qa") % 256), "clear": bits.swath_level(C("qa") % 256) >= 2}, "((qa % 256) >> 1) & 3 as level, (((qa % 256) >> 1) & 3) >= 2 as clear")
def _band():
    return F.when(C("obs_id") % 4 == 0, "qc").when(C("obs_id") % 4 == 1, "state").when(C("obs_id") % 4 == 2, "cloud_mask").otherwise("blue")
projection(
    "p12_decode_by_band", "obs", "obs_id", lambda: {"bad": bits.decoded(_band(), F.when(C("obs_id") % 4 == 2, C("cloud_level")).otherwise(C("qa")))},
    f"case obs_id % 4 when 0 then (qa & 63) <> 0 when 1 then {_STATE['strict']} when 2 then cloud_level <> 99 and cloud_level < 2 end as bad",
)
projection("p13_keep_only", "obs", "obs_id", lambda: {"qc": bits.keep_reflectance(C("qa")), "state": bits.keep_state(C("qa"))}, "case when (qa & 63) = 0 then qa end as qc, case when (qa & 5631) = 72 then qa end as state")
projection("p14_lai_qc", "obs", "obs_id", lambda: {"bad": bits.leaf_bad(C("qa")), "weight": F.when(bits.leaf_bad(C("qa")) | C("red").isNull(), 0.0).otherwise(1.0)}, "(qa & 1) <> 0 or ((qa >> 4) & 3) <> 0 as bad, cast(case when (qa & 1) <> 0 or ((qa >> 4) & 3) <> 0 or red is null then 0 else 1 end as double) as weight")
projection("p21_normalise", "obs", "obs_id", lambda: {"x": r6(bands.normalised((C("obs_id") % 3).cast("int"), bands.ndvi(red=C("red"), nir=C("nir"))))}, "round(case when obs_id % 3 in (0,1) then ((nir-red)/nullif(nir+red,0) - 0.5)/0.5 else coalesce(case when nir+red <> 0 then greatest(-1.0, least(1.0, (nir-red)/(nir+red))) end, -1.0) end,6) as x")
projection("p22_prev_month", "series", "pixel_id", lambda: {"obs_date": C("obs_date"), "previous": calendar.previous_month(C("obs_date"))}, "obs_date, cast(date_trunc('month', obs_date) - interval 1 month as date) as previous")
projection("p25_month", "series", "pixel_id", lambda: {"obs_date": C("obs_date"), "month": calendar.thirty_day_month(C("doy"))}, "obs_date, cast(least(floor((doy-1)/30), 11) + 1 as int) as month")
projection("p31_date_normalise", "granules", "obs_id", lambda: {"day": calendar.normalised_date(F.concat(F.lit("2024-0"), (C("obs_id") % 9 + 1).cast("string"), F.lit("-15T10:00:00")))}, "cast(substr(concat('2024-0', cast(obs_id % 9 + 1 as string), '-15T10:00:00'), 1, 10) as date) as day")
projection("p32_cell_centre", "cells", "cell_id", lambda: {"lat_c": r6(geo.cell_centre(C("cell_id") % 200, C("cell_id") % 400)[0]), "lon_c": r6(geo.cell_centre(C("cell_id") % 200, C("cell_id") % 400)[1])}, "round(90.0 - cast(0.9 as double) * (cell_id % 200),6) as lat_c, round(-180.0 + cast(0.9 as double) * (cell_id % 400),6) as lon_c")


@query(
    "p15_band_calibration",
    """select obs_id, family, round(case family when 'reflectance' then case when raw <> 77 then raw * cast(0.01 as double) + 0.5 end
 when 'leaf' then case when raw <> 255 and raw <= 100 then raw * cast(0.1 as double) end when 'monthly_index' then case when raw <> -3000 and raw >= -2000 then raw * cast(0.0001 as double) end else raw end, 6) as value
 from (select obs_id, case obs_id % 4 when 0 then 'reflectance' when 1 then 'leaf' when 2 then 'monthly_index' else 'quality' end as family, cast(case when obs_id % 4 = 2 then (obs_id * 37) % 13000 - 3001 else (obs_id * 37) % 256 end as double) as raw from f_obs)""",
)
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame([("reflectance", 77.0, 0.01, 0.5), ("leaf", 255.0, 0.1, 0.0), ("monthly_index", -3000.0, 1.0, 0.0), ("quality", -1.0, 1.0, 0.0)], "family string, fill double, scale double, offset double")
    n = C("obs_id")
    family = F.when(n % 4 == 0, "reflectance").when(n % 4 == 1, "leaf").when(n % 4 == 2, "monthly_index").otherwise("quality")
    raw = F.when(n % 4 == 2, (n * 37) % 13000 - 3001).otherwise((n * 37) % 256).cast("double")
    rows = fixtures.obs(spark, sf_dir).select("obs_id", family.alias("family"), raw.alias("raw")).join(F.broadcast(dim), "family")
    return rows.select("obs_id", "family", r6(bands.calibrated_band(C("family"), C("raw"), C("fill"), C("scale"), C("offset"))).alias("value"))


@query(
    "p16_product_calibration",
    """select obs_id, round(case obs_id % 4 when 0 then case when raw > 0 then raw * cast(0.02 as double) - 273.15 end when 1 then case when raw <> -3000 then raw * cast(0.0001 as double) end
 when 2 then case when qa % 2 = 0 then case when raw <> 65535 then raw * cast(0.1 as double) end else case when raw > -900 then raw end end else case when qa % 256 = 255 then 0.0 else cast(qa % 256 as double) end end, 6) as value
 from (select obs_id, qa, cast(case when obs_id % 7 = 0 then 65535 when obs_id % 7 = 1 then -3000 when obs_id % 7 = 2 then 0 else qa end as double) as raw from f_obs)""",
)
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C("obs_id")
    raw = F.when(n % 7 == 0, 65535).when(n % 7 == 1, -3000).when(n % 7 == 2, 0).otherwise(C("qa")).cast("double")
    product = F.when(n % 4 == 0, "temperature").when(n % 4 == 1, "index").when(n % 4 == 2, "lights").otherwise("lights_quality")
    value = bands.calibrated_product(product, F.when(n % 4 == 3, (C("qa") % 256).cast("double")).otherwise(raw), C("qa") % 2 == 0)
    return fixtures.obs(spark, sf_dir).select("obs_id", r6(value).alias("value"))


projection("p17_quality_gate", "obs", "obs_id", lambda: {"celsius": r6(F.when(C("cloud_level") == 0, C("nir") * 0.02 - 273.15)), "index": r6(F.when(bits.bit_field(C("qa"), 0, 2) == 0, bands.ndvi(red=C("red"), nir=C("nir"))))}, "round(case when cloud_level = 0 then nir * cast(0.02 as double) - 273.15 end,6) as celsius, round(case when (qa & 3) = 0 then (nir-red)/nullif(nir+red,0) end,6) as index")
def _masks():
    return bits.state_cloud(C("qa"), "cloud_state"), C("cloud_level") <= 1


projection(
    "p19_veto", "obs", "obs_id", lambda: dict(zip(("one", "two"), bands.disagreement_veto(*_masks(), C("red")), strict=True)),
    "((qa & 3) in (1,2)) or (((qa & 3) in (1,2)) <> (cloud_level <= 1) and red > 0.15) as one, (cloud_level <= 1) or (((qa & 3) in (1,2)) <> (cloud_level <= 1) and red > 0.15) as two",
)
projection(
    "p18_soft_score", "obs", "obs_id", lambda: {"score": r6(bands.soft_score(C("cloud_level"), bands.disagreement_veto(*_masks(), C("red"))[0], C("red")))},
    "round(0.5 * case when cloud_level <= 3 then cloud_level / cast(3 as double) end + 0.3 * case when ((qa & 3) in (1,2)) or (((qa & 3) in (1,2)) <> (cloud_level <= 1) and red > 0.15) then 0.0 else 1.0 end + 0.2 * (1.0 - greatest(0.0, least(0.3, red)) / cast(0.3 as double)),6) as score",
)
projection("p20_meta_channel", "obs", "obs_id", lambda: {"meta": r6(F.when(_masks()[1], 0.0).otherwise(C("nir")))}, "round(case when cloud_level <= 1 then 0.0 else nir end,6) as meta")


@query(
    "p26_cos_sza",
    """select obs_id, round(sin(phi)*sin(dec) + cos(phi)*cos(dec)*cos(radians(15.0*(hour + lon/15.0 + (9.87*sin(2*b) - 7.53*cos(b) - 1.5*sin(b))/60.0 - 12.0))), 6) as cos_sza
 from (select *, radians(23.45*sin(b)) as dec from (select obs_id, radians(cast(obs_id % 160 as double) - 80) as phi, cast(obs_id % 360 as double) - 180 as lon, radians(cast(360 as double)/365*(doy-81)) as b, hour(ts) + minute(ts)/cast(60 as double) as hour from f_obs))""",
)
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = (C("obs_id") % 160).cast("double") - 80, (C("obs_id") % 360).cast("double") - 180
    return fixtures.obs(spark, sf_dir).select("obs_id", r6(calendar.cos_solar_zenith(lat, lon, C("doy"), F.hour("ts") + F.minute("ts") / 60.0)).alias("cos_sza"))


@query(
    "p27_sinusoidal",
    """select cell_id, h, v, cast(trunc((10007555 - v*1111950 - y)/(cast(1111950 as double)/4800)) as int) as row, cast(trunc((x + 20015109 - h*1111950)/(cast(1111950 as double)/4800)) as int) as col, round(x, 3) as x, round(y, 3) as y
 from (select *, cast(floor((x + 20015109)/1111950) as int) as h, cast(floor((10007555 - y)/1111950) as int) as v from (select cell_id, 6371007.181*radians(lon)*cos(radians(lat)) as x, 6371007.181*radians(lat) as y from f_cells))""",
)
def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.sinusoidal(C("lat"), C("lon"))
    rows = fixtures.cells(spark, sf_dir).select("cell_id", x.alias("x"), y.alias("y"))
    h, v = geo.tile_of(C("x"), C("y"))
    row, col = geo.tile_pixel(C("x"), C("y"), C("h"), C("v"))
    return rows.withColumn("h", h).withColumn("v", v).select("cell_id", "h", "v", row.alias("row"), col.alias("col"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


projection("p28_utm", "cells", "cell_id", lambda: {"epsg": geo.utm_epsg(C("lat"), C("lon"))}, "cast(case when lat >= 0 then 32600 else 32700 end + trunc((lon+180)/6) + 1 as int) as epsg")
def _box():
    return geo.box_pixels(C("lon"), C("lat"), C("lon") + 1.5, C("lat") + 0.5, 250.0)


projection("p29_bbox_km", "cells", "cell_id", lambda: {"nx": _box()[0], "ny": _box()[1], "width_km": r6(_box()[0] * 250.0 / 1000), "height_km": r6(_box()[1] * 250.0 / 1000)}, "cast(trunc((lon + 1.5 - lon) * 111319.0 * cos(radians((lat + (lat + 0.5)) / 2)) / 250) as int) as nx, cast(trunc((lat + 0.5 - lat) * 111319.0 / 250) as int) as ny, round(trunc((lon + 1.5 - lon) * 111319.0 * cos(radians((lat + (lat + 0.5)) / 2)) / 250) * 250 / 1000.0, 6) as width_km, round(trunc((lat + 0.5 - lat) * 111319.0 / 250) * 250 / 1000.0, 6) as height_km")
projection("p30_parse_grid", "cells", "cell_id", lambda: {"row": geo.grid_row_col(C("grid_id"))[0], "col": geo.grid_row_col(C("grid_id"))[1]}, "cast(regexp_extract(grid_id, '^(\\d+)D', 1) as int) as row, cast(regexp_extract(grid_id, '_(\\d+)', 1) as int) as col")


@query("p34_box_validation", "select region_key, max(lon) - min(lon) > 0.000001 and max(lat) - min(lat) > 0.000001 as usable from f_cells group by 1")
def p34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cells(spark, sf_dir).groupBy("region_key").agg(((F.max("lon") - F.min("lon") > 1e-6) & (F.max("lat") - F.min("lat") > 1e-6)).alias("usable"))


@query("p35_swath_bbox", "select region_key, round(min(lon) - cast(0.02 as double), 6) as lon_min, round(max(lon) + cast(0.02 as double), 6) as lon_max, round(min(lat) - cast(0.02 as double), 6) as lat_min, round(max(lat) + cast(0.02 as double), 6) as lat_max from f_cells group by 1")
def p35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cells(spark, sf_dir).groupBy("region_key").agg(r6(F.min("lon") - 0.02).alias("lon_min"), r6(F.max("lon") + 0.02).alias("lon_max"), r6(F.min("lat") - 0.02).alias("lat_min"), r6(F.max("lat") + 0.02).alias("lat_max"))


@query("p36_region_names", "select s_suppkey, concat(upper(substr(n_name,1,1)), lower(substr(n_name,2)), '_', upper(substr(r_name,1,1)), lower(substr(r_name,2))) as region from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where n_name not like '% %' and r_name not like '% %'")
def p36(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: fixtures.table(spark, sf_dir, n)
    rows = t("supplier").join(t("nation"), C("s_nationkey") == C("n_nationkey")).join(t("region"), C("n_regionkey") == C("r_regionkey"))
    return rows.where(~C("n_name").contains(" ") & ~C("r_name").contains(" ")).select("s_suppkey", names.region_key(C("n_name"), C("r_name")).alias("region"))


projection("s02_granule_names", "granules", "obs_id", lambda: {"obs_date": names.granule_date(C("fname")), "h": names.granule_tile(C("fname"))[0], "v": names.granule_tile(C("fname"))[1]}, "cast(strptime(regexp_extract(fname, '\\.A(\\d{7})\\.', 1), '%Y%j') as date) as obs_date, cast(regexp_extract(fname, '\\.h(\\d{2})v', 1) as int) as h, cast(regexp_extract(fname, 'v(\\d{2})\\.', 1) as int) as v")
def _swath():
    return names.swath_name(F.concat(F.when(C("obs_id") % 2 == 0, "MOD35_L2").otherwise("MYD35_L2"), F.lit(".A2024"), F.lpad((C("obs_id") % 366 + 1).cast("string"), 3, "0"), F.lit(".1005.061."), (C("obs_id") + 2024000000000).cast("string"), F.when(C("obs_id") % 5 == 0, ".txt").otherwise(".hdf")))




@query(
    "s04_swath_name",
    """select obs_id, case when ok then product end as product, case when ok then cast(date '2024-01-01' + cast(obs_id % 366 as int) as date) end as obs_date, case when ok then '1005' end as obs_time, case when ok then '061' end as collection,
 case when ok then cast(obs_id + 2024000000000 as string) end as production, case when ok then case when obs_id % 2 = 0 then 'MOD03' else 'MYD03' end end as geolocation from (select obs_id, obs_id % 5 <> 0 as ok, case when obs_id % 2 = 0 then 'MOD35_L2' else 'MYD35_L2' end as product from f_granules)""",
)
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.granules(spark, sf_dir).select("obs_id", *[c.alias(n) for n, c in _swath().items()])


def _path():
    return F.concat(F.lit("bucket/level2/h"), (C("obs_id") % 36).cast("string"), F.lit("/2024/d"), (C("obs_id") % 30).cast("string"), F.lit("/"), C("fname"))


projection("s16_object_paths", "granules", "obs_id", lambda: {"tile": names.path_part(_path(), 2), "day": names.path_part(_path(), 4), "name": F.element_at(F.split(_path(), "/"), -1)}, "concat('h', cast(obs_id % 36 as string)) as tile, concat('d', cast(obs_id % 30 as string)) as day, fname as name")
projection("s18_object_keys", "granules", "obs_id", lambda: {"key": F.regexp_replace(F.concat(F.lit("s3://store/a/"), C("fname")), r"^s3://[^/]+/", "")}, "concat('a/', fname) as key")


@query("s19_dimension_names", "select cell_id, lat, lon, cast(date '2024-01-01' as date) as time from f_cells")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.names import normalised_dimensions

    raw = fixtures.cells(spark, sf_dir).select("cell_id", C("lat").alias("Latitude"), C("lon").alias("x"), F.lit(date(2024, 1, 1)).alias("valid_time"))
    return normalised_dimensions(raw)
