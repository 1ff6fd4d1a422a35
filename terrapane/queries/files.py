"""Rasters as files: written, listed and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import patch_store
from ..sources import tiff
from ..workdir import work_path
from .registry import query, r6

C = F.col
SIDE = 8  # patches a side of a raster


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 64 x 64 pixels from 64 patches each: one of floats (v), one of whole numbers (q and the class); patches that the last one lacks are nodata."""
    rows = fixtures.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("patch_id"), C("embedding").cast("array<double>").alias("data"), C("label").cast("double").alias("lc"))
    held = rows.groupBy(F.floor(C("patch_id") / SIDE**2).alias("raster")).agg(F.map_from_entries(F.collect_list(F.struct((C("patch_id") % SIDE**2).cast("int"), F.struct("data", "lc")))).alias("patches"))
    wide = SIDE * 8
    patch = lambda i: C("patches")[(F.floor(i / (wide * 8)) * SIDE + F.floor(i % wide / 8)).cast("int")]
    pixel = lambda i: F.get(patch(i)["data"], (F.floor(i / wide) % 8 * 8 + i % 8).cast("int"))
    every = F.sequence(F.lit(0), F.lit(wide * wide - 1))
    v, q, lc = F.transform(every, pixel), F.transform(every, lambda i: F.floor(pixel(i) * 1000).cast("double")), F.transform(every, lambda i: patch(i)["lc"])
    kinds = F.array(
        F.struct(F.lit("float32").alias("dtype"), F.lit(None).cast("double").alias("nodata"), F.array(F.lit("v")).alias("names"), F.array(v).alias("bands")),
        F.struct(F.lit("int16").alias("dtype"), F.lit(-9999.0).alias("nodata"), F.array(F.lit("q"), F.lit("lc")).alias("names"), F.array(q, lc).alias("bands")),
    )
    out = held.select("raster", F.explode(kinds).alias("kind")).select("raster", "kind.*")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (C("raster") % 3).cast("int"))
    return out.select(F.concat("dtype", F.lit("-"), C("raster").cast("string")).alias("name"), day.alias("obs_date"), F.lit(wide).alias("height"), F.lit(wide).alias("width"), (C("raster") * 1000.0).alias("west"), F.lit(5000.0).alias("north"), F.lit(250.0).alias("step_x"), F.lit(250.0).alias("step_y"), F.lit(6933).alias("epsg"), "dtype", "nodata", "names", "bands")


def _written(spark: SparkSession, sf_dir: str) -> str:
    tiff.register(spark)
    path = work_path(spark, "tiffs")
    _rasters(spark, sf_dir).write.format("geotiff").mode("append").save(path)
    return path


_DAY = "cast(date '2024-01-01' + cast(patch_id // 64 % 3 as int) as date)"


@query(
    "k11_tiff_round_trip",
    f"""with p as (select patch_id, r, c, v, lc_class, {_DAY} as obs_date from f_patch where patch_id // 64 % 3 >= 1) select patch_id, r, c, obs_date, 'v' as name, round(v, 6) as value, (patch_id // 64) * 1000.0::double as west from p
 union all select patch_id, r, c, obs_date, 'q', floor(v * 1000), (patch_id // 64) * 1000.0 from p union all select patch_id, r, c, obs_date, 'lc', lc_class, (patch_id // 64) * 1000.0 from p""",
)
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patches written as GeoTIFF; the files of the later days read back, pixel by pixel."""
    tiles = spark.read.format("geotiff").load(_written(spark, sf_dir)).where(C("obs_date") >= F.lit("2024-01-02").cast("date"))
    rows = tiles.select("obs_date", "name", "row0", "col0", "width", "west", "nodata", F.posexplode("data").alias("place", "value"))
    y, x = C("row0") + F.floor(C("place") / C("width")), C("col0") + C("place") % C("width")
    patch_id = (C("west") / 1000).cast("long") * SIDE**2 + F.floor(y / 8) * SIDE + F.floor(x / 8)
    known = ~F.isnan("value") & F.coalesce(C("value") != C("nodata"), F.lit(True))
    return rows.where(known).select(patch_id.alias("patch_id"), (y % 8).cast("int").alias("r"), (x % 8).cast("int").alias("c"), "obs_date", "name", r6(C("value")).alias("value"), "west")


@query("k06_tiff_days", f"select distinct {_DAY} as obs_date from (select vec_id as patch_id from embeddings)")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed days by the names of files, which are listed and not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(_written(spark, sf_dir)).select("path")
    return patch_store.days_of_names(files)


@query("s13_tiff_catalog", "select 'float32-' || raster as stem, 1 as bands, 'v' as names, 64 as height, 64 as width, 250.0::double as step_x, 6933 as epsg, n::bigint * 64 as n_values from (select vec_id // 64 as raster, count(*) as n from embeddings group by 1) union all select 'int16-' || raster, 2, 'lc,q', 64, 64, 250.0, 6933, n * 128 from (select vec_id // 64 as raster, count(*) as n from embeddings group by 1)")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file holds, by its own tags, and how many of its values are not nodata."""
    tiles = spark.read.format("geotiff").load(_written(spark, sf_dir))
    stem = F.regexp_extract("path", r"([^/]+)_\d{8}\.tif$", 1)
    values = F.size(F.filter("data", lambda v: ~F.isnan(v) & F.coalesce(v != C("nodata"), F.lit(True))))
    by = tiles.groupBy(stem.alias("stem"), "step_x", "epsg").agg(F.count_distinct("band").cast("int").alias("bands"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"), (F.max(C("row0") + C("height"))).alias("height"), F.max(C("col0") + C("width")).alias("width"), F.sum(values).cast("long").alias("n_values"))
    return by.select("stem", "bands", "names", "height", "width", "step_x", "epsg", "n_values")


@query("k12_derived_store", "select variable, obs_date, count(value) as n, round(sum(value), 5) as total from (select 'ndvi' as variable, obs_date, (nir-red)/nullif(nir+red,0) as value from f_obs union all select 'nir', obs_date, nir from f_obs union all select 'red', obs_date, red from f_obs) group by 1,2")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived variables written to a store, a partition a variable and day."""
    from ..functions import bands

    path = work_path(spark, "derived")
    wide = fixtures.obs(spark, sf_dir).select("obs_id", "obs_date", bands.ndvi(red=C("red"), nir=C("nir")).alias("ndvi"), "nir", "red")
    patch_store.upsert_patches(wide.unpivot(["obs_id", "obs_date"], ["ndvi", "nir", "red"], "variable", "value"), path, ["obs_id"], attrs={"source": "daily reflectance"})
    return patch_store.read_store(spark, path).groupBy("variable", "obs_date").agg(F.count("value").alias("n"), F.round(F.sum("value"), 5).alias("total"))


@query("k13_remaining_store", "select cast(cell_id as varchar) as grid_id, coalesce(e.label, 0) as lc, case when region_key % 2 = 0 then 1 else 2 end as run from f_cells left join embeddings e on e.vec_id = cell_id")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cover of the cells that a store lacks: a run over some regions, then one over all, which leaves the first one's cells alone."""
    path = work_path(spark, "land-cover")
    classes = fixtures.table(spark, sf_dir, "embeddings").select(C("vec_id").alias("cell_id"), C("label").alias("lc"))
    cells = fixtures.cells(spark, sf_dir).join(classes, "cell_id", "left").select(C("cell_id").cast("string").alias("grid_id"), "region_key", F.coalesce("lc", F.lit(0)).alias("lc"), F.lit("land_cover").alias("variable"))
    first = cells.where("region_key % 2 = 0").drop("region_key")
    patch_store.upsert_patches(first.withColumn("run", F.lit(1)), path, by=["variable"])
    rest = cells.drop("region_key").join(patch_store.read_store(spark, path).select("grid_id"), "grid_id", "left_anti")
    patch_store.upsert_patches(rest.withColumn("run", F.lit(2)).select("grid_id", "lc", "variable", "run"), path, by=["variable"])
    return patch_store.read_store(spark, path).select("grid_id", "lc", "run")


_IMAGES = """select patch_id // 16 % 4 as image, cast(date '2024-01-01' + cast(patch_id // 16 % 4 as int) as date) as obs_date, patch_id // 64 as band_of, cast(300 + patch_id % 16 // 4 * 8 + r as int) as row, cast(700 + patch_id % 4 * 8 + c as int) as col, v from f_patch"""


@query(
    "s14_collection_export",
    f"""with p as (select image, obs_date, row, col, max(v) as v, count(*)::double as n from ({_IMAGES}) where obs_date >= date '2024-01-02' group by 1,2,3,4), b as (select region_key, 704 + region_key % 5 as c0, 704 + region_key % 5 + 13 as c1, 303 + region_key % 7 as r0, 303 + region_key % 7 + 11 as r1 from f_cells group by 1),
 k as (select *, unnest(range(6)) as part from b), q as (select region_key, part, c0 + (c1 - c0) * (part // 3) // 2 as l, c0 + (c1 - c0) * (part // 3 + 1) // 2 as r, r0 + (r1 - r0) * (part % 3) // 3 as t, r0 + (r1 - r0) * (part % 3 + 1) // 3 as d from k)
 select image || '-' || region_key || '-' || part as stem, obs_date, row - t as r, col - l as c, 'v' as name, round((v * 2 + 1)::float::double, 4) as value from p join q on row >= t and row < d and col >= l and col < r union all select image || '-' || region_key || '-' || part, obs_date, row - t, col - l, 'n', n from p join q on row >= t and row < d and col >= l and col < r""",
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four images of 32 x 32 pixels of a quarter of a degree: those from 2 January on, two bands, clipped to a box of 13 x 11 pixels a region, in 2 x 3 parts."""
    from datetime import date

    from ..plans.export import export

    k, step = C("patch_id"), 0.25
    rows = fixtures.patch(spark, sf_dir)
    image = (F.floor(k / 16) % 4).alias("image")
    place = rows.select(image, (300 + F.floor(k % 16 / 4) * 8 + C("r")).cast("int").alias("row"), (700 + k % 4 * 8 + C("c")).cast("int").alias("col"), "v")
    pixels = place.groupBy("image", "row", "col").agg(F.max("v").alias("v"), F.count("*").alias("n")).withColumn("obs_date", F.date_add(F.lit("2024-01-01").cast("date"), C("image").cast("int")))
    key = C("region_key")
    west, north = (704 + key % 5) * step - 180, 90 - (303 + key % 7) * step
    regions = fixtures.cells(spark, sf_dir).select("region_key").distinct().select(key.alias("region"), west.alias("lon_min"), (north - 11 * step).alias("lat_min"), (west + 13 * step).alias("lon_max"), north.alias("lat_max"))
    path = work_path(spark, "export")
    export(pixels, regions, date(2024, 1, 2), date(2024, 2, 1), {"v": lambda v: v * 2 + 1, "n": lambda n: n}, step, path, (2, 3))
    tiles = spark.read.format("geotiff").load(path).select(F.regexp_extract("path", r"([^/]+)_\d{8}\.tif$", 1).alias("stem"), "obs_date", "name", "width", "nodata", F.posexplode("data").alias("place", "value"))
    return tiles.where(C("value") != C("nodata")).select("stem", "obs_date", F.floor(C("place") / C("width")).cast("int").alias("r"), (C("place") % C("width")).alias("c"), "name", F.round("value", 4).alias("value"))
