"""A collection of pixels, chosen by date and place, mapped band by band, clipped and exported as rasters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tiff


def rasters(pixels: DataFrame, regions: DataFrame, start: date, end: date, bands: Mapping[str, Callable[[Column], Column]], step: float, parts: tuple[int, int] = (1, 1), nodata: float = -9999.0, epsg: int = 4326) -> DataFrame:
    """The rows that the ``geotiff`` format writes: one for each image, region and part of its box, with all bands.

    pixels: image, obs_date, row, col (whole numbers counted from 90 degrees north and 180 west in steps) and a column for each band; regions: region,
    lon_min, lat_min, lon_max, lat_max.  Images from start to end (not included) are taken; a region's pixels are those whose centre is in its box.  The box is cut
    into parts[0] x parts[1] parts, west to east first; a part's pixels are gathered in one row, so parts must fit a task.  Bands are mapped by
    their functions; pixels that are missing or null are nodata, and parts without any pixel are left out.

    Regions are first turned into ranges of rows and columns, so pixels are joined with the parts that they are in by blocks of rows, not compared with boxes.
    """
    nx, ny = parts
    first = lambda v: F.ceil(v / step - 0.5).cast("int")  # noqa: E731  the first whole pixel whose centre is not before v
    west, east, north, south = first(F.col("lon_min") + 180), first(F.col("lon_max") + 180), first(90 - F.col("lat_max")), first(90 - F.col("lat_min"))
    boxes = regions.select("region", west.alias("c0"), east.alias("c1"), north.alias("r0"), south.alias("r1")).where("c0 < c1 and r0 < r1")
    cut = boxes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))))
    along = lambda a, b, k, n: (F.col(a) + F.floor((F.col(b) - F.col(a)) * k / n)).cast("int")
    i, j = F.floor(F.col("part") / ny), F.col("part") % ny
    cut = cut.select("region", "part", along("c0", "c1", i, nx).alias("left"), along("c0", "c1", i + 1, nx).alias("right"), along("r0", "r1", j, ny).alias("top"), along("r0", "r1", j + 1, ny).alias("bottom")).where("left < right and top < bottom")
    spread = cut.withColumn("row", F.explode(F.sequence(F.col("top"), F.col("bottom") - 1)))
    chosen = pixels.where((F.col("obs_date") >= F.lit(start)) & (F.col("obs_date") < F.lit(end))).select("image", "obs_date", "row", "col", *[f(F.col(b)).cast("double").alias(b) for b, f in bands.items()])
    inside = chosen.join(spread, "row").where((F.col("col") >= F.col("left")) & (F.col("col") < F.col("right")))
    place = ((F.col("row") - F.col("top")) * (F.col("right") - F.col("left")) + F.col("col") - F.col("left")).cast("int")
    shape = ["region", "part", "left", "right", "top", "bottom"]
    held = inside.groupBy("image", "obs_date", *shape).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("place"), F.struct(*bands).alias("value")))).alias("at_"))
    height, width = F.col("bottom") - F.col("top"), F.col("right") - F.col("left")
    every = F.sequence(F.lit(0), height * width - 1)
    band = lambda b: F.transform(every, lambda k: F.try_element_at("at_", k)[b])
    values = F.array(*map(band, bands))
    name = F.concat(F.col("image").cast("string"), F.lit("-"), F.col("region").cast("string"), F.lit("-"), F.col("part").cast("string"))
    return held.select(
        name.alias("name"), "obs_date", height.alias("height"), width.alias("width"), (F.col("left") * step - 180).alias("west"), (90 - F.col("top") * step).alias("north"), F.lit(float(step)).alias("step_x"), F.lit(float(step)).alias("step_y"),
        F.lit(epsg).alias("epsg"), F.lit("float32").alias("dtype"), F.lit(nodata).alias("nodata"), F.array(*map(F.lit, bands)).alias("names"), values.alias("bands"),
    )


def export(pixels: DataFrame, regions: DataFrame, start: date, end: date, bands: Mapping[str, Callable[[Column], Column]], step: float, path: str, parts: tuple[int, int] = (1, 1)) -> None:
    """Writes the rasters of a collection to a folder, all or none."""
    tiff.register(pixels.sparkSession)
    rasters(pixels, regions, start, end, bands, step, parts).write.format("geotiff").mode("append").save(path)
