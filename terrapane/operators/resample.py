"""Nearest and bilinear sampling, mosaics and look-ups between grids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import grid, morphology


def _on_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return geo.RADIUS * F.cos(phi) * F.cos(lam), geo.RADIUS * F.cos(phi) * F.sin(lam), geo.RADIUS * F.sin(phi)


def nearest_within(targets: DataFrame, samples: DataFrame, metres: float, target_id: str, sample_id: str, key: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """For each target, the sample of the same key nearest by chord within a radius (ties: least id): key, target_id, sample_id, metres, carry.

    Both are points (key, lat, lon); carry names further columns of the sample.  Space is cut into cubes as wide as the radius, and each target
    looks into the 27 around it, so poles and the date line need no care and the join is by equality.
    """

    def cubes(df: DataFrame, name: str, *more: str) -> DataFrame:
        x, y, z = _on_sphere(F.col("lat"), F.col("lon"))
        return df.select(*key, F.col(name), *more, x.alias(f"{name}_x"), y.alias(f"{name}_y"), z.alias(f"{name}_z")).withColumns({k: F.floor(F.col(f"{name}_{k[1]}") / metres) for k in ("bx", "by", "bz")})

    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    t = cubes(targets, target_id).withColumn("step_", F.explode(steps)).withColumns({"bx": F.col("bx") + F.col("step_.i"), "by": F.col("by") + F.col("step_.j"), "bz": F.col("bz") + F.col("step_.k")}).drop("step_")
    near = t.join(cubes(samples, sample_id, *carry), [*key, "bx", "by", "bz"])
    far = F.sqrt(sum((F.col(f"{target_id}_{k}") - F.col(f"{sample_id}_{k}")) ** 2 for k in "xyz"))
    best = near.select(*key, target_id, sample_id, *carry, far.alias("metres")).where(F.col("metres") <= metres).groupBy(*key, target_id).agg(F.min(F.struct("metres", sample_id, *carry)).alias("best"))
    return best.select(*key, target_id, f"best.{sample_id}", "best.metres", *[f"best.{c}" for c in carry])


def bilinear(points: DataFrame, raster: DataFrame, key: Sequence[str], point_id: str, rows: int, cols: int, value: str = "v", outside: float | None = 0.0, carry: Sequence[str] = ()) -> DataFrame:
    """Samples a raster (key, r, c, value) at fractional (fr, fc): key, point_id, carry, value; points outside, and those with a null corner, give ``outside``.

    Pixels and corners are many more rows than the tables they are made from, which Spark's estimates don't see, so they are joined by sorting and never broadcast.
    """
    inside = F.col("fr").between(0, rows - 1) & F.col("fc").between(0, cols - 1)
    r0, c0 = F.least(F.floor("fr"), F.lit(rows - 2)).cast("int"), F.least(F.floor("fc"), F.lit(cols - 2)).cast("int")
    p = points.withColumn("inside", inside).withColumn("r0", r0).withColumn("c0", c0)
    wr, wc = F.col("fr") - F.col("r0"), F.col("fc") - F.col("c0")
    corners = F.array(*[F.struct((F.col("r0") + i).alias("r"), (F.col("c0") + j).alias("c"), ((wr if i else 1 - wr) * (wc if j else 1 - wc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    spread = p.select(*key, point_id, *[F.col(c).alias(f"{c}_kept_") for c in carry], F.explode_outer(F.when(F.col("inside"), corners)).alias("corner_")).select("*", "corner_.*").drop("corner_")
    near = spread.join(raster.select(*key, "r", "c", value, F.lit(True).alias("hit_")).hint("merge"), [*key, "r", "c"], "left")
    found = F.when(F.count(value) == F.count("hit_"), F.sum(F.col("w") * F.col(value)))
    out = near.groupBy(*key, point_id).agg(*[F.first(f"{c}_kept_").alias(c) for c in carry], found.alias(value))
    return out.withColumn(value, F.coalesce(value, F.lit(outside))) if outside is not None else out


def reprojected(raster: DataFrame, frames: DataFrame, key: Sequence[str], source: str, target: str, shape: tuple[int, int], step: float, source_shape: tuple[int, int], source_step: float, method: str = "bilinear", value: str = "v") -> DataFrame:
    """Rasters (key, r, c, value) of one projection on a grid of another: key, r, c, lat, lon, value; null outside the raster and beside nulls.

    frames: key, west, north (the target grid's corner in its projection), source_west, source_north, and lat0, lon0 where a projection is
    ``azimuthal``, epsg where one is ``utm``.  Projections: degrees, sinusoidal, equal_area, azimuthal, utm.  Each target pixel's centre is taken back to the source (inverse map), then
    its nearest pixel or four neighbours are joined by place.
    """
    grid = frames.withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(shape[0] * shape[1] - 1)))).withColumn("tr", F.floor(F.col("point_id") / shape[1]).cast("int")).withColumn("tc", (F.col("point_id") % shape[1]).cast("int"))
    grid = geo.unprojected(grid, target, F.col("west") + (F.col("tc") + 0.5) * step, F.col("north") - (F.col("tr") + 0.5) * step)
    grid = geo.projected(grid, source, F.col("lat"), F.col("lon"))
    grid = grid.withColumn("fr", (F.col("source_north") - F.col("y")) / source_step - 0.5).withColumn("fc", (F.col("x") - F.col("source_west")) / source_step - 0.5)
    points = grid.select(*key, "point_id", F.col("tr").alias("r"), F.col("tc").alias("c"), "lat", "lon", "fr", "fc")
    if method == "nearest":
        near = points.withColumn("tr", F.col("r")).withColumn("tc", F.col("c")).withColumn("r", F.floor(F.col("fr") + 0.5).cast("int")).withColumn("c", F.floor(F.col("fc") + 0.5).cast("int"))
        return near.join(raster.select(*key, "r", "c", value).hint("merge"), [*key, "r", "c"], "left").select(*key, F.col("tr").alias("r"), F.col("tc").alias("c"), "lat", "lon", value)
    if method != "bilinear":
        raise ValueError(f"unknown method {method}")
    return bilinear(points, raster, key, "point_id", *source_shape, value, outside=None, carry=["r", "c", "lat", "lon"]).select(*key, "r", "c", "lat", "lon", value)


def clipped(pixels: DataFrame, key: Sequence[str], box: tuple[float, float, float, float]) -> DataFrame:
    """The pixels (key, r, c, lat, lon, ...) inside (lon_min, lat_min, lon_max, lat_max); rasters that would keep one row or column at most are not clipped."""
    inside = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    return _inside_or_whole(pixels.withColumn("in_", inside), key).select(pixels.columns)


def _inside_or_whole(marked: DataFrame, key: Sequence[str]) -> DataFrame:
    """The pixels (key, r, c, in_, ...) marked by in_, and all those of rasters with one row or column of them at most."""
    of = lambda c, f: f(F.when(F.col("in_"), F.col(c))).over(Window.partitionBy(*key))
    clips = F.coalesce((of("r", F.min) < of("r", F.max)) & (of("c", F.min) < of("c", F.max)), F.lit(False))
    return marked.withColumn("clips_", clips).where(F.col("in_") | ~F.col("clips_"))


def clipped_to_boxes(pixels: DataFrame, frames: DataFrame, key: Sequence[str], target: str, step: float) -> DataFrame:
    """The pixels (key, r, c, lat, lon, ...) of rasters in a projection that touch the box of their frame, which is projected first.

    frames: key, lon_min, lat_min, lon_max, lat_max in degrees (two corners are projected), west and north of the raster, and lat0, lon0 or epsg as in
    ``reprojected``.  A pixel touches the box if its centre is at most half a step outside.  Rasters that would keep one row or
    column at most are not clipped; those without a box keep all their pixels.
    """
    boxes = geo.projected(frames, target, F.col("lat_min"), F.col("lon_min"), "x0_", "y0_")
    boxes = geo.projected(boxes, target, F.col("lat_max"), F.col("lon_max"), "x1_", "y1_").select(*key, F.col("west").alias("west_"), F.col("north").alias("north_"), "x0_", "y0_", "x1_", "y1_")
    x, y = F.col("west_") + (F.col("c") + 0.5) * step, F.col("north_") - (F.col("r") + 0.5) * step
    inside = F.coalesce(x.between(F.col("x0_") - step / 2, F.col("x1_") + step / 2) & y.between(F.col("y0_") - step / 2, F.col("y1_") + step / 2), F.lit(True))
    return _inside_or_whole(pixels.join(boxes.hint("merge"), list(key)).withColumn("in_", inside), key).select(pixels.columns)


def of_shape(pixels: DataFrame, key: Sequence[str], rows: int, cols: int) -> DataFrame:
    """The same pixels; a raster of another shape is an error when it is read."""
    whole = Window.partitionBy(*key)
    n = pixels.withColumns({"n_": F.count("*").over(whole), "rows_": F.max("r").over(whole) + 1, "cols_": F.max("c").over(whole) + 1})
    wrong = (F.col("n_") != rows * cols) | (F.col("rows_") != rows) | (F.col("cols_") != cols)
    error = F.raise_error(F.concat(F.lit(f"a raster is not {rows} x {cols}: "), F.to_json(F.struct(*key))))
    return n.where(F.when(wrong, error).otherwise(True).cast("boolean")).select(pixels.columns)


def mosaic(pieces: DataFrame, key: Sequence[str], order: str, value: str = "v") -> DataFrame:
    """Overlapping pieces as one raster: the last piece in order that has a value wins."""
    return pieces.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(value, order).alias(value))


def daily_mosaic(pieces: DataFrame, calibration: Mapping[str, Callable[[Column], Column]], day: str = "obs_date", order: str = "piece", kind: str = "dtype", value: str = "raw") -> DataFrame:
    """day, y, x and one calibrated column per variable, from overlapping pieces (day, variable, order, kind, y, x, value).

    Of a day's pieces of a variable only those of the commonest kind count (ties: the kind that appears first); where they overlap, the last one
    in order that has a value wins.  calibration maps each variable to a column function, applied once to the mosaic.  Variables are merged by
    pixel in the same aggregation, so pixels are shuffled once; kinds are chosen among the pieces, which are few.
    """
    rows = pieces.where(F.col("variable").isin(*calibration))
    kinds = dominant(rows.select(day, "variable", order, kind).distinct(), [day, "variable"], kind, order).select(day, "variable", kind)
    used = rows.where(F.col(value).isNotNull()).join(kinds, [day, "variable", kind], "left_semi")
    of = lambda c, v: F.when(F.col("variable") == v, F.col(c))
    out = used.groupBy(day, "y", "x").agg(*[F.max_by(of(value, v), of(order, v)).alias(v) for v in calibration])
    return out.select(day, "y", "x", *[f(F.col(f"`{v}`")).alias(v) for v, f in calibration.items()])


def dominant(rows: DataFrame, group: Sequence[str], kind: str, order: str) -> DataFrame:
    """The commonest kind of each group; the one that appears first in order wins ties."""
    n = rows.groupBy(*group, kind).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*group).agg(F.max_by(kind, F.struct("n", -F.col("first"))).alias(kind), F.max("n").alias("n"))


def swath_patches(samples: DataFrame, cells: DataFrame, half: int, size: int, step: float = 0.01, metres: float = 1500.0, most_null: float = 0.1, value: str = "level", fill: int = 99) -> DataFrame:
    """Patches of size x size around cells (cell_id, lat, lon) from swaths of samples (swath_id, obs_date, sample_id, lat, lon, value): obs_date, cell_id, r, c, value.

    A swath's footprint is its box (the shorter way round, so it may lie across the date line) and two steps around it; a regular grid of that step covers it from the south-west, and each cell inside takes
    the 2 half x 2 half nodes around its own, unless they leave the grid.  Only those nodes look for their nearest sample, within a radius.  Row 0
    is north; nodes are repeated up to size and cut there.  Patches with more than most_null of their pixels empty are dropped, the other empty
    pixels become ``fill``.  Where swaths of a day give a cell several patches, the one with the largest swath_id stays.
    Samples without a place or a value count as missing; size is 2 half at least.
    """
    factor = -(-size // (2 * half))
    seen = samples.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    # Longitudes from -180 on or from 0 on, whichever makes the swath clearly narrower, so one across the date line has a short box.
    seen = seen.withColumn("lon360_", F.pmod("lon", F.lit(360.0)))
    boxes = seen.groupBy("swath_id", "obs_date").agg(*[f(c).alias(f"{c}_{e}_") for c in ("lat", "lon", "lon360_") for e, f in (("low", F.min), ("high", F.max))])
    turned = F.col("lon360__high_") - F.col("lon360__low_") < F.col("lon_high_") - F.col("lon_low_") - 1
    west, east = (F.when(turned, F.col(f"lon360__{e}_")).otherwise(F.col(f"lon_{e}_")) for e in ("low", "high"))
    boxes = boxes.select("swath_id", "obs_date", (west - 2 * step).alias("west_"), (east + 2 * step).alias("east_"), (F.col("lat_low_") - 2 * step).alias("lat_min"), (F.col("lat_high_") + 2 * step).alias("lat_max"))
    # A cell may be in the box a turn further east or west.
    boxes = boxes.withColumn("turn_", F.explode(F.array(*map(F.lit, (0.0, 360.0, -360.0))))).withColumns({"lon_min": F.col("west_") - F.col("turn_"), "lon_max": F.col("east_") - F.col("turn_")}).where("lon_max >= -180 and lon_min <= 180")
    inside = grid.points_in_boxes(cells.select("cell_id", "lat", "lon"), boxes)
    inside = inside.withColumns({"lon": F.col("lon") + F.col("turn_"), "lon_min": F.col("west_"), "lon_max": F.col("east_")})
    for axis, name in (("lat", "row"), ("lon", "col")):
        n = F.ceil((F.col(f"{axis}_max") - F.col(f"{axis}_min")) / step)
        inside = inside.withColumn(f"{name}s", n).withColumn(name, F.greatest(F.lit(0), F.least(F.rint((F.col(axis) - F.col(f"{axis}_min")) / step).cast("long"), n - 1)))
    fits = (F.col("row") >= half) & (F.col("row") + half <= F.col("rows")) & (F.col("col") >= half) & (F.col("col") + half <= F.col("cols"))
    wanted = inside.where(fits).select("swath_id", "obs_date", "cell_id", "row", "col", "lat_min", "lon_min", F.explode(F.sequence(F.lit(0), F.lit(4 * half * half - 1))).alias("k_"))
    pr, pc = F.floor(F.col("k_") / (2 * half)).cast("int"), (F.col("k_") % (2 * half)).cast("int")
    wanted = wanted.withColumn("r", 2 * half - 1 - pr).withColumn("c", pc).withColumn("gr", F.col("row") - half + pr).withColumn("gc", F.col("col") - half + pc)
    wanted = wanted.withColumn("node", F.shiftleft(F.col("gr"), 32) + F.col("gc"))
    nodes = wanted.select("swath_id", "node", (F.col("lat_min") + F.col("gr") * step).alias("lat"), (F.col("lon_min") + F.col("gc") * step).alias("lon")).dropDuplicates(["swath_id", "node"])
    found = nearest_within(nodes, seen.where(F.col(value).isNotNull()), metres, "node", "sample_id", ["swath_id"], [value])
    native = wanted.select("swath_id", "obs_date", "cell_id", "node", "r", "c").join(found.select("swath_id", "node", value), ["swath_id", "node"], "left").drop("node")
    # A node's pixels that are left after the cut, so the gate is taken before nodes are repeated.
    left = lambda c: F.greatest(F.lit(0), F.least(F.lit(factor), F.lit(size) - F.col(c) * factor))
    empty = F.sum(F.when(F.col(value).isNull(), left("r") * left("c")).otherwise(0)) / float(size * size)
    passed = native.groupBy("obs_date", "cell_id", "swath_id").agg(empty.alias("empty")).where(F.col("empty") <= most_null)
    last = passed.groupBy("obs_date", "cell_id").agg(F.max("swath_id").alias("swath_id"))
    kept = native.join(last, ["obs_date", "cell_id", "swath_id"], "left_semi").select("obs_date", "cell_id", "r", "c", F.coalesce(F.col(value), F.lit(fill)).alias(value))
    return morphology.upsampled(kept, factor, size)


def lookup_tiles(points: DataFrame, tiles: DataFrame, pixels_per_tile: int, size: float, value: str = "v") -> DataFrame:
    """Nearest look-up of sinusoidal tiles (h, v, row, col, value) at points (lat, lon); no pixel: 0."""
    x, y = geo.sinusoidal(F.col("lat"), F.col("lon"))
    p = points.withColumn("x", x).withColumn("y", y)
    h, v = geo.tile_of(F.col("x"), F.col("y"))
    p = p.withColumn("h", h).withColumn("v", v)
    x0, y0 = geo.tile_origin(F.col("h"), F.col("v"))
    clamp = lambda c: F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(pixels_per_tile - 1))
    p = p.withColumn("row", clamp((y0 - F.col("y")) / size)).withColumn("col", clamp((F.col("x") - x0) / size))
    return p.join(tiles.withColumnRenamed(value, "found"), ["h", "v", "row", "col"], "left").withColumn(value, F.coalesce("found", F.lit(0))).drop("found", "x", "y")


def azimuthal_centres(cells: DataFrame, n: int, metres: float) -> DataFrame:
    """The n x n pixel centres of a patch around each cell (row 0 north), on WGS84: cell columns, r, c, lat, lon."""
    cell = [c for c in cells.columns if c not in ("lat", "lon")]
    grid = cells.select(*cell, F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("place_"))
    grid = grid.withColumns({"r": F.floor(F.col("place_") / n).cast("int"), "c": (F.col("place_") % n).cast("int")})
    return geo.unprojected(grid, "azimuthal", (F.col("c") - n / 2 + 0.5) * metres, (n / 2 - F.col("r") - 0.5) * metres).select(*cell, "r", "c", "lat", "lon")


def block_means(pixels: DataFrame, key: Sequence[str], factor: int, value: str = "v") -> DataFrame:
    """Means of factor x factor blocks."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy(*key, block("r"), block("c")).agg(F.avg(value).alias(value))
