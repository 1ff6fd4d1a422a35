"""Boxes, tiles, cells and patch extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo


def fixed_boxes(spark: SparkSession, lat: tuple[float, float], lon: tuple[float, float], n_lat: int, n_lon: int) -> DataFrame:
    """n_lat x n_lon boxes, by latitude first: box_id, lon_min, lat_min, lon_max, lat_max."""
    dlat, dlon = (lat[1] - lat[0]) / n_lat, (lon[1] - lon[0]) / n_lon
    i, j = F.floor(F.col("id") / n_lon), F.col("id") % n_lon
    south, west = F.lit(float(lat[0])) + i * dlat, F.lit(float(lon[0])) + j * dlon
    return spark.range(n_lat * n_lon).select(F.col("id").alias("box_id"), west.alias("lon_min"), south.alias("lat_min"), (west + dlon).alias("lon_max"), (south + dlat).alias("lat_max"))


def boxes_by_resolution(spark: SparkSession, lat: tuple[float, float], lon: tuple[float, float], metres: float, pixels: int) -> DataFrame:
    """Rows of boxes of pixels x pixels; the longitude step follows each row's latitude."""
    dlat = metres * pixels / 111320.0
    n_lat = max(0, -int(-(lat[1] - lat[0]) // dlat))
    south = F.lit(float(lat[0])) + F.col("id") * dlat
    rows = spark.range(n_lat).select(F.col("id").alias("row"), south.alias("lat_min")).withColumn("step", geo.metres_to_degrees(F.lit(float(metres * pixels)), F.col("lat_min"))[1])
    boxes = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.lit(float(lon[1])) - lon[0]) / F.col("step")).cast("int") - 1))).alias("col"))
    west = F.lit(float(lon[0])) + F.col("col") * F.col("step")
    return boxes.select("row", "col", west.alias("lon_min"), "lat_min", (west + F.col("step")).alias("lon_max"), (F.col("lat_min") + dlat).alias("lat_max"))


def region_boxes(regions: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """Each region's box (lon_min, lat_min, lon_max, lat_max, ...) cut into n_lat x n_lon boxes, by latitude first: the other columns, box_id and the box."""
    rest = [c for c in regions.columns if c not in ("lon_min", "lat_min", "lon_max", "lat_max")]
    dlat, dlon = (F.col("lat_max") - F.col("lat_min")) / n_lat, (F.col("lon_max") - F.col("lon_min")) / n_lon
    cut = regions.withColumns({"dlat_": dlat, "dlon_": dlon, "box_id": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lat * n_lon - 1).cast("long")))})
    south, west = F.col("lat_min") + F.floor(F.col("box_id") / n_lon) * F.col("dlat_"), F.col("lon_min") + F.col("box_id") % n_lon * F.col("dlon_")
    return cut.select(*rest, "box_id", west.alias("lon_min"), south.alias("lat_min"), (west + F.col("dlon_")).alias("lon_max"), (south + F.col("dlat_")).alias("lat_max"))


def region_boxes_by_resolution(regions: DataFrame, metres: float, pixels: int) -> DataFrame:
    """Each region's box covered by boxes of pixels x pixels, from its south-western corner: the other columns, row, col and the box; the longitude step follows each row's latitude."""
    rest = [c for c in regions.columns if c not in ("lon_min", "lat_min", "lon_max", "lat_max")]
    dlat = metres * pixels / 111320.0
    steps = lambda span, step: F.sequence(F.lit(0), F.ceil(span / step).cast("int") - 1)
    rows = regions.where("lat_max > lat_min and lon_max > lon_min").withColumn("row", F.explode(steps(F.col("lat_max") - F.col("lat_min"), F.lit(dlat)))).withColumn("south_", F.col("lat_min") + F.col("row") * dlat)
    rows = rows.withColumn("step_", geo.metres_to_degrees(F.lit(float(metres * pixels)), F.col("south_"))[1])
    boxes = rows.withColumn("col", F.explode(steps(F.col("lon_max") - F.col("lon_min"), F.col("step_")))).withColumn("west_", F.col("lon_min") + F.col("col") * F.col("step_"))
    return boxes.select(*rest, "row", "col", F.col("west_").alias("lon_min"), F.col("south_").alias("lat_min"), (F.col("west_") + F.col("step_")).alias("lon_max"), (F.col("south_") + dlat).alias("lat_max"))


def with_tiles(cells: DataFrame) -> DataFrame:
    """Cells (lat, lon) with the tile h, v they are in."""
    x, y = geo.sinusoidal(F.col("lat"), F.col("lon"))
    h, v = geo.tile_of(x, y)
    return cells.withColumn("h", h).withColumn("v", v)


def tile_catalog(cells: DataFrame) -> DataFrame:
    """h, v, cells: the cells of each tile, ordered by id."""
    return with_tiles(cells).groupBy("h", "v").agg(F.sort_array(F.collect_list(F.struct("cell_id", "grid_id", "lat", "lon"))).alias("cells"))


def pairs_by_tile(left: DataFrame, right: DataFrame) -> DataFrame:
    """h, v, n: how many pairs of rows of both tables are in each tile; both are counted by tile, so no pair is made."""
    count = lambda rows, name: rows.groupBy("h", "v").agg(F.count("*").alias(name))
    return count(left, "left_").join(count(right, "right_"), ["h", "v"]).select("h", "v", (F.col("left_") * F.col("right_")).alias("n"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, degrees: float = 10.0) -> DataFrame:
    """Range join of points (lat, lon) and boxes: boxes are dealt to the degree buckets they cover, so the join is by equality and then by bounds."""
    bucket = lambda c: F.floor(c / degrees).cast("int")
    spread = boxes.select("*", F.explode(F.sequence(bucket(F.col("lat_min")), bucket(F.col("lat_max")))).alias("lat_bucket")).select("*", F.explode(F.sequence(bucket(F.col("lon_min")), bucket(F.col("lon_max")))).alias("lon_bucket"))
    dealt = points.withColumn("lat_bucket", bucket(F.col("lat"))).withColumn("lon_bucket", bucket(F.col("lon")))
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    return dealt.join(spread, ["lat_bucket", "lon_bucket"]).where(inside).drop("lat_bucket", "lon_bucket")


def selected(regions: DataFrame, names: Sequence[str], column: str) -> DataFrame:
    """The regions with one of the names; a missing column is an error."""
    if column not in regions.columns:
        raise ValueError(f"no column {column} among {regions.columns}")
    return regions.where(F.col(column).isin(*names))


def bounds(regions: DataFrame) -> DataFrame:
    """One row lon_min, lat_min, lon_max, lat_max around all corners of regions (rings); no region is an error when it is read."""
    corners = regions.select(F.explode(F.flatten("rings")).alias("p"))
    box = corners.agg(F.count("*").alias("n_"), *(f(f"p.{c}").alias(f"{c}_{e}") for e, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")))
    return box.where(F.when(F.col("n_") == 0, F.raise_error(F.lit("no region is selected")).cast("boolean")).otherwise(True)).select("lon_min", "lat_min", "lon_max", "lat_max")


def in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """points (lat, lon) joined with the regions that they are in, by the even-odd rule over all rings, so holes and several parts are allowed.

    regions: any columns, and rings, an array of closed rings of (lon, lat), the first corner not repeated.  A point on a west or south edge is
    inside.  The join is by degree buckets of the regions' boxes, then by boxes, then by a ray to the east.
    """
    edge = lambda ring: F.transform(ring, lambda p, i: F.struct(p["lon"].alias("x0"), p["lat"].alias("y0"), F.get(ring, (i + 1) % F.size(ring))["lon"].alias("x1"), F.get(ring, (i + 1) % F.size(ring))["lat"].alias("y1")))
    of = lambda f, c: f(F.transform(F.flatten("rings"), lambda p: p[c]))
    boxes = regions.withColumns({"edges_": F.flatten(F.transform("rings", edge)), "lon_min": of(F.array_min, "lon"), "lon_max": of(F.array_max, "lon"), "lat_min": of(F.array_min, "lat"), "lat_max": of(F.array_max, "lat")}).drop("rings")
    lat, lon = F.col("lat"), F.col("lon")
    crossed = F.filter("edges_", lambda e: ((e["y0"] > lat) != (e["y1"] > lat)) & (lon < (e["x1"] - e["x0"]) * (lat - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]))
    return points_in_boxes(points, boxes).where(F.size(crossed) % 2 == 1).drop("edges_", "lon_min", "lon_max", "lat_min", "lat_max")


def clipped_to_regions(points: DataFrame, regions: DataFrame, key: Sequence[str], invert: bool = False) -> DataFrame:
    """The points (key, lat, lon, ...) inside any region; invert: those outside all.  A point in several regions comes once."""
    inside = in_regions(points.select(*key, "lat", "lon"), regions.select("rings")).select(*key)
    return points.join(inside, list(key), "left_anti" if invert else "left_semi")


def land_share(points: DataFrame, boxes: DataFrame, percent: float) -> DataFrame:
    """box_id, n, land_percent of the boxes whose points (with a 0/1 land column) are land to percent or more."""
    found = points_in_boxes(points, boxes).groupBy("box_id").agg(F.count("*").alias("n"), (F.avg("land") * 100).alias("land_percent"))
    return found.where(F.col("land_percent") >= percent)


def with_grid_cell(points: DataFrame, km: float) -> DataFrame:
    """points (lat, lon) with the grid_id of the cell they are in; no catalog of cells is needed."""
    row, col = geo.grid_indices_of(F.col("lat"), F.col("lon"), km)
    return points.withColumn("row_", row).withColumn("col_", col).withColumn("grid_id", geo.grid_name(F.col("row_"), F.col("col_"))).drop("row_", "col_")


def grid_points_in_boxes(boxes: DataFrame, km: float) -> DataFrame:
    """The points of the global grid in each box (lon_min, lat_min, lon_max, lat_max, edges included): columns of the box, grid_id, lat, lon.

    Rows and columns of a box are counted off from its edges; nothing outside is made.  A box from 170 to -170 goes across the date line.
    """
    n = geo.grid_rows(km)
    edge = lambda c, f, size: f(F.col(c) * size / 360.0).cast("long")
    south, north = F.greatest(F.lit(-(n // 2)), F.ceil(F.col("lat_min") * n / 180.0 - 1e-9)), F.least(F.lit(n - n // 2 - 1), F.floor(F.col("lat_max") * n / 180.0 + 1e-9))
    rows = boxes.where(south <= north).withColumn("row_", F.explode(F.sequence(south.cast("long"), north.cast("long")))).withColumn("m_", geo.grid_columns(F.col("row_"), km))
    first, last = -F.floor(F.col("m_") / 2), F.col("m_") - F.floor(F.col("m_") / 2) - 1
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    west, east = F.greatest(first, edge("lon_min", F.ceil, F.col("m_"))), F.least(last, edge("lon_max", F.floor, F.col("m_")))
    cols = F.when(F.col("lon_min") <= F.col("lon_max"), span(west, east)).otherwise(F.concat(span(west, last), span(first, east)))
    cells = rows.withColumn("col_", F.explode(cols))
    lat, lon = geo.grid_point(F.col("row_"), F.col("col_"), km)
    return cells.select(*boxes.columns, geo.grid_name(F.col("row_"), F.col("col_")).alias("grid_id"), lat.alias("lat"), lon.alias("lon"))


def extract_windows(pixels: DataFrame, centres: DataFrame, tile: Sequence[str], half: int, size: int, most_null: float = 0.1, value: str = "v") -> DataFrame:
    """Square windows of tiles: centres (tile columns, cell_id, row, col) joined with pixels (tile columns, r, c, value) by tile and place.

    Windows that leave the size x size tile are rejected, and those with a larger share of nulls than most_null.
    Result: cell_id, pr, pc (in the window), value.
    """
    fits = (F.col("row") >= half) & (F.col("col") >= half) & (F.col("row") + half <= size) & (F.col("col") + half <= size)
    wanted = centres.where(fits).select("cell_id", *tile, "row", "col", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("pr")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("pc"))
    wanted = wanted.withColumn("r", F.col("row") - half + F.col("pr")).withColumn("c", F.col("col") - half + F.col("pc"))
    rows = pixels.join(wanted, [*tile, "r", "c"]).select("cell_id", "pr", "pc", value)
    good = rows.groupBy("cell_id").agg(F.avg(F.col(value).isNull().cast("int")).alias("null_share")).where(F.col("null_share") <= most_null)
    return rows.join(good.select("cell_id"), "cell_id", "left_semi")


def blocked(tiles: DataFrame, tile: Sequence[str], size: int, block: int, value: str = "data") -> DataFrame:
    """Square tiles (tile columns, value: size * size numbers, row by row) as square blocks: tile columns, br, bc, data."""
    if size % block:
        raise ValueError(f"a tile of {size} is not a whole number of blocks of {block}")
    n = size // block
    places = tiles.select(*tile, F.col(value).alias("tile_"), F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("place_"))
    br, bc = F.floor(F.col("place_") / n).cast("int"), (F.col("place_") % n).cast("int")
    lines = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: F.slice("tile_", (br * block + k) * size + bc * block + 1, F.lit(block)))
    return places.select(*tile, br.alias("br"), bc.alias("bc"), F.flatten(lines).alias("data"))


def extract_block_windows(blocks: DataFrame, centres: DataFrame, tile: Sequence[str], half: int, size: int, block: int, most_null: float = 0.1) -> DataFrame:
    """Square windows of blocked tiles: cell_id, data (2 half x 2 half numbers, row by row), around centres (tile columns, cell_id, row, col).

    Windows that leave the size x size tile are rejected, and those with a larger share of nulls than most_null.  A window is joined with
    the blocks that it touches, (2 half / block + 1) squared at most, and put together from slices of their lines; pixels are never rows.
    """
    wide = 2 * half
    fits = (F.col("row") >= half) & (F.col("col") >= half) & (F.col("row") + half <= size) & (F.col("col") + half <= size)
    top, left = F.col("row") - half, F.col("col") - half
    touched = lambda at: F.sequence(F.floor(at / block).cast("int"), F.floor((at + wide - 1) / block).cast("int"))
    wanted = centres.where(fits).select("cell_id", *tile, top.alias("top_"), left.alias("left_"), F.explode(touched(top)).alias("br")).withColumn("bc", F.explode(touched(F.col("left_"))))
    # The part of the block that is in the window: lines r0 .. r1 - 1 and, in each, places c0 .. c1 - 1.
    edge = lambda at, b, f, over: f(F.lit(over), at + (wide if over else 0) - F.col(b) * block)
    r0, r1, c0, c1 = edge(F.col("top_"), "br", F.greatest, 0), edge(F.col("top_"), "br", F.least, block), edge(F.col("left_"), "bc", F.greatest, 0), edge(F.col("left_"), "bc", F.least, block)
    lines = F.transform(F.sequence(r0, r1 - 1), lambda k: F.slice("data", k * block + c0 + 1, c1 - c0))
    parts = wanted.join(blocks, [*tile, "br", "bc"]).select("cell_id", *tile, "br", "bc", lines.alias("lines"))
    held = parts.groupBy("cell_id", *tile).agg(F.sort_array(F.collect_list(F.struct("br", "bc", "lines"))).alias("parts_"))
    # Blocks of a row of blocks side by side: the k-th lines of all of them, from west to east, make a line of the window.
    bands = F.transform(F.array_distinct(F.transform("parts_", lambda p: p["br"])), lambda b: F.filter("parts_", lambda p: p["br"] == b))
    band = lambda ps: F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.get(ps, 0)["lines"]) - 1), lambda k: F.flatten(F.transform(ps, lambda p: F.get(p["lines"], k)))))
    made = held.select("cell_id", F.flatten(F.transform(bands, band)).alias("data"))
    return made.where(F.size(F.filter("data", lambda v: v.isNull())) <= most_null * F.size("data"))


def gated(rows: DataFrame, key: Sequence[str], value: str, most_null: float) -> DataFrame:
    """key, null_share of the groups that pass the null gate."""
    return rows.groupBy(*key).agg(F.avg(F.col(value).isNull().cast("int")).alias("null_share")).where(F.col("null_share") <= most_null)


def without_empty_lines(rows: DataFrame, key: Sequence[str], value: str = "v") -> DataFrame:
    """Drops rows and columns of a raster that are null throughout."""
    some = lambda line: rows.groupBy(*key, line).agg(F.count(value).alias("n")).where("n > 0").select(*key, line)
    return rows.join(some("r"), [*key, "r"], "left_semi").join(some("c"), [*key, "c"], "left_semi")


def strided_tiles(spark: SparkSession, size: int, stride: int, tile: int) -> DataFrame:
    """Upper-left corners of tile x tile squares at a stride: r0, c0."""
    n = max(0, -(-(size - tile + 1) // stride)) if size >= tile else 0
    return spark.range(n * n).select((F.floor(F.col("id") / n) * stride).cast("int").alias("r0"), ((F.col("id") % n) * stride).cast("int").alias("c0"))


def split_box(west: Column, south: Column, east: Column, north: Column, nx: int, ny: int) -> Column:
    """An array of nx * ny boxes, x first."""
    dx, dy = (east - west) / nx, (north - south) / ny
    return F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), lambda k: F.struct(k.alias("part"), (west + F.floor(k / ny) * dx).alias("lon_min"), (south + (k % ny) * dy).alias("lat_min"), (west + (F.floor(k / ny) + 1) * dx).alias("lon_max"), (south + (k % ny + 1) * dy).alias("lat_max")))
