"""Projections and grid arithmetic in closed form: the sphere of the sinusoidal land grid, and WGS84 for the others."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sinusoidal land grid.
RADIUS = 6371007.181
TILE = 1111950.0
WEST, NORTH = -20015109.0, 10007555.0
PIXELS = {250: 4800, 500: 2400, 1000: 1200}


def pixel_size(nominal: int) -> float:
    """The true pixel size of a nominal resolution; others stand for themselves."""
    return TILE / PIXELS[nominal] if nominal in PIXELS else float(nominal)


def sinusoidal(lat: Column, lon: Column) -> tuple[Column, Column]:
    phi = F.radians(lat)
    return RADIUS * F.radians(lon) * F.cos(phi), RADIUS * phi


def tile_of(x: Column, y: Column) -> tuple[Column, Column]:
    return F.floor((x - WEST) / TILE).cast("int"), F.floor((NORTH - y) / TILE).cast("int")


def tile_origin(h: Column, v: Column) -> tuple[Column, Column]:
    return WEST + h * TILE, NORTH - v * TILE


def tile_pixel(x: Column, y: Column, h: Column, v: Column, nominal: int = 250) -> tuple[Column, Column]:
    """(row, col) in the tile, cut towards zero."""
    x0, y0 = tile_origin(h, v)
    return ((y0 - y) / pixel_size(nominal)).cast("int"), ((x - x0) / pixel_size(nominal)).cast("int")


def sinusoidal_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of a point of the sinusoidal land grid."""
    phi = y / RADIUS
    return F.degrees(phi), F.degrees(x / (RADIUS * F.cos(phi)))


# The WGS84 ellipsoid, and the standard parallel of the global cylindrical equal-area grid (EPSG:6933).
AXIS, ECC2, PARALLEL = 6378137.0, 0.0066943799901413165, 30.0
_ECC = math.sqrt(ECC2)
CEA_SCALE = math.cos(math.radians(PARALLEL)) / math.sqrt(1 - ECC2 * math.sin(math.radians(PARALLEL)) ** 2)
CEA_POLE = 1 - (1 - ECC2) / (2 * _ECC) * math.log((1 - _ECC) / (1 + _ECC))
#: The series from authalic to geographic latitude (Snyder 1987, 3-18).
CEA_SERIES = (ECC2 / 3 + 31 * ECC2**2 / 180 + 517 * ECC2**3 / 5040, 23 * ECC2**2 / 360 + 251 * ECC2**3 / 3780, 761 * ECC2**3 / 45360)


def equal_area(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in the cylindrical equal-area projection of the ellipsoid (Snyder 1987, 10-13 to 10-15)."""
    s = F.sin(F.radians(lat))
    q = (1 - ECC2) * (s / (1 - ECC2 * s * s) - F.log((1 - _ECC * s) / (1 + _ECC * s)) / (2 * _ECC))
    return AXIS * CEA_SCALE * F.radians(lon), AXIS * q / (2 * CEA_SCALE)


def equal_area_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * y * CEA_SCALE / (AXIS * CEA_POLE))))
    lat = beta + CEA_SERIES[0] * F.sin(2 * beta) + CEA_SERIES[1] * F.sin(4 * beta) + CEA_SERIES[2] * F.sin(6 * beta)
    return F.degrees(lat), F.degrees(x / (AXIS * CEA_SCALE))


# Third flattening, and the radius of a sphere with meridians as long (times the scale of UTM's central meridian).
_FLAT = 1 - math.sqrt(1 - ECC2)
_N = _FLAT / (2 - _FLAT)
_POLAR = AXIS * (1 - _FLAT)
UTM_SCALE = 0.9996
UTM_RADIUS = UTM_SCALE * AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(*terms: float) -> float:
    """terms[0] n**k + terms[1] n**(k+1) + ... up to n**6."""
    return sum(t * _N ** (7 - len(terms) + i) for i, t in enumerate(terms))


# Krueger's series between the ellipsoid's and the sphere's transverse Mercator (Karney 2011, 35 and 36), and from conformal to
# geographic latitude (Kawase 2013), in the third flattening up to its sixth power; four terms each leave less than a micrometre.
KRUEGER = (
    _series(1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    _series(13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    _series(61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    _series(49561 / 161280, -179 / 168, 6601661 / 7257600),
)
KRUEGER_INVERSE = (
    _series(1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    _series(1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    _series(17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    _series(4397 / 161280, -11 / 504, -830251 / 7257600),
)
CONFORMAL = (
    _series(2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    _series(7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    _series(56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    _series(4279 / 630, -332 / 35, -399572 / 14175),
)


def _zone(epsg: Column) -> tuple[Column, Column]:
    """(central meridian in degrees, false northing) of a UTM zone by its EPSG code, 32601 to 32660 and 32701 to 32760."""
    return (epsg % 100) * 6 - 183.0, F.when(epsg >= 32700, 1e7).otherwise(0.0)


def staged(df: DataFrame, stages: Sequence[Mapping[str, Column]], out: Mapping[str, Column]) -> DataFrame:
    """df with the columns of ``out``, which use those of the stages before; the stages' own columns go.

    A stage is a projection of its own, so what is used several times is computed once and expressions stay small; the last one is generated, so
    that no filter above is pushed through all of them.
    """
    kept = [c for c in df.columns if c not in out]
    for stage in stages:
        df = df.withColumns(dict(stage))
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in out.items()]))).alias("made_")
    return df.select(*kept, made).select(*kept, *[F.col(f"made_.{n}").alias(n) for n in out])


def _wave(factors: Sequence[float | Column], at: Column, by: Sequence[Column] | None = None, f: Callable[[Column], Column] = F.sin) -> Column:
    """The sum of factors[j] f(2 (j + 1) at), each times by[j]."""
    terms = [k * f(2 * j * at) for j, k in enumerate(factors, 1)]
    return sum(terms[1:] if by is None else [t * b for t, b in zip(terms[1:], by[1:], strict=True)], terms[0] if by is None else terms[0] * by[0])


def with_utm(df: DataFrame, lat: Column, lon: Column, epsg: Column, x: str = "x", y: str = "y") -> DataFrame:
    """df with easting and northing on WGS84 in the UTM zone with that EPSG code, which may be another than the point's own."""
    c, tall = F.col, lambda f: [f(2 * j * F.col("eta_")) for j in range(1, 5)]
    middle, south = _zone(epsg)
    return staged(
        df,
        [
            {"sin_": F.sin(F.radians(lat)), "turn_": F.radians(lon - middle), "south_": south},
            {"t_": F.sinh(F.atanh("sin_") - _ECC * F.atanh(_ECC * c("sin_")))},
            {"xi_": F.atan2(c("t_"), F.cos("turn_")), "eta_": F.asinh(F.sin("turn_") / F.sqrt(c("t_") * c("t_") + F.cos("turn_") * F.cos("turn_")))},
        ],
        {x: 500000.0 + UTM_RADIUS * (c("eta_") + _wave(KRUEGER, c("xi_"), tall(F.sinh), F.cos)), y: c("south_") + UTM_RADIUS * (c("xi_") + _wave(KRUEGER, c("xi_"), tall(F.cosh)))},
    )


def with_utm_inverse(df: DataFrame, x: Column, y: Column, epsg: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with latitude and longitude of points of a UTM zone."""
    c, wide = F.col, lambda f: [f(2 * j * F.col("east_")) for j in range(1, 5)]
    middle, south = _zone(epsg)
    return staged(
        df,
        [
            {"north_": (y - south) / UTM_RADIUS, "east_": (x - 500000.0) / UTM_RADIUS, "middle_": middle},
            {"xi_": c("north_") - _wave(KRUEGER_INVERSE, c("north_"), wide(F.cosh)), "eta_": c("east_") - _wave(KRUEGER_INVERSE, c("north_"), wide(F.sinh), F.cos)},
            {"chi_": F.asin(F.sin("xi_") / F.cosh("eta_"))},
        ],
        {lat: F.degrees(c("chi_") + _wave(CONFORMAL, c("chi_"))), lon: c("middle_") + F.degrees(F.atan2(F.sinh("eta_"), F.cos("xi_")))},
    )


def with_geodesic_end(df: DataFrame, lat0: Column, lon0: Column, azimuth: Column, metres: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with the end of a geodesic of WGS84; azimuth in radians from north.  The longitude is within 180 degrees of lon0.

    The closed form of Karney 2013 (7 to 25) with its series up to the third power, so there is no iteration; it is within a tenth of a millimetre at any distance.
    """
    c = F.col
    root = lambda v: F.sqrt(F.greatest(F.lit(0.0), v))
    sa, ca, sb, cb = F.sin("azimuth_"), F.cos("azimuth_"), F.sin("reduced_"), F.cos("reduced_")
    e, k2, s0, c0, one, two, tau = (c(f"{n}_") for n in ("e", "k2", "s0", "c0", "sigma1", "sigma2", "tau"))
    a3 = 1 - (0.5 - _N / 2) * e - (0.25 + _N / 8) * e * e
    c3 = ((0.25 - _N / 4) * e + e * e / 8, (1 / 16 - 3 * _N / 32) * e * e)
    return staged(
        df,
        [
            {"azimuth_": azimuth, "metres_": metres, "lon0_": lon0, "reduced_": F.atan2((1 - _FLAT) * F.sin(F.radians(lat0)), F.cos(F.radians(lat0)))},
            {"s0_": sa * cb, "c0_": root(ca * ca + sa * sa * sb * sb), "sigma1_": F.atan2(sb, ca * cb)},
            {"k2_": ECC2 / (1 - ECC2) * c0 * c0},
            {"e_": k2 / (2 * (1 + F.sqrt(1 + k2)) + k2)},
            {"tau_": c("metres_") / _POLAR * (1 - e) / (1 + e * e / 4) + one + _wave((-e / 2 + 3 * e * e * e / 16, -e * e / 16, -e * e * e / 48), one)},
            {"sigma2_": tau + _wave((e / 2 - 9 * e * e * e / 32, 5 * e * e / 16, 29 * e * e * e / 96), tau)},
            {"turn_": F.atan2(s0 * F.sin(two), F.cos(two)) - F.atan2(s0 * F.sin(one), F.cos(one)) - _FLAT * s0 * a3 * (two - one + _wave(c3, two) - _wave(c3, one))},
        ],
        {lat: F.degrees(F.atan2(c0 * F.sin(two), (1 - _FLAT) * root(c0 * c0 * F.cos(two) * F.cos(two) + s0 * s0))), lon: c("lon0_") + F.degrees(F.atan2(F.sin("turn_"), F.cos("turn_")))},
    )


def with_geodesic(df: DataFrame, lat1: Column, lon1: Column, lat2: Column, lon2: Column, metres: str = "metres", azimuth: str = "azimuth", steps: int = 6) -> DataFrame:
    """df with length and azimuth (radians) of the geodesic of WGS84 from the first point to the second.

    So many steps of Vincenty's iteration on the longitude; six leave less than a millimetre unless the points are nearly opposite each other.
    """
    c = F.col
    u = lambda lat: F.atan2((1 - _FLAT) * F.sin(F.radians(lat)), F.cos(F.radians(lat)))
    s1, c1, s2, c2, v, ss, cs, sigma, sa, ca2, mid = (c(f"{n}_") for n in ("s1", "c1", "s2", "c2", "v", "ss", "cs", "sigma", "sa", "ca2", "mid"))
    east, north = c2 * F.sin(v), c1 * s2 - s1 * c2 * F.cos(v)
    arc = [
        {"ss_": F.sqrt(east * east + north * north), "cs_": s1 * s2 + c1 * c2 * F.cos(v)},
        {"sigma_": F.atan2(ss, cs), "sa_": F.coalesce(F.try_divide(c1 * c2 * F.sin(v), ss), F.lit(0.0))},
        {"ca2_": 1 - sa * sa},
        {"mid_": cs - F.coalesce(F.try_divide(2 * s1 * s2, ca2), F.lit(0.0))},
    ]
    k = _FLAT / 16 * ca2 * (4 + _FLAT * (4 - 3 * ca2))
    longer = [*arc, {"k_": k}, {"v_": c("turn_") + (1 - c("k_")) * _FLAT * sa * (sigma + c("k_") * ss * (mid + c("k_") * cs * (2 * mid * mid - 1)))}]
    u2, a, b = c("u2_"), c("a_"), c("b_")
    return staged(
        df,
        [
            {"s1_": F.sin(u(lat1)), "c1_": F.cos(u(lat1)), "s2_": F.sin(u(lat2)), "c2_": F.cos(u(lat2)), "turn_": F.atan2(F.sin(F.radians(lon2 - lon1)), F.cos(F.radians(lon2 - lon1)))},
            {"v_": c("turn_")},
            *longer * steps,
            *arc,
            {"u2_": ca2 * ECC2 / (1 - ECC2)},
            {"a_": 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), "b_": u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))},
        ],
        {metres: _POLAR * a * (sigma - b * ss * (mid + b / 4 * (cs * (2 * mid * mid - 1) - b / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))), azimuth: F.atan2(east, north)},
    )


def projected(df: DataFrame, kind: str, lat: Column, lon: Column, x: str = "x", y: str = "y") -> DataFrame:
    """df with the place of (lat, lon) in a projection: degrees, sinusoidal, equal_area, azimuthal (equidistant, of WGS84, around columns lat0, lon0) or utm (column epsg)."""
    if kind == "utm":
        return with_utm(df, lat, lon, F.col("epsg"), x, y)
    if kind == "azimuthal":
        far = with_geodesic(df, F.col("lat0"), F.col("lon0"), lat, lon, "far_", "azimuth_")
        return far.withColumns({x: F.col("far_") * F.sin("azimuth_"), y: F.col("far_") * F.cos("azimuth_")}).drop("far_", "azimuth_")
    closed = {"degrees": lambda: (lon, lat), "sinusoidal": lambda: sinusoidal(lat, lon), "equal_area": lambda: equal_area(lat, lon)}
    return df.withColumns(dict(zip((x, y), closed[kind](), strict=True)))


def unprojected(df: DataFrame, kind: str, x: Column, y: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with latitude and longitude of (x, y) in a projection of ``projected``."""
    if kind == "utm":
        return with_utm_inverse(df, x, y, F.col("epsg"), lat, lon)
    if kind == "azimuthal":
        return with_geodesic_end(df, F.col("lat0"), F.col("lon0"), F.atan2(x, y), F.sqrt(x * x + y * y), lat, lon)
    closed = {"degrees": lambda: (y, x), "sinusoidal": lambda: sinusoidal_inverse(x, y), "equal_area": lambda: equal_area_inverse(x, y)}
    return df.withColumns(dict(zip((lat, lon), closed[kind](), strict=True)))


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = ((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def metres_to_degrees(metres: Column, lat: Column) -> tuple[Column, Column]:
    """(latitude, longitude) steps in degrees."""
    return metres / 111320.0, metres / (111320.0 * F.cos(F.radians(lat)))


def box_pixels(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column, pixel: float) -> tuple[Column, Column]:
    """Whole pixels of a box in x and y at its middle latitude."""
    width = (lon_max - lon_min) * 111319.0 * F.cos(F.radians((lat_min + lat_max) / 2))
    return (width / pixel).cast("int"), ((lat_max - lat_min) * 111319.0 / pixel).cast("int")


def grid_row_col(grid_id: Column) -> tuple[Column, Column]:
    """The first integers of the first and the second part of an id such as 12D_34L; null where there is none."""
    parts = F.split(grid_id, "_")
    number = lambda p: F.nullif(F.regexp_extract(p, r"(\d+)", 1), F.lit("")).cast("int")
    return number(F.get(parts, 0)), number(F.get(parts, 1))


def cell_centre(row: Column, col: Column) -> tuple[Column, Column]:
    """(lat, lon) that stands in for a cell without coordinates."""
    return 90.0 - 0.9 * row, -180.0 + 0.9 * col


# ---- the global grid of cells: rows of latitude as high as the spacing at most, cut into columns as wide as the spacing at most ----

#: Fixed value: the radius of the global grid of cells, in kilometres.
GRID_RADIUS = 6378.137


def grid_rows(km: float) -> int:
    """Rows from pole to pole; row 0 begins at the equator, and rows count up to the north and down to the south."""
    return math.ceil(math.pi * GRID_RADIUS / km)


def grid_columns(row: Column, km: float) -> Column:
    """Columns of a row, by the circumference at its southern edge; column 0 begins at the meridian of Greenwich."""
    return F.ceil(2 * math.pi * GRID_RADIUS * F.cos(F.radians(row * 180.0 / grid_rows(km))) / km).cast("long")


def grid_point(row: Column, col: Column, km: float) -> tuple[Column, Column]:
    """(lat, lon) of the south-western corner of a cell, which is the cell's point."""
    return row * 180.0 / grid_rows(km), col * 360.0 / grid_columns(row, km)


def grid_indices_of(lat: Column, lon: Column, km: float) -> tuple[Column, Column]:
    """(row, col) of the cell a point is in.

    An odd number of rows leaves half a row at the south pole, which belongs to the southernmost row; an odd number of columns puts the last one across the date line.
    A cell has its south-western edges, as ``grid_point`` gives them: the quotient may be off by one beside an edge, so it is held against both.
    """
    n = grid_rows(km)
    row = F.greatest(F.lit(-(n // 2)), F.least(F.lit(n - n // 2 - 1), _between(lat, F.lit(n), 180.0)))
    m = grid_columns(row, km)
    east = lon - F.floor((lon + 180.0) / 360.0) * 360.0
    col = _between(east, m, 360.0)
    return row, F.when(col < -F.floor(m / 2), col + m).otherwise(col)


def _between(at: Column, parts: Column, span: float) -> Column:
    """The k with k * span / parts <= at < (k + 1) * span / parts, as these are rounded."""
    k = F.floor(at * parts / span).cast("long")
    return F.when(at < k * span / parts, k - 1).when(at >= (k + 1) * span / parts, k + 1).otherwise(k)


def grid_name(row: Column, col: Column) -> Column:
    """An id such as 12D_34L: rows up (U) or down (D) from the equator, columns right (R) or left (L) of Greenwich."""
    part = lambda n, above, below: F.when(n < 0, F.concat((-n).cast("string"), F.lit(below))).otherwise(F.concat(n.cast("string"), F.lit(above)))
    return F.concat(part(row, "U", "D"), F.lit("_"), part(col, "R", "L"))


def grid_indices(grid_id: Column) -> tuple[Column, Column]:
    """(row, col) of an id of ``grid_name``; null for other strings."""
    part = lambda i: F.regexp_extract(grid_id, r"^(\d+)([UD])_(\d+)([RL])$", i)
    n = lambda i: F.nullif(part(i), F.lit("")).cast("long")
    return F.when(part(2) == "D", -n(1)).otherwise(n(1)), F.when(part(4) == "L", -n(3)).otherwise(n(3))
